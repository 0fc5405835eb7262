"""Dashboard, sales lists, reports and invoice totals.

Plan shape used throughout: sale / order lines are aggregated by their key
*before* they meet another table (partial aggregation runs map-side, so a hot
product or sale never reaches one task as raw rows); the join then works on
one row per key. One-row values (VAT, the active rate) enter as scalar
subqueries, so no join is planned for them at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions import money
from vitrina.functions.money import DEC, to_money
from vitrina.functions.periods import period_bounds

# Display defaults of the sales pages.
UNKNOWN_CLIENT = "Cliente desconocido"


def _line_amount(price="precio_unitario", qty="cantidad") -> Column:
    """price x quantity of a stored line (NULL price or quantity -> NULL)."""
    return F.col(qty).cast("decimal(10,0)") * F.col(price).cast(DEC)


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


# ---------------------------------------------------------------- dashboard
def top_products(ctx, n: int = 5) -> DataFrame:
    """Units and revenue per sold product, top ``n`` by units."""
    per_product = ctx["detalle_ventas"].groupBy("id_producto").agg(
        F.sum("cantidad").alias("cantidad"),
        F.sum(_line_amount()).alias("total"))
    prods = ctx["productos"].select("id_producto", F.col("nombre").alias("producto"))
    j = per_product.join(prods, "id_producto", "inner")
    return (j.select("id_producto", "producto", "cantidad",
                     to_money(F.coalesce(F.col("total"), F.lit(0))).alias("total"))
            .orderBy(F.desc_nulls_last("cantidad"), F.asc("id_producto"))
            .limit(n))


def stock_by_category(ctx, n: int = 5) -> DataFrame:
    """Total stock per category (0 without products), top ``n``."""
    stock = (ctx["productos"].select("id_producto", "id_categoria")
             .join(ctx["inventario"].select("id_producto", "stock_actual"), "id_producto", "left")
             .groupBy("id_categoria").agg(F.sum("stock_actual").alias("stock")))
    j = ctx["categorias"].join(stock, "id_categoria", "left")
    return (j.select("id_categoria", F.col("nombre").alias("categoria"),
                     F.coalesce(F.col("stock"), F.lit(0)).cast("long").alias("stock"))
            .orderBy(F.desc("stock"), F.asc("id_categoria"))
            .limit(n))


def sales_by_month(ctx) -> DataFrame:
    """Income per month of year ('01'..'12'); years are merged."""
    v = ctx["ventas"]
    return (v.groupBy(F.date_format("fecha", "MM").alias("mes"))
            .agg(to_money(F.coalesce(F.sum("total"), F.lit(0).cast(DEC))).alias("total"))
            .orderBy(F.asc_nulls_first("mes")))


def profit_series(ctx, expense_factor: str = money.EXPENSE_FACTOR) -> DataFrame:
    """Month, income and expenses = factor x income."""
    v = ctx["ventas"]
    s = v.groupBy(F.date_format("fecha", "MM").alias("mes")).agg(
        F.coalesce(F.sum("total"), F.lit(0).cast(DEC)).alias("ingresos"))
    return (s.select("mes", to_money("ingresos").alias("ingresos"),
                     to_money(F.round(F.col("ingresos") * F.lit(expense_factor).cast("decimal(4,2)"), 2))
                     .alias("gastos"))
            .orderBy(F.asc_nulls_first("mes")))


def dashboard_kpis(ctx) -> DataFrame:
    """One row of five counters, each a scalar subquery (no joins)."""
    v, c, p, i = ctx["ventas"], ctx["clientes"], ctx["productos"], ctx["inventario"]
    one = ctx.spark.range(1)
    return one.select(
        v.select(F.count(F.lit(1))).scalar().alias("total_ventas"),
        c.filter(F.col("activo") == 1).select(F.count(F.lit(1))).scalar().alias("clientes_activos"),
        p.filter(F.col("activo") == 1).select(F.count(F.lit(1))).scalar().alias("productos_activos"),
        i.select(F.coalesce(F.sum("stock_actual"), F.lit(0)).cast("long")).scalar().alias("stock_total"),
        v.select(to_money(F.coalesce(F.sum("total"), F.lit(0).cast(DEC)))).scalar().alias("ingresos_totales"),
    )


# ---------------------------------------------------------------- sales lists
def _client_names(ctx) -> DataFrame:
    return ctx["clientes"].select("id_cliente", F.col("nombre").alias("cliente"))


def _with_client_and_items(ctx, sales: DataFrame, lines: DataFrame) -> DataFrame:
    items = lines.groupBy("id_venta").agg(F.count("id_detalle").alias("items"))
    j = (sales.join(_client_names(ctx), "id_cliente", "left")
         .join(items, "id_venta", "left"))
    return j.select(
        F.col("id_venta").alias("id"),
        F.coalesce(F.col("cliente"), F.lit(UNKNOWN_CLIENT)).alias("cliente"),
        "fecha",
        F.coalesce(F.col("items"), F.lit(0)).cast("long").alias("items"),
        to_money(F.coalesce(F.col("total"), F.lit(0).cast(DEC))).alias("total"),
    )


def sales_list(ctx, limit: int = 20) -> DataFrame:
    """Newest ``limit`` sales with client, date, line count and total.

    The top-``limit`` sales are chosen first (a per-partition top-k, no full
    sort); only their lines are then counted, via a semi join whose build side
    holds at most ``limit`` keys.
    """
    newest = (ctx["ventas"].orderBy(F.desc_nulls_last("fecha"), F.asc("id_venta")).limit(limit))
    keys = F.broadcast(newest.select("id_venta"))  # at most `limit` rows
    lines = ctx["detalle_ventas"].join(keys, "id_venta", "left_semi")
    out = _with_client_and_items(ctx, newest, lines)
    return out.orderBy(F.desc_nulls_last("fecha"), F.asc("id"))


def _in_range(df: DataFrame, date_from: str | None, date_to: str | None) -> DataFrame:
    if date_from and date_to:
        lo = _ts(date_from)
        hi = F.to_timestamp_ntz(F.lit(f"{date_to} 23:59:59"))
        df = df.filter((F.col("fecha") >= lo) & (F.col("fecha") <= hi))
    return df


def sales_report(ctx, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Every sale in [from, to 23:59:59] with client, line count, total.

    The range is applied only if both ends are given (as in the reference);
    it filters the sales scan (pushed into parquet). Lines are aggregated per
    sale before the join.
    """
    sales = _in_range(ctx["ventas"], date_from, date_to)
    out = _with_client_and_items(ctx, sales, ctx["detalle_ventas"])
    return out.orderBy(F.desc_nulls_last("fecha"), F.asc("id"))


def report_totals(ctx, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Number of invoices and grand total of the report range."""
    sales = _in_range(ctx["ventas"], date_from, date_to)
    return sales.agg(
        F.count(F.lit(1)).alias("facturas"),
        to_money(F.coalesce(F.sum("total"), F.lit(0).cast(DEC))).alias("gran_total"))


def sales_by_period(ctx, period: str = "monthly") -> DataFrame:
    """O34 + O35 for every period of one type at once.

    One aggregation keyed by the period start; the partial aggregate runs
    before the shuffle, so the shuffle carries one row per (partition, period).
    """
    v = ctx["ventas"].select(F.to_date("fecha").alias("d"), "total")
    start, _ = period_bounds(F.col("d"), period)
    g = v.groupBy(start.alias("desde")).agg(
        F.count(F.lit(1)).alias("facturas"),
        F.coalesce(F.sum("total"), F.lit(0).cast(DEC)).alias("total"))
    _, g_end = period_bounds(F.col("desde"), period)
    return (g.select(F.lit(period).alias("tipo"), "desde", g_end.alias("hasta"), "facturas",
                     to_money("total").alias("total"))
            .orderBy(F.asc_nulls_first("desde")))


# ---------------------------------------------------------------- money
def active_rate(ctx, feed: DataFrame | None = None) -> DataFrame:
    """O46 helper: one row (tasa, fuente): configured rate if > 0 ('manual'),
    else the feed rate ('bcv'), else the fixed default."""
    cfg = ctx["configuracion"].select(money.positive_or_null("tasa_usd").alias("r"))
    manual = cfg.agg(F.max("r").alias("r"))
    if feed is None:
        feed_rate = F.lit(None).cast(money.RATE)
    else:
        feed_rate = feed.select(F.max(money.positive_or_null("usd")).cast(money.RATE)).scalar()
    m = manual.select(F.col("r").cast(money.RATE).alias("m"), feed_rate.alias("f"))
    return m.select(
        F.coalesce("m", "f", F.lit(money.DEFAULT_RATE).cast(money.RATE)).alias("tasa"),
        F.when(F.col("m").isNotNull(), F.lit("manual")).otherwise(F.lit("bcv")).alias("fuente"))


def prices_in_currency(ctx, feed: DataFrame | None = None) -> DataFrame:
    """USD and local price for every product with the active rate."""
    rate = active_rate(ctx, feed)
    r = rate.select("tasa").scalar()
    src = rate.select("fuente").scalar()
    p = ctx["productos"]
    return p.select(
        "id_producto", "nombre",
        to_money("precio_venta").alias("precio_usd"),
        to_money(F.round(F.col("precio_venta") * r, 2)).alias("precio_bs"),
        r.cast("double").alias("tasa"),
        src.alias("fuente"),
        money.format_price("precio_venta", r).alias("precio_texto"),
        money.format_admin_price("precio_venta", r).alias("precio_admin"),
    )


def current_vat(ctx) -> Column:
    """O49 as a scalar: configured VAT if > 0, else 16."""
    return ctx["configuracion"].select(money.vat_rate(F.max("iva_default"))).scalar()


def vat_rate_table(ctx) -> DataFrame:
    """O49 as a one-row frame."""
    return ctx["configuracion"].agg(money.vat_rate(F.max("iva_default")).cast("double").alias("iva"))


def cart_totals(ctx, lines: DataFrame | None = None) -> DataFrame:
    """Per cart, sum of price x quantity (missing price 0, quantity 1)."""
    d = ctx["detalle_carrito"] if lines is None else lines
    amount = (F.coalesce(F.col("precio_unitario").cast(DEC), F.lit(0).cast(DEC))
              * F.coalesce(F.col("cantidad"), F.lit(1)).cast("decimal(10,0)"))
    return d.groupBy("id_carrito").agg(
        to_money(F.sum(amount)).alias("total"),
        F.count(F.lit(1)).alias("lineas"),
        F.sum(F.coalesce(F.col("cantidad"), F.lit(1))).cast("long").alias("unidades"))


def invoice_totals(ctx, with_lines: bool = False) -> DataFrame:
    """Invoice header per sale; without an invoice row the subtotal is
    the sale total and VAT is 0. Optionally the lines as an array."""
    v = ctx["ventas"]
    f = ctx["facturas"].select("id_venta", "subtotal", "porcentaje_iva", "impuesto",
                               F.lit(True).alias("_has"))
    j = v.join(f, "id_venta", "left").join(_client_names(ctx), "id_cliente", "left")
    has = F.col("_has").isNotNull()
    out = j.select(
        F.col("id_venta").alias("id"),
        money.invoice_number("id_venta").alias("numero"),
        "cliente", "fecha",
        to_money(F.coalesce("total", F.lit(0).cast(DEC))).alias("total"),
        to_money(F.when(has, F.col("subtotal")).otherwise(F.col("total"))).alias("subtotal"),
        F.when(has, F.col("porcentaje_iva")).otherwise(F.lit(0)).cast("double").alias("iva_pct"),
        to_money(F.when(has, F.col("impuesto")).otherwise(F.lit(0))).alias("iva_monto"),
    )
    if with_lines:
        prods = ctx["productos"].select("id_producto", F.col("nombre").alias("producto"))
        lines = (ctx["detalle_ventas"].join(prods, "id_producto", "left")
                 .groupBy("id_venta").agg(F.sort_array(F.collect_list(F.struct(
                     F.col("id_detalle"), F.col("producto"), F.col("cantidad"),
                     F.coalesce("precio_unitario", F.lit(0).cast(DEC)).alias("precio"),
                     F.coalesce(_line_amount(), F.lit(0)).alias("total")))).alias("detalles")))
        out = out.join(lines.withColumnRenamed("id_venta", "id"), "id", "left")
    return out


def order_line_amounts(ctx) -> DataFrame:
    """Per order: receipt subtotal from its lines (price or 0) x (quantity or 1)."""
    d = ctx["detalle_pedidos"]
    qty = F.when(F.col("cantidad").isNull() | (F.col("cantidad") == 0), F.lit(1)).otherwise(F.col("cantidad"))
    amt = F.coalesce(F.col("precio_unitario"), F.lit(0).cast(DEC)) * qty.cast("decimal(10,0)")
    return d.groupBy("id_pedido").agg(F.sum(amt).cast(DEC).alias("subtotal"),
                                      F.count(F.lit(1)).alias("lineas"))


def latest_shipment(ctx) -> DataFrame:
    """One shipment per order: the one with the highest id (see O23)."""
    e = ctx["envios"].select("id_pedido", "id_envio", "tipo_envio")
    return e.groupBy("id_pedido").agg(F.max_by("tipo_envio", "id_envio").alias("tipo_envio"))


def _receipt(ctx, vat: Column | None = None) -> DataFrame:
    rate = current_vat(ctx) if vat is None else vat
    sub = order_line_amounts(ctx)
    ship = latest_shipment(ctx).select("id_pedido", "tipo_envio")
    j = (ctx["pedidos"].select("id_pedido").join(sub, "id_pedido", "left")
         .join(ship, "id_pedido", "left"))
    subtotal = F.coalesce(F.col("subtotal"), F.lit(0).cast(DEC))
    fee = F.when(F.col("tipo_envio") == "destino", F.lit(money.SHIPPING_FEE).cast(DEC)).otherwise(F.lit(0).cast(DEC))
    j = j.select("id_pedido", subtotal.alias("subtotal"), rate.alias("iva_pct"), fee.alias("envio"))
    return j.withColumn("iva_monto", money.vat_amount("subtotal", "iva_pct"))


def receipt_totals(ctx, vat: Column | None = None) -> DataFrame:
    """Receipt per order recomputed from its lines with the current VAT,
    plus the shipping fee for home delivery ('destino')."""
    r = _receipt(ctx, vat)
    return r.select(
        "id_pedido",
        to_money("subtotal").alias("subtotal"),
        F.col("iva_pct").cast("double").alias("iva_pct"),
        to_money("iva_monto").alias("iva_monto"),
        to_money("envio").alias("envio"),
        to_money(F.round(F.col("subtotal") + F.col("iva_monto") + F.col("envio"), 2)).alias("total"),
    )


def receipt_vs_order(ctx, vat: Column | None = None, orders: DataFrame | None = None) -> DataFrame:
    """Orders whose stored total (no shipping) differs from the receipt
    subtotal + VAT by at least one cent. ``orders`` (id_pedido, total) stands in
    for the order table if given."""
    r = _receipt(ctx, vat).select(
        "id_pedido", F.round(F.col("subtotal") + F.col("iva_monto"), 2).alias("recalculado"))
    p = (ctx["pedidos"] if orders is None else orders).select("id_pedido", F.col("total").alias("guardado"))
    j = p.join(r, "id_pedido", "inner")
    diff = F.col("guardado") - F.col("recalculado")
    return (j.filter(F.abs(diff) >= F.lit("0.01").cast(DEC))
            .select("id_pedido", to_money("guardado").alias("guardado"),
                    to_money("recalculado").alias("recalculado"),
                    to_money(diff).alias("diferencia")))


def orders_with_receipt_totals(ctx, vat: Column | None = None) -> DataFrame:
    """(id_pedido, total) where two orders in three store what their receipt
    says, every sixth one cent more, and the rest their own total."""
    r = _receipt(ctx, vat).select("id_pedido", F.round(F.col("subtotal") + F.col("iva_monto"), 2).alias("_receipt"))
    cent = F.when(F.col("id_pedido") % 6 == 0, F.lit("0.01")).otherwise(F.lit("0.00")).cast(DEC)
    p = ctx["pedidos"].select("id_pedido", "total").join(r, "id_pedido", "left")
    return p.select("id_pedido", F.when(F.col("id_pedido") % 3 == 1, F.col("total")).otherwise(F.col("_receipt") + cent).cast(DEC).alias("total"))
