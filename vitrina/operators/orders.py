"""Orders, order lines, carts and people lookups.

The shipment table may hold several rows per order. Every order-level join
goes through ``orders_one_shipment`` (one row per order, latest shipment id)
so joins never fan out and "newest 50 orders" counts orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.ids import dense_ids, next_id_base
from vitrina.functions.money import DEC, to_money
from vitrina.functions.serve import refused_in_order
from vitrina.operators.catalog import PLACEHOLDER_IMAGE, first_image
from vitrina.operators.sales import active_rate

# Display defaults of the order pages.
DEFAULT_STATE = "Pendiente"
CUSTOM_PRODUCT_NAME = "Producto personalizado"
DEFAULT_ROLE = "Trabajador"
NO_CARRIER = "Sin asignar"
# Admin action for each order state.
NEXT_ACTION = [("Pendiente de Verificación", "verificar"), ("Procesando", "enviar"),
               ("Enviado", "entregar")]


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` per ``key``, as a partial
    ``max_by`` aggregate (map-side combine), so a key with very many rows is
    reduced before the shuffle instead of landing whole in one window task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def orders_one_shipment(ctx) -> DataFrame:
    """One shipment per order (highest shipment id)."""
    return latest_per_key(ctx["envios"], "id_pedido", "id_envio")


def _states(ctx) -> DataFrame:
    return ctx.dim("estados_pedido").select("id_estado", F.col("nombre").alias("estado"))


def order_history(ctx) -> DataFrame:
    """Orders per client with state, carrier, tracking; newest first.
    ``envio_texto`` / ``guia_texto`` are the texts the order page shows
    ('Sin asignar' for no carrier or 'Pendiente', 'Pendiente' for no tracking)."""
    ship = orders_one_shipment(ctx).select("id_pedido", "empresa_envio", "numero_guia")
    j = (ctx["pedidos"].join(_states(ctx), "id_estado", "left")
         .join(ship, "id_pedido", "left"))
    carrier = F.coalesce("empresa_envio", F.lit(""))
    tracking = F.coalesce("numero_guia", F.lit(""))
    return (j.select("id_cliente", F.col("id_pedido").alias("id"), "fecha",
                     to_money(F.coalesce("total", F.lit(0).cast(DEC))).alias("total"),
                     F.coalesce("estado", F.lit(DEFAULT_STATE)).alias("estado"),
                     carrier.alias("empresa_envio"), tracking.alias("numero_guia"),
                     F.when((carrier != "") & (carrier != "Pendiente"), carrier)
                      .otherwise(F.lit(NO_CARRIER)).alias("envio_texto"),
                     F.when(tracking != "", tracking).otherwise(F.lit("Pendiente")).alias("guia_texto"))
            .orderBy(F.asc_nulls_first("id_cliente"), F.desc_nulls_last("fecha"), F.asc("id")))


def next_action(state_col) -> F.Column:
    expr = F.lit("ninguna")
    for name, action in reversed(NEXT_ACTION):
        expr = F.when(state_col == name, F.lit(action)).otherwise(expr)
    return expr


def admin_orders(ctx, limit: int = 50) -> DataFrame:
    """Newest ``limit`` orders with client, state, shipment, payment data,
    the next admin action, and the total in local currency.

    The newest orders are picked first (top-k), then joined; the joined sides
    are filtered to those keys through a bounded broadcast semi join.
    """
    newest = ctx["pedidos"].orderBy(F.desc_nulls_last("fecha"), F.asc("id_pedido")).limit(limit)
    keys = F.broadcast(newest.select("id_pedido"))  # at most `limit` rows
    e = ctx["envios"].join(keys, "id_pedido", "left_semi")
    ship = latest_per_key(e, "id_pedido", "id_envio").select(
        "id_pedido", "direccion_envio", "metodo_pago", "referencia_pago", "empresa_envio", "numero_guia")
    clients = ctx["clientes"].select("id_cliente", F.col("nombre").alias("cliente"), "telefono", "correo")
    rate = active_rate(ctx).select("tasa").scalar()
    j = (newest.join(clients, "id_cliente", "left")
         .join(_states(ctx), "id_estado", "left")
         .join(ship, "id_pedido", "left"))
    total = F.coalesce("total", F.lit(0).cast(DEC))
    return (j.select(F.col("id_pedido").alias("id"), "cliente", "telefono", "correo", "estado",
                     to_money(total).alias("total"), "fecha",
                     "direccion_envio", "metodo_pago", "referencia_pago", "empresa_envio", "numero_guia",
                     next_action(F.col("estado")).alias("accion"),
                     to_money(F.round(total * rate, 2)).alias("total_bs"))
            .orderBy(F.desc_nulls_last("fecha"), F.asc("id")))


def order_items(ctx) -> DataFrame:
    """Order lines with product name and line total
    (price or 0) x (quantity or 1); 0 counts as missing, as Python ``or``."""
    prods = ctx["productos"].select("id_producto", F.col("nombre").alias("producto"))
    d = ctx["detalle_pedidos"].join(prods, "id_producto", "left")
    qty = F.when(F.col("cantidad").isNull() | (F.col("cantidad") == 0), F.lit(1)).otherwise(F.col("cantidad"))
    price = F.coalesce("precio_unitario", F.lit(0).cast(DEC))
    return d.select("id_pedido", F.col("id_detalle").alias("id"), F.col("id_producto").alias("product_id"),
                    F.coalesce("producto", F.lit(CUSTOM_PRODUCT_NAME)).alias("name"),
                    F.col("cantidad").alias("quantity"), to_money(price).alias("price"),
                    to_money(price * qty.cast("decimal(10,0)")).alias("total"))


def cart_items(ctx, lines: DataFrame | None = None) -> DataFrame:
    """Cart lines with product name, description and first image."""
    d = ctx["detalle_carrito"] if lines is None else lines
    prods = ctx["productos"].select("id_producto", "nombre", "descripcion")
    j = d.join(prods, "id_producto", "left").join(first_image(ctx), "id_producto", "left")
    return j.select("id_carrito", "id_detalle", "id_producto",
                    F.coalesce("nombre", F.lit(CUSTOM_PRODUCT_NAME)).alias("name"),
                    F.coalesce("descripcion", F.lit("")).alias("details"),
                    to_money(F.coalesce("precio_unitario", F.lit(0).cast(DEC))).alias("price"),
                    F.coalesce("cantidad", F.lit(1)).alias("quantity"),
                    F.coalesce("ruta_imagen", F.lit(PLACEHOLDER_IMAGE)).alias("image_url"))


def order_detail(ctx, with_items: bool = True) -> DataFrame:
    """Order header (client, e-mail, address, payment) with its items.

    The owner check of the reference (order id AND client) is the join key
    ``(id_pedido, id_cliente)``; here every order is served to its owner.
    """
    ship = orders_one_shipment(ctx).select(
        "id_pedido", F.col("direccion_envio").alias("direccion"), "empresa_envio",
        F.col("metodo_pago").alias("payment_method"), F.col("referencia_pago").alias("reference"),
        "tipo_envio")
    clients = ctx["clientes"].select("id_cliente", F.col("nombre").alias("cliente"),
                                     F.col("correo").alias("cliente_correo"))
    h = (ctx["pedidos"].join(_states(ctx), "id_estado", "left")
         .join(clients, "id_cliente", "left").join(ship, "id_pedido", "left"))
    out = h.select(F.col("id_pedido").alias("id"), "id_cliente", "fecha",
                   to_money(F.coalesce("total", F.lit(0).cast(DEC))).alias("total"),
                   F.coalesce("estado", F.lit(DEFAULT_STATE)).alias("estado"),
                   *[F.coalesce(c, F.lit("")).alias(c) for c in
                     ("cliente", "cliente_correo", "direccion", "payment_method", "reference")])
    items = order_items(ctx)
    agg = items.groupBy(F.col("id_pedido").alias("id")).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(F.col("total").cast(DEC)).alias("_items_total"),
        *([F.sort_array(F.collect_list(F.struct("id", "product_id", "name", "quantity", "price", "total")))
           .alias("items")] if with_items else []))
    out = out.join(agg, "id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    out = out.withColumn("items_total", to_money(F.coalesce("_items_total", F.lit(0).cast(DEC)))).drop("_items_total")
    return out


def client_of_user(ctx) -> DataFrame:
    """Web user -> client row by e-mail (NULL if none)."""
    u = ctx["usuarios"].select("id_usuario", "correo")
    c = ctx["clientes"].select("correo", "id_cliente")
    return u.join(c, "correo", "left").select("id_usuario", "correo", "id_cliente")


def users_with_role(ctx) -> DataFrame:
    """Users with role name, 'Trabajador' when the role is unknown."""
    r = ctx.dim("roles").select("id_rol", F.col("nombre").alias("rol"))
    u = ctx["usuarios"].select("id_usuario", "nombre", "correo", "id_rol")
    return u.join(r, "id_rol", "left").select(
        "id_usuario", "nombre", "correo", "id_rol", F.coalesce("rol", F.lit(DEFAULT_ROLE)).alias("rol"))


def _first_creators(cand: DataFrame) -> DataFrame:
    """Rows that create a new client, exactly as the sequential reference
    decides them: a row creates a client iff no earlier creator shares its
    e-mail or its (name, address). Both are items that one row can take, so the
    creators are the rows that ``refused_in_order`` serves; values that only one
    row has drop out there at once."""
    items = F.array("_mail_node", F.concat(F.lit("n:"), "_name_node"))
    one = F.lit(1).cast("long")
    wants = cand.select(F.col("key").alias("order"), F.explode(items).alias("item"), one.alias("need"), one.alias("used"), one.alias("stock"))
    refused = refused_in_order(wants).withColumnRenamed("order", "key")
    return cand.join(refused, "key", "left_anti").select("key", "_mail_node", "_name_node")


def match_or_create_clients(incoming: DataFrame, clients: DataFrame) -> DataFrame:
    """Tiered client match for incoming (key, nombre, correo, direccion,
    telefono, cedula) rows, processed as the reference does, in key order.

    Tier 1: a client with the e-mail (skipped for an empty e-mail): an
    existing one, else a client created by an earlier incoming row. Tier 2: a
    client with the same (name, address), existing first, else created
    earlier. Else the row creates a client (origin 'auto'), numbered after the
    current maximum in key order. Existing clients always have the lower ids,
    so they win a tie within a tier (the reference's ``LIMIT 1``).
    ``client_writes`` gives the rows to insert and update.
    Returns one row per incoming key: (key, id_cliente, tier).
    """
    by_mail = (clients.filter(F.col("correo").isNotNull() & (F.col("correo") != ""))
               .groupBy(F.col("correo").alias("_mail")).agg(F.min("id_cliente").alias("id_mail")))
    by_name = clients.groupBy("nombre", "direccion").agg(F.min("id_cliente").alias("id_name"))
    inc = incoming.withColumn("_mail", F.when(F.col("correo") != "", F.col("correo")))
    inc = inc.withColumn("_name_node", F.concat_ws("\u0001", F.coalesce("nombre", F.lit("")),
                                                   F.coalesce("direccion", F.lit(""))))
    # an empty e-mail is no node to share: give the row a node of its own
    inc = inc.withColumn("_mail_node", F.coalesce(F.concat(F.lit("m:"), "_mail"),
                                                  F.concat(F.lit("k:"), F.col("key").cast("string"))))
    j = inc.join(by_mail, "_mail", "left").join(by_name, ["nombre", "direccion"], "left")
    cand = j.filter(F.col("id_mail").isNull() & F.col("id_name").isNull())
    creators = _first_creators(cand)
    creators = dense_ids(creators, ["key"], next_id_base(clients, "id_cliente"), "id_nuevo")
    by_new_mail = creators.filter(F.col("_mail_node").startswith("m:")).select(
        F.col("_mail_node"), F.col("key").alias("_ck_m"), F.col("id_nuevo").alias("id_new_mail"))
    by_new_name = creators.select("_name_node", F.col("key").alias("_ck_n"), F.col("id_nuevo").alias("id_new_name"))
    own = creators.select("key", F.col("id_nuevo").alias("id_own"))
    r = (j.join(by_new_mail, "_mail_node", "left").join(by_new_name, "_name_node", "left")
         .join(own, "key", "left"))
    # a created client only counts for rows after its creator
    new_mail = F.when(F.col("_ck_m") < F.col("key"), F.col("id_new_mail"))
    new_name = F.when(F.col("_ck_n") < F.col("key"), F.col("id_new_name"))
    mail_id = F.coalesce(F.col("id_mail"), new_mail)
    name_id = F.coalesce(F.col("id_name"), new_name)
    return r.select(
        "key",
        F.coalesce(mail_id, name_id, F.col("id_own")).alias("id_cliente"),
        F.when(mail_id.isNotNull(), F.lit("correo")).when(name_id.isNotNull(), F.lit("nombre_direccion"))
         .otherwise(F.lit("nuevo")).alias("tier"))


def client_writes(incoming: DataFrame, matched: DataFrame, clients: DataFrame) -> DataFrame:
    """O29, the rows to write: new clients (origin 'auto') and clients found by
    e-mail with the phone and id card of their last incoming row, by key.
    ``matched`` is the result of ``match_or_create_clients``."""
    m = matched.join(incoming, "key")
    last = m.filter(F.col("tier") == "correo").groupBy("id_cliente").agg(
        F.max_by(F.struct("telefono", "cedula"), "key").alias("u"))
    base = m.filter(F.col("tier") == "nuevo").select(
        "id_cliente", "nombre", "correo", "telefono", "direccion", "cedula", F.lit("auto").alias("origen"))
    new = base.join(last, "id_cliente", "left").select(
        "id_cliente", "nombre", "correo", F.coalesce("u.telefono", "telefono").alias("telefono"), "direccion",
        F.coalesce("u.cedula", "cedula").alias("cedula"), "origen", F.lit("nuevo").alias("cambio"))
    old = clients.join(last, "id_cliente").select(
        "id_cliente", "nombre", "correo", F.col("u.telefono").alias("telefono"), "direccion",
        F.col("u.cedula").alias("cedula"), "origen", F.lit("actualizado").alias("cambio"))
    return new.unionByName(old)


def incoming_from_customers(ctx) -> DataFrame:
    """Every customer presented as a checkout form: e-mail left empty for every
    4th key and the name changed for every 5th, so all three tiers occur."""
    c = ctx["clientes"]
    k = F.col("id_cliente")
    return c.select(
        k.alias("key"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.concat(F.col("nombre"), F.lit(" (nuevo)")))
         .otherwise(F.col("nombre")).alias("nombre"),
        F.when(F.pmod(k, F.lit(4)) == 0, F.lit("")).otherwise(F.col("correo")).alias("correo"),
        F.col("direccion"),
        F.concat(F.lit("0414-"), k.cast("string")).alias("telefono"),
        F.concat(F.lit("V-"), k.cast("string")).alias("cedula"),
    )


def select_cart_positions(lines: DataFrame, positions: list[int], remove: bool = False) -> DataFrame:
    """List positions (0-based, by line id) within each cart; keep the
    chosen positions, or drop them with ``remove``. Out-of-range positions are
    ignored; an empty list keeps every line.

    Positions come from a running count (``running_sum``), so a very large cart
    is numbered by many tasks, not one window."""
    from vitrina.functions.scan import running_sum
    if not positions:
        return lines
    one = lines.withColumn("_one", F.lit(1))
    numbered = running_sum(one, ["id_carrito"], ["id_detalle"], "_one", "_pos")
    numbered = numbered.withColumn("posicion", (F.col("_pos") - 1).cast("int")).drop("_one", "_pos")
    hit = F.col("posicion").isin(positions)
    return numbered.filter(~hit if remove else hit)
