"""Table-changing jobs.

Parquet has no MERGE, so each job is a pure function
``old snapshot + changes -> new snapshot (or the changed rows)``; the caller
writes the result to a new path (see ``vitrina.sources.sinks.write_snapshot``).
Changes are reduced to one row per target key with partial aggregates before
they are joined, so duplicate or hot keys in the change set do not multiply
rows or load one task with raw rows.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions import money, text
from vitrina.functions.frames import Frames
from vitrina.functions.ids import dense_ids, next_id_base
from vitrina.functions.money import DEC, to_money
from vitrina.functions.serve import refused_in_order
from vitrina.session import ensure_checkpoint_dir

# Names the jobs set or look for.
PENDING_STATE = "Pendiente de Verificación"
PROCESSING_STATE = "Procesando"
SHIPPED = "Enviado"
CARRIER_BY_TYPE = [("destino", "Cobro a Destino"), ("tienda", "Retiro en Tienda"),
                   ("agencia", "Retirar en Agencia")]
CUSTOM_CATEGORY = "Personalizado"
CUSTOM_NAME, CUSTOM_TEXT, CUSTOM_PRICE = "Producto Personalizado", "Producto personalizado", "30.00"


# ---------------------------------------------------------------- carts
def merge_carts(guest: DataFrame, saved: DataFrame) -> DataFrame:
    """Guest cart lines into the saved cart of the same client.

    For a product already saved, the guest quantities are added to the first
    saved line of that product (lowest line id) and the saved price is kept;
    other products are appended once, with the summed guest quantity and the
    price of the first guest line. Both inputs: (id_carrito, id_producto,
    id_detalle, cantidad, precio_unitario).
    """
    key = ["id_carrito", "id_producto"]
    g = guest.filter(F.col("id_producto").isNotNull()).groupBy(*key).agg(
        F.sum(F.coalesce("cantidad", F.lit(1))).alias("g_qty"),
        F.min("id_detalle").alias("g_id"),
        F.min_by("precio_unitario", "id_detalle").alias("g_price"))
    first_saved = saved.groupBy(*key).agg(F.min("id_detalle").alias("s_first"))
    m = g.join(first_saved, key, "full_outer")
    adds = m.filter(F.col("s_first").isNotNull() & F.col("g_qty").isNotNull()) \
        .select(F.col("s_first").alias("id_detalle"), "g_qty")
    kept = saved.join(adds, "id_detalle", "left").select(
        "id_carrito", "id_producto", "id_detalle",
        (F.coalesce("cantidad", F.lit(1)) + F.coalesce("g_qty", F.lit(0))).cast("long").alias("cantidad"),
        "precio_unitario", F.lit("guardado").alias("origen"))
    appended = m.filter(F.col("s_first").isNull()).select(
        "id_carrito", "id_producto", F.col("g_id").alias("id_detalle"),
        F.col("g_qty").cast("long").alias("cantidad"), F.col("g_price").alias("precio_unitario"),
        F.lit("invitado").alias("origen"))
    return kept.unionByName(appended)


def replace_carts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every cart present in ``new`` loses its old lines and gets the new ones."""
    carts = new.select("id_carrito").distinct()
    return old.join(carts, "id_carrito", "left_anti").unionByName(new.select(*old.columns))


CART_PARTS = 256  # folders of a stored cart table


def write_carts(lines: DataFrame, path: str, parts: int = CART_PARTS) -> None:
    """Store cart lines in folders by cart (``_parte`` = hash of the cart)."""
    lines.withColumn("_parte", F.pmod(F.xxhash64("id_carrito"), F.lit(parts)).cast("int")) \
        .repartition("_parte").write.mode("overwrite").partitionBy("_parte").parquet(path)


def replace_stored_carts(path: str, new: DataFrame, parts: int = CART_PARTS) -> None:
    """O59 on disk: of the table that ``write_carts`` stored (with the same
    ``parts``), only the folders that hold a cart of ``new`` are read and
    overwritten. Their new content is checkpointed first, since a job must not
    overwrite what it reads; a cart emptied by the caller keeps no line if it is in
    ``new`` with a NULL product and no quantity (such rows name a cart only)."""
    spark = new.sparkSession
    ensure_checkpoint_dir(spark)
    part = F.pmod(F.xxhash64("id_carrito"), F.lit(parts)).cast("int")
    new = new.withColumn("_parte", part)
    touched = new.select("_parte").distinct()
    old = spark.read.parquet(path)
    old = old.join(F.broadcast(touched), "_parte", "left_semi")  # at most ``parts`` numbers; prunes the scan
    lines = new.filter(F.col("id_producto").isNotNull() | F.col("cantidad").isNotNull())
    kept = old.join(new.select("id_carrito").distinct(), "id_carrito", "left_anti")
    rows = kept.unionByName(lines.select(*kept.columns)).checkpoint(eager=True)
    rows.repartition("_parte").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_parte").parquet(path)


def adjust_cart_quantities(cart: DataFrame, deltas: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Quantity + summed delta per (cart, product), at least 1; lines
    without a delta stay as they are, lines of (cart, product) pairs in
    ``removals`` are dropped.

    Deltas are summed first and the lower bound applied once (the page applies
    it per click, so mixed signs across clicks may differ)."""
    key = ["id_carrito", "id_producto"]
    d = deltas.groupBy(*key).agg(F.sum("delta").alias("_delta"))
    out = cart.join(d, key, "left")
    if removals is not None:
        out = out.join(removals.select(*key).distinct(), key, "left_anti")
    q = F.greatest(F.lit(1), F.coalesce("cantidad", F.lit(1)) + F.col("_delta"))
    return out.withColumn("cantidad", F.when(F.col("_delta").isNull(), F.col("cantidad")).otherwise(q).cast("int")) \
        .drop("_delta")


# ---------------------------------------------------------------- stock
def stock_check(lines: DataFrame, inventory: DataFrame, products: DataFrame | None = None,
                per_product: bool = False) -> DataFrame:
    """Is there enough stock for each requested line?

    A missing stock row counts as 0. Quantity is max(1, qty). Lines without
    a product id (custom items) are not checked. ``per_product`` sums the
    quantities of one (cart, product) first, so two lines cannot pass
    together on stock that only covers one of them.
    """
    q = F.greatest(F.lit(1), F.coalesce("cantidad", F.lit(1)))
    req = lines.withColumn("_qty", q)
    if per_product:
        req = req.groupBy("id_carrito", "id_producto").agg(F.sum("_qty").alias("_qty"))
    inv = inventory.select("id_producto", F.col("stock_actual").alias("_stock"))
    j = req.join(inv, "id_producto", "left")
    if products is not None:
        j = j.join(products.select("id_producto", F.col("nombre").alias("_name")), "id_producto", "left")
        name = F.coalesce("_name", F.lit("Producto"))
    else:
        name = F.lit("Producto")
    avail = F.coalesce("_stock", F.lit(0))
    checked = F.col("id_producto").isNotNull() & (F.col("id_producto") != 0)
    ok = ~checked | (avail >= F.col("_qty"))
    msg = F.when(~ok, F.concat(F.lit('"'), name, F.lit('" no tiene stock suficiente. Disponible: '),
                               avail.cast("string")))
    cols = [c for c in req.columns if c != "_qty"]
    return j.select(*cols, F.col("_qty").alias("cantidad_pedida"), avail.alias("disponible"),
                    ok.alias("ok"), msg.alias("mensaje"))


def _clamped_deduction(inventory: DataFrame, lines: DataFrame) -> DataFrame:
    """Stock after deducting the summed quantities, never below 0 (SQLite
    ``MAX(0, stock - q)``: a NULL stock stays NULL). Products without a stock
    row are not touched. Returns (id_producto, stock_antes, descontado, stock_despues)."""
    used = lines.filter(F.col("id_producto").isNotNull()).groupBy("id_producto").agg(
        F.sum("cantidad").alias("descontado"))
    j = inventory.select("id_producto", F.col("stock_actual").alias("stock_antes")).join(used, "id_producto", "inner")
    return j.select("id_producto", "stock_antes", F.col("descontado").cast("long").alias("descontado"),
                    money.clamp_at_zero(F.col("stock_antes") - F.col("descontado")).cast("long")
                    .alias("stock_despues"))


def verify_orders(ctx, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verify payment of the given orders.

    Orders in 'Pendiente de Verificación' (or whose state has no row, as the
    reference's guard lets NULL through) move to 'Procesando' and their lines
    reduce stock (clamped at 0); other orders are rejected. Lines with a
    negative quantity are rejected instead of adding stock. Sequential
    clamping equals clamping the sum because all deductions are >= 0.
    Returns (orders with decision, new stock rows).
    """
    states = ctx.dim("estados_pedido")
    pending_ids = states.filter(F.col("nombre") == PENDING_STATE).select("id_estado").distinct()
    processing = states.filter(F.col("nombre") == PROCESSING_STATE).select(F.max("id_estado")).scalar()
    p = ctx["pedidos"].join(ids.select("id_pedido").distinct(), "id_pedido", "left_semi")
    p = p.join(states.select("id_estado", F.col("nombre").alias("_estado")), "id_estado", "left")
    p = p.join(pending_ids.withColumn("_pending", F.lit(True)), "id_estado", "left")
    accept = F.col("_estado").isNull() | F.col("_pending").isNotNull()
    decided = p.select("id_pedido", F.col("id_estado").alias("estado_antes"),
                       F.when(accept, F.coalesce(processing, F.col("id_estado"))).otherwise(F.col("id_estado"))
                       .alias("estado_despues"), accept.alias("aceptado"))
    ok_orders = decided.filter("aceptado").select("id_pedido")
    lines = ctx["detalle_pedidos"].join(ok_orders, "id_pedido", "left_semi").filter(F.col("cantidad") >= 0)
    return decided, _clamped_deduction(ctx["inventario"], lines)


def apply_status_updates(ctx, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id_pedido, estado name, tracking, empresa_envio, ts) updates.

    The latest update per order wins. A state name that does not exist is
    rejected. With a tracking number, every shipment of the order gets it,
    with the carrier and shipment state 'Enviado'.
    Returns (orders: id_pedido, estado_antes, estado_despues, aplicado;
    shipments: the new shipment snapshot rows of updated orders).
    """
    last = updates.groupBy("id_pedido").agg(
        F.max_by(F.struct("estado", "tracking", "empresa_envio"), "ts").alias("u"))
    last = last.select("id_pedido", "u.*")
    states = ctx.dim("estados_pedido").select(F.col("nombre").alias("estado"), F.col("id_estado").alias("_nuevo"))
    u = last.join(states, "estado", "left")
    p = ctx["pedidos"].select("id_pedido", "id_estado").join(u, "id_pedido", "inner")
    applied = F.col("_nuevo").isNotNull()
    orders_out = p.select("id_pedido", F.col("id_estado").alias("estado_antes"),
                          F.when(applied, F.col("_nuevo")).otherwise(F.col("id_estado")).alias("estado_despues"),
                          applied.alias("aplicado"))
    track = u.filter(applied & F.col("tracking").isNotNull() & (F.col("tracking") != "")) \
        .select("id_pedido", "tracking", F.col("empresa_envio").alias("_empresa"))
    ships = ctx["envios"].join(track, "id_pedido", "inner").select(
        "id_envio", "id_pedido", F.col("tracking").alias("numero_guia"),
        F.coalesce("_empresa", F.lit("")).alias("empresa_envio"), F.lit(SHIPPED).alias("estado_envio"))
    return orders_out, ships


def status_updates_from_orders(ctx) -> DataFrame:
    """Updates for every order: the next state in the cycle; orders whose key
    is a multiple of 27 ask for an unknown state; moves to 'Enviado' carry a
    tracking number."""
    p = ctx["pedidos"]
    names = F.array(*[F.lit(n) for n in ("Pendiente de Verificación", "Procesando", "Enviado", "Entregado")])
    nxt = F.element_at(names, (F.pmod(F.col("id_estado"), F.lit(4)) + 1).cast("int"))
    estado = F.when(F.pmod("id_pedido", F.lit(27)) == 0, F.lit("Cancelado")).otherwise(nxt)
    return p.select("id_pedido", estado.alias("estado"),
                    F.when(estado == SHIPPED, F.concat(F.lit("T"), F.col("id_pedido").cast("string")))
                    .alias("tracking"),
                    F.lit("MRW").alias("empresa_envio"), F.col("fecha").alias("ts"))


def missing_shipments(ctx, as_of: str = "1998-08-02 00:00:00") -> DataFrame:
    """One default shipment per order without any (anti join, NULL-safe)."""
    p = ctx["pedidos"].select("id_pedido").join(ctx["envios"].select("id_pedido"), "id_pedido", "left_anti")
    return p.select("id_pedido", F.lit("").alias("direccion_envio"), F.lit("Pendiente").alias("empresa_envio"),
                    F.lit("").alias("numero_guia"), F.lit("Pendiente").alias("estado_envio"),
                    F.lit(as_of).cast("timestamp_ntz").alias("fecha_envio"), F.lit("").alias("metodo_pago"),
                    F.lit("").alias("referencia_pago"), F.lit("destino").alias("tipo_envio"))


def carrier_label(tipo: Column) -> Column:
    out = F.lit("Pendiente")
    for t, label in reversed(CARRIER_BY_TYPE):
        out = F.when(tipo == t, F.lit(label)).otherwise(out)
    return out


def carrier_labels(ctx) -> DataFrame:
    """Shipments with carrier 'Pendiente' and a type get the text of the type."""
    e = ctx["envios"]
    cond = (F.col("empresa_envio") == "Pendiente") & (F.col("tipo_envio") != "")
    return e.select("id_envio", "id_pedido", "tipo_envio",
                    F.when(cond, carrier_label(F.col("tipo_envio"))).otherwise(F.col("empresa_envio"))
                    .alias("empresa_envio"), cond.alias("cambiado"))


def consolidate_categories(ctx, keep: list[str], default: str) -> tuple[DataFrame, DataFrame]:
    """Products of categories outside ``keep`` go to ``default``; those
    categories are dropped. Products without a category or with a category id
    that has no row are left as they are. Returns (products, categories)."""
    cats = ctx["categorias"]
    old = cats.filter(~F.col("nombre").isin(keep)).select("id_categoria", F.lit(True).alias("_old"))
    default_id = cats.filter(F.col("nombre") == default).select(F.min("id_categoria")).scalar()
    p = ctx["productos"].join(old, "id_categoria", "left")
    moved = F.col("_old").isNotNull() & default_id.isNotNull()
    products = p.select("id_producto", F.col("id_categoria").alias("categoria_antes"),
                        F.when(moved, default_id).otherwise(F.col("id_categoria")).alias("id_categoria"))
    return products, cats.filter(F.col("nombre").isin(keep))


def rename_status(ctx, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Orders in state ``old`` point to ``new`` and ``old`` is dropped,
    only if both states exist. Returns (orders, states)."""
    st = ctx["estados_pedido"]
    old_id = st.filter(F.col("nombre") == old).select(F.min("id_estado")).scalar()
    new_id = st.filter(F.col("nombre") == new).select(F.min("id_estado")).scalar()
    both = old_id.isNotNull() & new_id.isNotNull()
    p = ctx["pedidos"].select("id_pedido", F.col("id_estado").alias("estado_antes"),
                              F.when(both & (F.col("id_estado") == old_id), new_id)
                              .otherwise(F.col("id_estado")).alias("id_estado"))
    states = st.filter(~(both & (F.col("id_estado") == old_id)))
    return p, states


def delete_products(ctx, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove products with their images and stock rows."""
    k = ids.select("id_producto").distinct()
    return (ctx["productos"].join(k, "id_producto", "left_anti"),
            ctx["imagenes_productos"].join(k, "id_producto", "left_anti"),
            ctx["inventario"].join(k, "id_producto", "left_anti"))


def soft_delete_clients(ctx, ids: DataFrame) -> DataFrame:
    """The given clients become inactive; nothing is removed."""
    k = ids.select("id_cliente").distinct().withColumn("_del", F.lit(True))
    c = ctx["clientes"].join(k, "id_cliente", "left")
    return c.withColumn("activo", F.when(F.col("_del"), F.lit(0)).otherwise(F.col("activo"))).drop("_del")


def upsert_clients(ctx, changes: DataFrame) -> DataFrame:
    """Rows with an id update name, e-mail, phone and address of that
    client if it is active; rows without an id are inserted as 'manual'
    clients with new ids. Rows missing a name or e-mail are ignored (the
    form rejects them). Returns the changed and inserted client rows."""
    valid = changes.filter(F.col("nombre").isNotNull() & (F.col("nombre") != "")
                           & F.col("correo").isNotNull() & (F.col("correo") != ""))
    upd = valid.filter(F.col("id_cliente").isNotNull()).groupBy("id_cliente").agg(
        F.max_by(F.struct("nombre", "correo", "telefono", "direccion"), "ts").alias("n"))
    c = ctx["clientes"]
    j = c.join(upd, "id_cliente", "inner").filter(F.col("activo") == 1)
    updated = j.select("id_cliente", F.col("n.nombre").alias("nombre"), F.col("n.correo").alias("correo"),
                       F.coalesce("n.telefono", F.lit("")).alias("telefono"),
                       F.coalesce("n.direccion", F.lit("")).alias("direccion"), "activo", "origen",
                       F.lit("actualizado").alias("cambio"))
    ins = valid.filter(F.col("id_cliente").isNull()).drop("id_cliente")
    ins = dense_ids(ins, ["ts", "correo"], next_id_base(c, "id_cliente"), "id_cliente")
    inserted = ins.select("id_cliente", "nombre", "correo", F.coalesce("telefono", F.lit("")).alias("telefono"),
                          F.coalesce("direccion", F.lit("")).alias("direccion"), F.lit(1).alias("activo"),
                          F.lit("manual").alias("origen"), F.lit("nuevo").alias("cambio"))
    return updated.unionByName(inserted)


def upsert_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    """The single configuration row after a stream of changes
    (ts, iva, usd, eur). Rate changes need usd > 0 (a missing eur becomes 0);
    the latest accepted change of each field wins; no row yet -> inserted."""
    rates = changes.filter(F.col("usd").isNotNull() & (F.col("usd") > 0))
    vat = changes.filter(F.col("iva").isNotNull())
    r = rates.agg(F.max_by(F.struct(F.col("usd"), F.coalesce("eur", F.lit(0)).alias("eur")), "ts").alias("r"))
    v = vat.agg(F.max_by("iva", "ts").alias("iva"))
    old = config.agg(F.max("iva_default").alias("o_iva"), F.max("tasa_usd").alias("o_usd"),
                     F.max("tasa_eur").alias("o_eur"))
    row = old.select(
        F.coalesce(v.select("iva").scalar().cast("decimal(5,2)"), F.col("o_iva"),
                   F.lit(money.DEFAULT_VAT).cast("decimal(5,2)")).cast("double").alias("iva_default"),
        F.coalesce(r.select("r.usd").scalar().cast(money.RATE), F.col("o_usd")).cast("double").alias("tasa_usd"),
        F.coalesce(r.select("r.eur").scalar().cast(money.RATE), F.col("o_eur")).cast("double").alias("tasa_eur"))
    return row


def config_changes_from_rates(ctx) -> DataFrame:
    """Rate history as change events: each month's rate as USD, EUR = 1.1 x
    USD except every third month (missing), a zero rate every fifth month
    (rejected), VAT changes in January."""
    r = ctx["tasas_cambio"]
    m = F.month("fecha") + F.year("fecha") * 12
    return r.select(
        F.col("fecha").alias("ts"),
        F.when(F.month("fecha") == 1, F.lit(12) + F.pmod(F.year("fecha"), F.lit(5))).cast("decimal(5,2)").alias("iva"),
        F.when(F.pmod(m, F.lit(5)) == 0, F.lit(0).cast(money.RATE)).otherwise(F.col("tasa")).alias("usd"),
        F.when(F.pmod(m, F.lit(3)) == 0, F.lit(None)).otherwise(F.round(F.col("tasa") * F.lit("1.1").cast("decimal(2,1)"), 4))
        .cast(money.RATE).alias("eur"))


# ---------------------------------------------------------------- products
def upsert_products(ctx, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Create / update products from admin form rows
    (id_producto or NULL, nombre, categoria name, precio, stock, imagen, descripcion, ts).

    The category is found by name or created (new ids after the maximum);
    updates set name, description, price and category, stock is set (or the
    row inserted) and an image replaces the product's images; creations get
    cost = price, a stock row and the image if given. Rows missing name,
    category or price, and updates without stock, are ignored (the form
    rejects them). Of several valid updates of a product the latest by ``ts``
    wins (then the largest row, so ties are settled); its image is that of the
    latest valid update that has one.
    Returns (products changed/created, new categories, stock rows, image rows).
    """
    valid = changes.filter(F.col("nombre").isNotNull() & (F.col("nombre") != "")
                           & F.col("categoria").isNotNull() & (F.col("categoria") != "")
                           & F.col("precio").isNotNull()
                           & (F.col("id_producto").isNull() | F.col("stock").isNotNull()))
    cats = ctx["categorias"]
    from vitrina.operators.catalog import missing_reference_rows
    new_cats = missing_reference_rows(valid.select(F.col("categoria").alias("nombre")), cats,
                                      "nombre", "id_categoria")
    all_cats = cats.unionByName(new_cats).select(F.col("nombre").alias("categoria"), "id_categoria")
    v = valid.join(all_cats, "categoria", "left")
    prods = ctx["productos"]
    fields = F.struct("ts", "nombre", "precio", "stock", "descripcion", "id_categoria")
    image = F.when(F.col("imagen") != "", F.struct("ts", "imagen"))
    upd = v.filter(F.col("id_producto").isNotNull()).groupBy("id_producto").agg(
        F.max(fields).alias("u"), F.max(image).alias("i"))
    upd = upd.select("id_producto", "u.*", F.col("i.imagen").alias("imagen")).join(
        prods.select("id_producto", "costo", "activo"), "id_producto", "inner")
    ins = v.filter(F.col("id_producto").isNull()).drop("id_producto")
    ins = dense_ids(ins, ["ts", "nombre", "precio"], next_id_base(prods, "id_producto"), "id_producto")
    price = F.col("precio").cast(DEC)
    updated = upd.select("id_producto", "nombre", F.coalesce("descripcion", F.lit("")).alias("descripcion"),
                         "costo", price.alias("precio_venta"), "id_categoria", "activo",
                         F.lit("actualizado").alias("cambio"), "stock", "imagen")
    created = ins.select("id_producto", "nombre", F.coalesce("descripcion", F.lit("")).alias("descripcion"),
                         price.alias("costo"), price.alias("precio_venta"), "id_categoria",
                         F.lit(1).alias("activo"), F.lit("nuevo").alias("cambio"),
                         F.coalesce("stock", F.lit(0)).alias("stock"), "imagen")
    both = updated.unionByName(created)
    products = both.drop("stock", "imagen")
    stock = both.filter(F.col("stock").isNotNull()).select("id_producto", F.col("stock").cast("int").alias("stock_actual"))
    images = both.filter(F.col("imagen").isNotNull() & (F.col("imagen") != "")) \
        .select("id_producto", F.col("imagen").alias("ruta_imagen"))
    return products, new_cats, stock, images


def product_changes_from_data(ctx) -> DataFrame:
    """Admin form rows derived from the tables: every product is edited (price
    +5 %, stock = size + 10, category renamed to lower case so new categories
    appear, image set for every 4th), every 5th is edited again a day later
    (price +10 %, no image; every 35th of these without stock, which is
    rejected), and every supplier becomes a new custom product."""
    p = ctx["productos"].join(ctx["categorias"].select("id_categoria", F.col("nombre").alias("cat")),
                              "id_categoria", "left").join(
        ctx["inventario"].select("id_producto", "stock_actual"), "id_producto", "left")
    edits = p.select("id_producto", "nombre", F.lower(F.coalesce("cat", F.lit("varios"))).alias("categoria"),
                     F.round(F.col("precio_venta") * F.lit("1.05").cast("decimal(3,2)"), 2).cast(DEC).alias("precio"),
                     (F.coalesce("stock_actual", F.lit(0)) + 10).alias("stock"),
                     F.when(F.pmod("id_producto", F.lit(4)) == 0,
                            F.concat(F.lit("nuevo_"), F.col("id_producto").cast("string"), F.lit(".png")))
                     .alias("imagen"), "descripcion", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    again = p.filter(F.pmod("id_producto", F.lit(5)) == 0).select(
        "id_producto", F.concat("nombre", F.lit(" II")).alias("nombre"), F.lit("varios").alias("categoria"),
        F.round(F.col("precio_venta") * F.lit("1.10").cast("decimal(3,2)"), 2).cast(DEC).alias("precio"),
        F.when(F.pmod("id_producto", F.lit(35)) != 0, F.lit(3)).alias("stock"),
        F.lit(None).cast("string").alias("imagen"), "descripcion",
        F.lit("1998-01-02 00:00:00").cast("timestamp_ntz").alias("ts"))
    s = ctx.raw("supplier")
    news = s.select(F.lit(None).cast("long").alias("id_producto"),
                    F.concat(F.lit("Producto "), F.col("s_name")).alias("nombre"),
                    F.lit(CUSTOM_CATEGORY).alias("categoria"),
                    F.abs(F.col("s_acctbal")).cast(DEC).alias("precio"),
                    F.lit(None).cast("int").alias("stock"), F.lit(None).cast("string").alias("imagen"),
                    F.lit("Producto personalizado").alias("descripcion"),
                    F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    return edits.unionByName(again).unionByName(news)


# ---------------------------------------------------------------- sales paths
def _cart_headers(lines: DataFrame, rate: Column) -> DataFrame:
    amount = (F.coalesce("precio_unitario", F.lit(0).cast(DEC))
              * F.coalesce("cantidad", F.lit(1)).cast("decimal(10,0)"))
    h = lines.groupBy("id_carrito").agg(F.sum(amount).cast(DEC).alias("subtotal"),
                                        F.count(F.lit(1)).alias("lineas"))
    h = h.withColumn("iva_pct", rate).withColumn("impuesto", money.vat_amount("subtotal", "iva_pct"))
    return h.withColumn("total", F.round(F.col("subtotal") + F.col("impuesto"), 2).cast(DEC))


def _custom_category(ctx) -> tuple[Column, DataFrame]:
    """Id of the category of custom products, and the row to insert if the
    category is missing (no row otherwise)."""
    row = ctx["categorias"].agg(F.min(F.when(F.col("nombre") == CUSTOM_CATEGORY, F.col("id_categoria"))).alias("f"),
                                (F.coalesce(F.max("id_categoria"), F.lit(0)) + 1).alias("n"))
    new = row.filter(F.col("f").isNull()).select(F.col("n").alias("id_categoria"), F.lit(CUSTOM_CATEGORY).alias("nombre"))
    return row.select(F.coalesce("f", "n")).scalar(), new


def checkout_forms_from_users(ctx) -> DataFrame:
    """A checkout form per user: the three shipment types in turn, every 4th
    user with an e-mail no client has, every 9th without a name (rejected)."""
    u = ctx["usuarios"]
    k = F.col("id_usuario")
    text = k.cast("string")
    return u.select(
        k.alias("id_carrito"), F.when(F.pmod(k, F.lit(9)) != 0, F.col("nombre")).otherwise(F.lit("")).alias("nombre"),
        F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("web"), text, F.lit("@mail.com"))).otherwise(F.col("correo")).alias("correo"),
        F.concat(F.lit("0416-"), text).alias("telefono"), F.concat(F.lit("V-"), text).alias("cedula"),
        F.element_at(F.array(*map(F.lit, ("destino", "tienda", "agencia"))), (F.pmod(k, F.lit(3)) + 1).cast("int")).alias("tipo_envio"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit("MRW")).otherwise(F.lit("")).alias("empresa_envio"),
        F.concat(F.lit("A"), text).alias("codigo_agencia"), F.lit("Caracas").alias("ciudad"), F.lit("").alias("estado"),
        F.lit("Zelle").alias("metodo_pago"), F.concat(F.lit("R"), text).alias("referencia"))


def checkout(ctx, carts: DataFrame, forms: DataFrame | None = None, vat: Column | None = None,
             as_of: str = "1998-08-02 00:00:00") -> Frames:
    """Carts and their checkout forms -> all rows the shop writes.

    ``forms`` holds one row per cart: (id_carrito, nombre, correo, telefono,
    cedula, tipo_envio, empresa_envio, codigo_agencia, ciudad, estado,
    metodo_pago, referencia); without it the cart owner's name and e-mail and
    home delivery are used. A cart with any short line (O63, per line), or
    without a form that names the buyer, is rejected as a whole. Accepted
    carts are taken in cart order: order and sale ids follow the current
    maxima, and clients are matched or created as O29 does.

    Totals follow the shop's API route: header amounts use the quantity as
    given (NULL counts as 1, 0 as 0), lines store max(1, quantity). Every
    custom line (no product id) creates one product, named after its id so
    that names stay unique, and used by the order line and the sale line (the
    reference creates one for each).

    Frames: orders, order_lines, shipments, sales, sale_lines, invoices,
    clients (new and updated rows), products, categories (new rows), summary,
    rejected. They read three shared tables, each made once and only if a frame
    that is asked for needs it: the accepted carts with their numbers, the
    matched clients, and the numbers of custom products.
    """
    from vitrina.operators.orders import client_writes, match_or_create_clients
    from vitrina.operators.sales import current_vat
    rate = current_vat(ctx) if vat is None else vat
    if forms is None:
        blank = {c: F.lit("") for c in ("telefono", "cedula", "empresa_envio", "codigo_agencia", "ciudad", "estado", "referencia")}
        forms = ctx["usuarios"].select(F.col("id_usuario").alias("id_carrito"), "nombre", "correo").withColumns(
            blank | {"tipo_envio": F.lit("destino"), "metodo_pago": F.lit("Pendiente")})
    named = forms.filter(F.col("nombre") != "")
    address = text.shipping_address("tipo_envio", "empresa_envio", "codigo_agencia", "ciudad", "estado")

    @cache
    def heads() -> DataFrame:  # accepted carts
        short = stock_check(carts, ctx["inventario"], ctx["productos"]).filter(~F.col("ok")).select("id_carrito")
        good = carts.join(short.distinct(), "id_carrito", "left_anti").join(named.select("id_carrito"), "id_carrito", "left_semi")
        base = next_id_base(ctx["pedidos"], "id_pedido")
        numbered = dense_ids(_cart_headers(good, rate), ["id_carrito"], base, "id_pedido")
        return numbered.withColumn("id_venta", next_id_base(ctx["ventas"], "id_venta") + (F.col("id_pedido") - base))

    @cache
    def form() -> DataFrame:
        return named.join(heads().select("id_carrito"), "id_carrito", "left_semi").withColumn("direccion", address)

    @cache
    def incoming() -> DataFrame:
        return form().select(F.col("id_carrito").alias("key"), "nombre", "correo", "direccion", "telefono", "cedula")

    @cache
    def matched() -> DataFrame:
        return match_or_create_clients(incoming(), ctx["clientes"]).checkpoint(eager=True)

    @cache
    def with_clients() -> DataFrame:
        return heads().join(matched().select(F.col("key").alias("id_carrito"), "id_cliente"), "id_carrito", "left")

    @cache
    def custom() -> DataFrame:  # lines that become products
        rows = carts.filter(F.col("id_producto").isNull() | (F.col("id_producto") == 0)).join(heads().select("id_carrito"), "id_carrito", "left_semi")
        return dense_ids(rows.select("id_carrito", "id_detalle"), ["id_carrito", "id_detalle"],
                         next_id_base(ctx["productos"], "id_producto"), "_custom_id")

    @cache
    def lines() -> DataFrame:
        rows = carts.join(heads().select("id_carrito", "id_pedido", "id_venta"), "id_carrito").join(custom(), ["id_carrito", "id_detalle"], "left")
        return rows.select(
            "id_pedido", "id_venta", "id_detalle", F.coalesce("_custom_id", "id_producto").alias("id_producto"),
            F.greatest(F.lit(1), F.coalesce("cantidad", F.lit(1))).alias("cantidad"),
            F.coalesce("precio_unitario", F.lit(0).cast(DEC)).alias("precio_unitario"))

    def orders() -> DataFrame:
        state = ctx["estados_pedido"].filter(F.col("nombre") == PENDING_STATE).select(F.min("id_estado")).scalar()
        return with_clients().select("id_pedido", "id_cliente", F.coalesce(state, F.lit(1)).cast("long").alias("id_estado"), "total")

    def shipments() -> DataFrame:
        return heads().select("id_carrito", "id_pedido").join(form(), "id_carrito", "inner").select(
            "id_pedido", F.col("direccion").alias("direccion_envio"),
            text.shipping_label("tipo_envio", "empresa_envio").alias("empresa_envio"), F.lit("").alias("numero_guia"),
            F.lit("Pendiente").alias("estado_envio"), F.lit(as_of).cast("timestamp_ntz").alias("fecha_envio"),
            "metodo_pago", F.coalesce("referencia", F.lit("")).alias("referencia_pago"), "tipo_envio")

    def products() -> DataFrame:
        price = F.lit(CUSTOM_PRICE).cast(DEC)
        return custom().select(
            F.col("_custom_id").alias("id_producto"),
            F.concat(F.lit(f"{CUSTOM_NAME} - "), F.col("_custom_id").cast("string")).alias("nombre"),
            F.lit(CUSTOM_TEXT).alias("descripcion"), price.alias("costo"), price.alias("precio_venta"),
            _custom_category(ctx)[0].alias("id_categoria"), F.lit(1).alias("activo"))

    def summary() -> DataFrame:
        return with_clients().select("id_carrito", "id_pedido", "id_venta", "id_cliente", "lineas",
                                     to_money("subtotal").alias("subtotal"), to_money("impuesto").alias("impuesto"),
                                     to_money("total").alias("total"))

    return Frames(
        orders=orders, order_lines=lambda: lines().drop("id_venta"), shipments=shipments,
        sales=lambda: with_clients().select("id_venta", "id_cliente", "total"), sale_lines=lambda: lines().drop("id_pedido"),
        invoices=lambda: _invoices(heads()), clients=lambda: client_writes(incoming(), matched(), ctx["clientes"]),
        products=products, categories=lambda: _custom_category(ctx)[1], summary=summary,
        rejected=lambda: carts.select("id_carrito").distinct().join(heads().select("id_carrito"), "id_carrito", "left_anti"))


def _invoices(heads: DataFrame) -> DataFrame:
    return heads.select("id_venta", "subtotal", F.col("iva_pct").alias("porcentaje_iva"), "impuesto",
                        F.col("total").alias("total_usd"))


def _counter_rejections(carts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Carts that a counter refuses when it serves them in cart order: a cart is
    refused if one of its lines needs more than earlier accepted carts left.
    Quantities below 0 take nothing from the stock; lines without a cart are
    neither served nor refused."""
    q = F.coalesce("cantidad", F.lit(1)).cast("long")
    wants = carts.filter(F.col("id_producto").isNotNull() & (F.col("id_producto") != 0)).groupBy(
        F.col("id_carrito").alias("order"), F.col("id_producto").alias("item")).agg(
        F.max(q).alias("need"), F.sum(F.greatest(q, F.lit(0))).alias("used"))
    stock = inventory.select(F.col("id_producto").alias("item"), F.col("stock_actual").alias("stock"))
    return refused_in_order(wants.join(stock, "item", "left")).select(F.col("order").alias("id_carrito")).checkpoint(eager=True)


def physical_sales(ctx, carts: DataFrame, vat: Column | None = None) -> Frames:
    """Counter sale per cart, served in cart order: sale, lines, invoice
    and stock reduced at once (clamped at 0). A cart with a line that needs
    more than earlier sales left is refused as a whole. Lines are checked one
    by one, so two lines of one cart may take a product to 0 together.

    Frames: summary (one sale per row), sale_lines, invoices, stock, rejected;
    the rejections and the sale numbers are made once, for the frames that need them."""
    from vitrina.operators.sales import current_vat
    ensure_checkpoint_dir(carts.sparkSession)
    rate = current_vat(ctx) if vat is None else vat

    @cache
    def bad() -> DataFrame:
        return _counter_rejections(carts, ctx["inventario"])

    @cache
    def good() -> DataFrame:
        return carts.join(bad(), "id_carrito", "left_anti")

    @cache
    def heads() -> DataFrame:
        return dense_ids(_cart_headers(good(), rate), ["id_carrito"], next_id_base(ctx["ventas"], "id_venta"), "id_venta")

    def stock() -> DataFrame:
        used = good().filter(F.col("id_producto").isNotNull() & (F.col("id_producto") != 0)).select(
            "id_producto", F.greatest(F.lit(0), F.coalesce("cantidad", F.lit(1))).alias("cantidad"))
        return _clamped_deduction(ctx["inventario"], used)

    def sale_lines() -> DataFrame:
        return good().join(heads().select("id_carrito", "id_venta"), "id_carrito").select(
            "id_venta", "id_detalle", "id_producto", F.coalesce("cantidad", F.lit(1)).alias("cantidad"),
            F.coalesce("precio_unitario", F.lit(0).cast(DEC)).alias("precio_unitario"))

    def summary() -> DataFrame:
        return heads().select("id_carrito", "id_venta", "lineas", to_money("subtotal").alias("subtotal"),
                              to_money("impuesto").alias("impuesto"), to_money("total").alias("total"))

    return Frames(summary=summary, sale_lines=sale_lines, invoices=lambda: _invoices(heads()), stock=stock, rejected=bad)
