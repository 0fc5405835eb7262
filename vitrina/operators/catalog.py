"""Catalogue, inventory and directory listings.

Every listing is a chain of equi joins against tables keyed by product /
category / client id. ``first_image`` reduces the image table to one row per
product with a partial ``min_by`` aggregate before any join, so the joins that
follow are 1:1 and no row multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.ids import dense_ids, next_id_base
from vitrina.functions.money import to_money

# Display defaults and sort options of the catalogue pages.
PLACEHOLDER_IMAGE = "placeholder.png"
DEFAULT_CATEGORY_CARD = "General"
NO_CATEGORY = "Sin categoría"
LOW_STOCK_PREFIX = "Stock bajo: "
SORTS = ("newest", "price_asc", "price_desc", "name_asc")
# Category names in the order the catalogue filter shows them.
CATEGORY_DISPLAY_ORDER = ["camisas", "tazas", "gorras", "llaveros", "Termos", "Mousepads", "Boligrafos"]


def _or_default(c: Column, default) -> Column:
    """Python ``x or default`` on text: NULL and '' both take the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def like_pattern(q: str) -> str:
    """'%q%' for ILIKE; a backslash (Spark's escape) is taken literally."""
    return "%" + q.replace("\\", "\\\\") + "%"


def first_image(ctx) -> DataFrame:
    """Per product, the image with the lowest image id."""
    return ctx["imagenes_productos"].groupBy("id_producto").agg(
        F.min_by("ruta_imagen", "id_imagen").alias("ruta_imagen"))


def _products_with_category(ctx) -> DataFrame:
    cats = ctx.dim("categorias").select("id_categoria", F.col("nombre").alias("categoria"))
    return ctx["productos"].join(cats, "id_categoria", "left")


def catalog_search(ctx, category: str | None = None, q: str | None = None,
                   sort: str = "newest", limit: int | None = None) -> DataFrame:
    """Active products with a category, optional category name and text
    search, one of four sorts (unknown sort = newest), optional limit."""
    p = _products_with_category(ctx).filter((F.col("activo") == 1) & F.col("id_categoria").isNotNull())
    if category:
        p = p.filter(F.col("categoria") == category)
    if q:
        pat = like_pattern(q)
        p = p.filter(F.col("nombre").ilike(pat) | F.col("descripcion").ilike(pat))
    p = p.join(first_image(ctx), "id_producto", "left")
    out = p.select("id_producto", "nombre", "descripcion",
                   to_money("precio_venta").alias("precio_venta"), "categoria",
                   F.coalesce("ruta_imagen", F.lit(PLACEHOLDER_IMAGE)).alias("ruta_imagen"))
    if sort == "price_asc":
        order = [F.asc_nulls_first("precio_venta"), F.asc("id_producto")]
    elif sort == "price_desc":
        order = [F.desc_nulls_last("precio_venta"), F.asc("id_producto")]
    elif sort == "name_asc":
        order = [F.asc_nulls_first("nombre"), F.asc("id_producto")]
    else:
        order = [F.desc("id_producto")]
    out = out.orderBy(*order)
    if limit:
        out = out.limit(limit)
    return out


def product_cards(df: DataFrame, stock: DataFrame | None = None) -> DataFrame:
    """Display defaults over catalogue rows; stock from ``stock`` if given."""
    out = df.select(
        F.col("id_producto").alias("id"),
        F.col("nombre").alias("name"),
        _or_default(F.col("categoria"), DEFAULT_CATEGORY_CARD).alias("category"),
        F.col("precio_venta").cast("double").alias("price"),
        _or_default(F.col("ruta_imagen"), PLACEHOLDER_IMAGE).alias("image_url"),
        F.coalesce(F.col("descripcion"), F.lit("")).alias("description"),
    )
    if stock is not None:
        s = stock.select(F.col("id_producto").alias("id"), "stock_actual")
        out = (out.join(s, "id", "left")
               .withColumn("stock", F.coalesce("stock_actual", F.lit(0))).drop("stock_actual"))
    return out


def product_detail(ctx) -> DataFrame:
    """Every active product with category, first image, stock (0 if none)."""
    p = (_products_with_category(ctx).filter(F.col("activo") == 1)
         .join(first_image(ctx), "id_producto", "left")
         .join(ctx["inventario"].select("id_producto", "stock_actual"), "id_producto", "left"))
    return p.select("id_producto", "nombre", "descripcion",
                    to_money("precio_venta").alias("precio_venta"), "categoria",
                    F.coalesce("ruta_imagen", F.lit(PLACEHOLDER_IMAGE)).alias("ruta_imagen"),
                    F.coalesce("stock_actual", F.lit(0)).alias("stock"))


def product_admin_detail(ctx) -> DataFrame:
    """As O12 for all products (active or not); no image -> ''."""
    p = (_products_with_category(ctx)
         .join(first_image(ctx), "id_producto", "left")
         .join(ctx["inventario"].select("id_producto", "stock_actual"), "id_producto", "left"))
    return p.select("id_producto", "nombre", "descripcion",
                    to_money("precio_venta").alias("precio"), "categoria",
                    F.coalesce("stock_actual", F.lit(0)).alias("stock"),
                    F.coalesce("ruta_imagen", F.lit("")).alias("imagen"))


def inventory_list(ctx) -> DataFrame:
    """Active products with price, stock (0 if none) and category."""
    p = (_products_with_category(ctx).filter(F.col("activo") == 1)
         .join(ctx["inventario"].select("id_producto", "stock_actual"), "id_producto", "left"))
    return (p.select("id_producto", "nombre", to_money("precio_venta").alias("precio"),
                     F.coalesce("stock_actual", F.lit(0)).alias("stock"),
                     F.coalesce("categoria", F.lit(NO_CATEGORY)).alias("categoria"))
            .orderBy(F.asc_nulls_first("nombre"), F.asc("id_producto")))


def low_stock_items(ctx, threshold: int = 5) -> DataFrame:
    """Inventory rows with stock <= threshold and their alert text."""
    inv = inventory_list(ctx).filter(F.col("stock") <= threshold)
    return inv.select("id_producto", "nombre", "stock",
                      F.concat(F.lit(LOW_STOCK_PREFIX), F.col("nombre")).alias("mensaje"))


def client_directory(ctx, limit: int = 20) -> DataFrame:
    """Active clients entered by hand, by name, first ``limit``."""
    c = ctx["clientes"].filter((F.col("activo") == 1) & (F.col("origen") == "manual"))
    return (c.select("id_cliente", "nombre", "telefono", "correo", "direccion",
                     F.upper(F.substring("nombre", 1, 1)).alias("inicial"))
            .orderBy(F.asc_nulls_first("nombre"), F.asc("id_cliente"))
            .limit(limit))


def sales_picker(ctx, limit: int = 20) -> DataFrame:
    """The counter-sale pickers: first ``limit`` active products (stock 0
    if none) and first ``limit`` manual clients, as tagged rows."""
    prods = (ctx["productos"].filter(F.col("activo") == 1)
             .join(ctx["inventario"].select("id_producto", "stock_actual"), "id_producto", "left")
             .select(F.lit("producto").alias("tipo"), F.col("id_producto").alias("id"), "nombre",
                     to_money("precio_venta").alias("precio"),
                     F.coalesce("stock_actual", F.lit(0)).alias("stock"))
             .orderBy(F.asc_nulls_first("nombre"), F.asc("id")).limit(limit))
    clients = (ctx["clientes"].filter((F.col("activo") == 1) & (F.col("origen") == "manual"))
               .select(F.lit("cliente").alias("tipo"), F.col("id_cliente").alias("id"), "nombre",
                       F.lit(None).cast("double").alias("precio"), F.lit(None).cast("int").alias("stock"))
               .orderBy(F.asc_nulls_first("nombre"), F.asc("id")).limit(limit))
    return prods.unionByName(clients)


def valid_and_rejected(df: DataFrame, required: list[str], allow_zero: tuple[str, ...] = ()) -> DataFrame:
    """Tag each row with the first missing required field (NULL or '',
    Python's falsy text; '  ' counts as given); ``reason`` is NULL for valid
    rows. Fields in ``allow_zero`` are rejected only when NULL (a price of 0
    passes)."""
    reason = F.lit(None).cast("string")
    for name in reversed(required):
        c = F.col(name)
        if name in allow_zero or dict(df.dtypes)[name] != "string":
            missing = c.isNull()
        else:
            missing = c.isNull() | (c == "")
        reason = F.when(missing, F.lit(f"falta {name}")).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("valido", F.col("reason").isNull())


def product_form_check(ctx) -> DataFrame:
    """O18 over the product table seen as admin form input (name, price, category)."""
    p = ctx["productos"].select("id_producto", "nombre", "precio_venta", "id_categoria")
    return valid_and_rejected(p, ["nombre", "precio_venta", "id_categoria"], allow_zero=("precio_venta",)) \
        .select("id_producto", "reason", "valido")


# Shipment types that need an agency and an address.
ADDRESSED_TYPES = ("destino", "agencia")
AGENCY_FIELDS = ("empresa_envio", "codigo_agencia", "ciudad", "estado")


def checkout_form_check(forms: DataFrame) -> DataFrame:
    """O18 for checkout forms, whose required fields depend on the shipment type:
    a type must be chosen, and home or agency delivery needs the company, the
    agency code, the city and the state. All but the company are trimmed first,
    so blanks do not count there. ``reason`` names the first missing field."""
    needs = F.col("tipo_envio").isin(*ADDRESSED_TYPES)
    empty = F.lit(None).cast("string")
    for name in reversed(AGENCY_FIELDS):
        given = F.coalesce(F.col(name) if name == "empresa_envio" else F.trim(F.col(name)), F.lit(""))
        empty = F.when(given == "", F.lit(f"falta {name}")).otherwise(empty)
    chosen = F.coalesce("tipo_envio", F.lit("")) != ""
    reason = F.when(~chosen, F.lit("falta tipo_envio")).when(needs, empty)
    return forms.withColumn("reason", reason).withColumn("valido", F.col("reason").isNull())


def client_form_check(forms: DataFrame) -> DataFrame:
    """O18 for the client forms of the panel: name and e-mail are required."""
    return valid_and_rejected(forms, ["nombre", "correo"])


def signup_form_check(forms: DataFrame) -> DataFrame:
    """O18 for sign-ups: name, e-mail and password are required. Names and
    e-mails already taken are ``registration_conflicts``."""
    return valid_and_rejected(forms, ["nombre", "correo", "clave"])


def forms_from_customers(ctx) -> DataFrame:
    """Every client as a filled form, with gaps that follow from the id."""
    k = F.col("id_cliente")

    def gap(every: int, value: Column, empty: str | None) -> Column:
        return F.when(k % every == 0, F.lit(empty)).otherwise(value)

    text = k.cast("string")
    return ctx["clientes"].select(
        k.alias("id_formulario"), gap(11, F.col("nombre"), None).alias("nombre"), gap(7, F.col("correo"), "").alias("correo"),
        gap(5, F.concat(F.lit("clave"), text), "").alias("clave"),
        F.element_at(F.array(*map(F.lit, ["destino", "agencia", "retiro", ""])), (k % 4 + 1).cast("int")).alias("tipo_envio"),
        gap(9, F.lit("MRW"), None).alias("empresa_envio"), gap(13, F.concat(F.lit("A"), text), "  ").alias("codigo_agencia"),
        gap(6, F.lit("Caracas"), "").alias("ciudad"), gap(10, F.lit("Miranda"), None).alias("estado"))


def registration_conflicts(incoming: DataFrame, users: DataFrame) -> DataFrame:
    """Sign-ups whose name OR e-mail is already taken.

    The OR condition is split into two equi semi joins and a union, so each
    side is a hash / sort-merge join instead of a nested loop.
    """
    by_name = incoming.join(users.select(F.col("nombre")).distinct(), "nombre", "left_semi") \
        .withColumn("motivo", F.lit("nombre"))
    by_mail = incoming.join(users.select(F.col("correo")).distinct(), "correo", "left_semi") \
        .withColumn("motivo", F.lit("correo"))
    both = by_name.unionByName(by_mail)
    keys = [c for c in incoming.columns]
    return both.groupBy(*keys).agg(F.array_sort(F.collect_set("motivo")).alias("motivos")) \
        .select(*keys, F.array_join("motivos", ",").alias("motivos"))


def signups_from_customers(ctx) -> DataFrame:
    """Every customer presented as a sign-up (name, e-mail)."""
    return ctx["clientes"].select(F.col("id_cliente").alias("id_alta"), "nombre", "correo")


def trending(ctx, n: int = 8) -> DataFrame:
    """The newest ``n`` active products (catalogue default sort)."""
    return catalog_search(ctx, limit=n)


def ordered_category_filter(ctx, order: list[str] | None = None) -> DataFrame:
    """Category names present, in the fixed display order."""
    order = order or CATEGORY_DISPLAY_ORDER
    cats = ctx["categorias"].filter(F.col("nombre").isin(order))
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("nombre"))
    return cats.select("id_categoria", "nombre", pos.alias("posicion")).orderBy("posicion", "id_categoria")


def missing_reference_rows(required: DataFrame, existing: DataFrame, key: str = "nombre",
                           id_col: str = "id") -> DataFrame:
    """Required rows (by ``key``) not yet present, appended with new ids
    after the current maximum (numbered in ``key`` order)."""
    missing = required.select(key).distinct().join(existing.select(key), key, "left_anti")
    return dense_ids(missing, [key], next_id_base(existing, id_col), id_col).select(id_col, key)
