"""Sources: fixed-schema table scans, rate feed documents, cart payloads and
catalogue image folders (O01, O04, O05, O06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions.ids import dense_ids, next_id_base
from vitrina.functions.money import DEC
from vitrina.functions.text import product_name_from_file
from vitrina.sources.schema import DRIVER_SCHEMAS, SHOP_SCHEMAS

# Image folders the catalogue import reads, with category and
# price, the accepted extensions and the opening stock of imported products.
IMPORT_FOLDERS = [("boligrafos", "Boligrafos", "3.00"), ("termos", "Termos", "13.00"),
                  ("mousepads", "Mousepads", "7.00")]
IMPORT_EXTENSIONS = [".jpg", ".jpeg", ".png"]
IMPORT_STOCK = 10


# ---------------------------------------------------------------- O01
def table_scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Full scan of a named table with its fixed schema (no inference)."""
    schema = SHOP_SCHEMAS.get(name) or DRIVER_SCHEMAS[name]
    return spark.read.schema(schema).parquet(path)


# ---------------------------------------------------------------- O04
RATE_DOC_SCHEMA = "current struct<usd: double, eur: double>"


def parse_rate_docs(docs: DataFrame, text: str = "doc", ts: str = "ts") -> DataFrame:
    """Rate documents {"current": {"usd": x, "eur": y}} -> the last
    document (by ``ts``) with both rates > 0, as one row (usd, eur, ts)."""
    p = docs.select(F.col(ts).alias("ts"), F.from_json(F.col(text), RATE_DOC_SCHEMA).alias("d"))
    good = p.filter((F.col("d.current.usd") > 0) & (F.col("d.current.eur") > 0))
    return good.agg(F.max_by(F.struct(F.col("d.current.usd").alias("usd"),
                                      F.col("d.current.eur").alias("eur"), "ts"), "ts").alias("r")) \
        .select("r.usd", "r.eur", "r.ts")


def read_rate_feed(spark: SparkSession, path: str) -> DataFrame:
    """O04 over files: each JSON file in ``path`` is one fetched document; its
    modification time orders them."""
    raw = (spark.read.format("binaryFile").load(path)
           .select(F.col("modificationTime").cast("timestamp_ntz").alias("ts"),
                   F.col("content").cast("string").alias("doc")))
    return parse_rate_docs(raw)


def rate_docs_from_table(rates: DataFrame) -> DataFrame:
    """Rate history as fetched documents: USD = the rate, EUR = 1.08 x rate,
    except November documents, whose EUR is 0 (a bad fetch to skip)."""
    eur = F.when(F.month("fecha") == 11, F.lit(0).cast("decimal(12,4)")) \
        .otherwise(F.round(F.col("tasa") * F.lit("1.08").cast("decimal(3,2)"), 4))
    doc = F.to_json(F.struct(F.struct(F.col("tasa").cast("double").alias("usd"),
                                      eur.cast("double").alias("eur")).alias("current")))
    return rates.select(F.col("fecha").alias("ts"), doc.alias("doc"))


# ---------------------------------------------------------------- O05
_INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


class _JsonField:
    """One field of a cart item (a VARIANT), with Python's view of it."""

    def __init__(self, item: Column, name: str):
        path = f"$.{name}"
        self.v = F.try_variant_get(item, path, "variant")
        self.kind = F.schema_of_variant(self.v)
        self.text = F.try_variant_get(item, path, "string")
        self.missing = self.v.isNull()
        self.null = F.is_variant_null(self.v)
        self.is_str = self.kind == "STRING"
        self.is_bool = self.kind == "BOOLEAN"
        self.is_int = self.kind == "BIGINT"

    def truthy(self) -> Column:
        """Python ``bool(v)``: None, 0, 0.0, False and '' are falsy."""
        num = F.try_variant_get(self.v, "$", "double")
        return (~self.missing & ~self.null
                & F.when(self.is_str, self.text != "")
                   .when(self.is_bool, self.text == "true")
                   .otherwise(num != 0))

    def as_int(self) -> Column:
        """Python ``int(v)``: an integer literal in a string, a number
        truncated toward zero, a bool as 0/1; anything else -> NULL (drop)."""
        return (F.when(self.is_str, F.when(self.text.rlike(_INT_TEXT), F.trim(self.text).try_cast("long")))
                .when(self.is_bool, F.when(self.text == "true", F.lit(1)).otherwise(F.lit(0)).cast("long"))
                .when(self.is_int, F.try_variant_get(self.v, "$", "long"))
                .when(~self.null, F.try_variant_get(self.v, "$", "double").try_cast("long")))

    def as_float(self) -> Column:
        """Python ``float(v)``: numeric text in a string, a number, a bool."""
        return (F.when(self.is_str, F.trim(self.text).try_cast("double"))
                .when(self.is_bool, F.when(self.text == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
                .when(~self.null, F.try_variant_get(self.v, "$", "double")))


def parse_cart_payload(payloads: DataFrame, text: str = "payload", owner: str = "id_carrito") -> DataFrame:
    """JSON array of cart items -> one normalised row per item.

    id = ``id`` if truthy else ``id_producto`` (row dropped if that is missing
    or null), as int; quantity = max(1, int(quantity)) with 1 when the key is
    missing; price = float(price) with 0 when missing; rows whose numbers do
    not convert (as Python ``int('3.7')`` or ``float('')`` would fail) are
    dropped, as the reference's ``try``/``continue`` does. Items that are not
    objects, and payloads that are not a JSON array, give no row; ``details`` is
    kept as text (JSON for a nested value). Each payload is
    parsed once into a VARIANT, which keeps JSON strings and numbers apart.
    """
    items = payloads.select(owner, F.posexplode(
        F.try_variant_get(F.try_parse_json(F.col(text)), "$", "array<variant>")).alias("pos", "item"))
    items = items.filter(F.schema_of_variant("item").startswith("OBJECT"))
    item = F.col("item")
    fid, fidp = _JsonField(item, "id"), _JsonField(item, "id_producto")
    fq, fp = _JsonField(item, "quantity"), _JsonField(item, "price")
    use_id = fid.truthy()
    pid = F.when(use_id, fid.as_int()).otherwise(fidp.as_int())
    pid_given = F.when(use_id, F.lit(True)).otherwise(~fidp.missing & ~fidp.null)
    qty = F.when(fq.missing, F.lit(1).cast("long")).otherwise(fq.as_int())
    price = F.when(fp.missing, F.lit(0.0)).otherwise(fp.as_float())
    name = F.coalesce(F.try_variant_get(item, "$.name", "string"), F.lit(""))
    nested = F.try_variant_get(item, "$.details", "variant")
    details = F.coalesce(F.try_variant_get(item, "$.details", "string"), F.when(~F.is_variant_null(nested), F.to_json(nested)), F.lit(""))
    out = items.select(owner, "pos", pid.alias("id"), pid_given.alias("_given"),
                       F.greatest(F.lit(1).cast("long"), qty).alias("quantity"), qty.isNotNull().alias("_q_ok"),
                       price.alias("price"), name.alias("name"), details.alias("details"))
    return out.filter(F.col("_given") & F.col("id").isNotNull() & F.col("_q_ok") & F.col("price").isNotNull()) \
        .drop("_given", "_q_ok")


def cart_payloads_from_events(events: DataFrame) -> DataFrame:
    """One payload per cart event with the edge cases of the cart API made on
    purpose: truncated text, a payload that is no array, an item that is no
    object, a list as quantity, a huge price, id 0 or null (id_producto used), both ids missing,
    quantities 'x', '3.7', -2, 0, 3.7 and "4", prices '' and "12.50"."""
    e = F.col("id_detalle")
    k = F.col("id_producto").cast("string")

    def mod(n):
        return F.pmod(e, F.lit(n)) == 0
    idt = F.when(mod(11), F.lit("0")).when(mod(29), F.lit("null")).otherwise(k)
    idpt = F.when(mod(31), F.lit("null")).otherwise(k)
    qt = (F.when(mod(13), F.lit('"x"')).when(mod(17), F.lit('"3.7"')).when(mod(19), F.lit("-2"))
          .when(mod(23), F.lit("0")).when(mod(67), F.lit("[2]")).when(mod(37), F.lit("3.7")).when(mod(41), F.lit('"4"'))
          .otherwise(F.col("cantidad").cast("string")))
    pt = (F.when(mod(71), F.lit("1e400")).when(mod(43), F.lit('""')).when(mod(47), F.lit('"12.50"'))
          .otherwise(F.col("precio_unitario").cast("string")))
    item = F.concat(F.lit('{"id": '), idt, F.lit(', "id_producto": '), idpt, F.lit(', "name": "p'),
                    F.coalesce(k, F.lit("")), F.lit('", "price": '), pt, F.lit(', "quantity": '), qt, F.when(mod(7), F.lit(', "details": "rojo"')).otherwise(F.lit("")), F.lit("}"))
    payload = (F.when(mod(53), F.concat(F.lit("["), F.expr("left(_item, 9)"))).when(mod(59), F.col("_item"))
               .when(mod(61), F.concat(F.lit('[7, "x", '), F.col("_item"), F.lit("]"))).otherwise(F.concat(F.lit("["), F.col("_item"), F.lit("]"))))
    return events.withColumn("_item", item).select("id_carrito", "id_detalle", payload.alias("payload"))


# ---------------------------------------------------------------- O06
def import_catalogue(files: DataFrame, products: DataFrame, categories: DataFrame,
                     path: str = "path") -> dict[str, DataFrame]:
    """Image file paths -> new products, stock rows and image rows.

    Only files directly inside a configured folder with an accepted extension
    (case-insensitive) are taken; the folder gives category and price, the
    file name gives the product name (O53); stock 10. Ids follow the current
    maxima in (folder, file name) order. ``files`` is what
    ``spark.read.format("binaryFile")`` yields; only ``path`` is selected, so
    file contents are never read.
    """
    spark = files.sparkSession
    cfg = spark.createDataFrame(IMPORT_FOLDERS, "carpeta string, categoria string, precio string")
    f = files.select(F.col(path).alias("path"))
    f = f.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("carpeta"),
                 F.regexp_extract("path", r"([^/]+)$", 1).alias("archivo"))
    f = f.withColumn("ext", F.lower(F.regexp_extract("archivo", r"^\.*[^.].*(\.[^.]*)$", 1)))
    f = f.filter(F.col("ext").isin(IMPORT_EXTENSIONS))
    f = f.join(F.broadcast(cfg), "carpeta", "inner")  # fixed 3-row table
    from vitrina.operators.catalog import missing_reference_rows
    new_cats = missing_reference_rows(f.select(F.col("categoria").alias("nombre")), categories,
                                      "nombre", "id_categoria")
    cats = categories.select("nombre", "id_categoria").unionByName(new_cats) \
        .select(F.col("nombre").alias("categoria"), "id_categoria")
    f = f.join(cats, "categoria", "left")
    f = dense_ids(f, ["carpeta", "archivo", "path"], next_id_base(products, "id_producto"), "id_producto")
    name = product_name_from_file(F.col("archivo"))
    price = F.col("precio").cast(DEC)
    prods = f.select("id_producto", name.alias("nombre"), name.alias("descripcion"), price.alias("costo"),
                     price.alias("precio_venta"), "id_categoria", F.lit(1).alias("activo"), "categoria", "path")
    return {"products": prods, "categories": new_cats,
            "stock": f.select("id_producto", F.lit(IMPORT_STOCK).alias("stock_actual")),
            "images": f.select("id_producto", F.concat(F.col("id_producto").cast("string"), "ext").alias("ruta_imagen"))}


def image_paths_from_products(ctx) -> DataFrame:
    """File paths a supplier's image folders would hold, derived from the
    product table: folder by size band, file name from the product name, and
    a mix of accepted and other extensions."""
    p = ctx["productos"]
    i4, i5 = F.pmod("id_producto", F.lit(4)), F.pmod("id_producto", F.lit(5))
    folder = (F.when(i4 == 0, F.lit("boligrafos")).when(i4 == 1, F.lit("termos"))
              .when(i4 == 2, F.lit("mousepads")).otherwise(F.lit("otros")))
    ext = (F.when(i5 == 0, F.lit(".JPG")).when(i5 == 1, F.lit(".png")).when(i5 == 2, F.lit(".jpeg"))
           .when(i5 == 3, F.lit(".gif")).otherwise(F.lit(".jpg")))
    stem = F.regexp_replace(F.col("nombre"), " ", "_")
    return p.select(F.concat(F.lit("/import/"), folder, F.lit("/"), stem, F.lit("-"),
                             F.col("id_producto").cast("string"), ext).alias("path"))
