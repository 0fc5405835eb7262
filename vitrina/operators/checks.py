"""Schema evolution and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def schema_evolve(df: DataFrame, added: list[tuple[str, str, object]]) -> DataFrame:
    """Add the columns of ``added`` (name, type, default) that ``df``
    lacks; existing columns are kept as they are (idempotent)."""
    have = set(df.columns)
    extra = [F.lit(d).cast(t).alias(n) for n, t, d in added if n not in have]
    return df.select("*", *extra) if extra else df


def read_evolving(spark, path: str, added: list[tuple[str, str, object]]) -> DataFrame:
    """O02 over files: read a table whose parquet files were written before
    and after columns were added (``mergeSchema`` unions the file schemas;
    old files read the new columns as NULL), then add the columns no file has
    yet. Rows from old files keep NULL in added columns, as SQLite's
    ``ALTER TABLE ADD COLUMN`` does without a default."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return schema_evolve(df, added)


# The declared keys of the shop schema that the application
# relies on: (table, kind, column, referenced table, referenced column).
RULES = [
    ("categorias", "unique", "nombre", None, None),
    ("categorias", "unique", "id_categoria", None, None),
    ("productos", "unique", "id_producto", None, None),
    ("inventario", "unique", "id_producto", None, None),
    ("clientes", "unique", "correo", None, None),
    ("usuarios", "unique", "correo", None, None),
    ("facturas", "unique", "id_venta", None, None),
    ("estados_pedido", "unique", "nombre", None, None),
    ("productos", "foreign", "id_categoria", "categorias", "id_categoria"),
    ("inventario", "foreign", "id_producto", "productos", "id_producto"),
    ("imagenes_productos", "foreign", "id_producto", "productos", "id_producto"),
    ("usuarios", "foreign", "id_rol", "roles", "id_rol"),
    ("pedidos", "foreign", "id_cliente", "clientes", "id_cliente"),
    ("pedidos", "foreign", "id_estado", "estados_pedido", "id_estado"),
    ("detalle_pedidos", "foreign", "id_pedido", "pedidos", "id_pedido"),
    ("detalle_pedidos", "foreign", "id_producto", "productos", "id_producto"),
    ("envios", "foreign", "id_pedido", "pedidos", "id_pedido"),
    ("ventas", "foreign", "id_cliente", "clientes", "id_cliente"),
    ("detalle_ventas", "foreign", "id_venta", "ventas", "id_venta"),
    ("facturas", "foreign", "id_venta", "ventas", "id_venta"),
    ("productos", "not_null", "nombre", None, None),
    ("clientes", "not_null", "nombre", None, None),
    ("pedidos", "not_null", "id_cliente", None, None),
    ("detalle_ventas", "not_null", "id_producto", None, None),
    ("cuentas_vinculadas", "unique", ("proveedor", "proveedor_id"), None, None),
    ("cuentas_vinculadas", "unique", ("id_usuario", "proveedor"), None, None),
    ("roles", "unique", "nombre", None, None),
]


def _key_columns(t: DataFrame, cols: list[str], shape: list[tuple[int, bool]]) -> list[Column]:
    """Key columns of one shape for the keys of all rules: place and kind (whole
    number or text) of each; a key leaves those it has no use for at 0 or ''."""
    out = []
    for at, whole in shape:
        mine = at < len(cols) and whole == isinstance(t.schema[cols[at]].dataType, IntegralType)
        kind, empty = ("long", 0) if whole else ("string", "")
        out.append((F.col(cols[at]) if mine else F.lit(empty)).cast(kind).alias(f"{'n' if whole else 's'}{at}"))
    return out


def _table_violations(ctx, table: str, rules: list[tuple]) -> DataFrame:
    """All rules of one table from one scan and one aggregate: every row is
    expanded to one (place, key) per key the rules look at, rules on the same
    columns sharing it, and the referenced keys join the same aggregate as rows
    that count nothing and set their rule's bit in ``known``. A task holds each
    key once, in the aggregate alone: no join sorts or builds it again."""
    t = ctx[table]
    keyed = [(kind, [col] if isinstance(col, str) else list(col), ref, ref_col) for _, kind, col, ref, ref_col in rules]
    whole = {c: isinstance(t.schema[c].dataType, IntegralType) for _, cols, _, _ in keyed for c in cols}
    shape = sorted({(at, whole[c]) for kind, cols, _, _ in keyed if kind != "not_null" for at, c in enumerate(cols)})
    keys = [f"{'n' if is_whole else 's'}{at}" for at, is_whole in shape]
    places = list(dict.fromkeys((kind == "not_null", tuple(cols)) for kind, cols, _, _ in keyed))

    def entry(source: DataFrame, place: int, cols: list[str], known: int) -> list[Column]:
        return [F.lit(place).alias("place"), *_key_columns(source, cols, shape), F.lit(known).cast("long").alias("known")]

    entries = []
    for n, (for_nulls, cols) in enumerate(places):
        null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
        entries.append(F.when(null if for_nulls else ~null, F.struct(*entry(t, n, [] if for_nulls else list(cols), 0))))
    rows = t.select(F.explode(F.array_compact(F.array(*entries))).alias("x")).select("x.*", F.lit(1).cast("long").alias("filas"))
    broken = []
    for n, (kind, cols, ref, ref_col) in enumerate(keyed):
        place = places.index((kind == "not_null", tuple(cols)))
        bad, key = F.lit(True), F.concat_ws("|", *[F.col(f"{'n' if whole[c] else 's'}{at}").cast("string") for at, c in enumerate(cols)])
        if kind == "unique":
            bad = F.col("filas") > 1
        elif kind == "foreign":
            known = ctx[ref].filter(F.col(ref_col).isNotNull())
            rows = rows.unionByName(known.select(*entry(ctx[ref], place, [ref_col], 1 << n), F.lit(0).cast("long").alias("filas")))
            bad = F.col("known").bitwiseAND(F.lit(1 << n).cast("long")) == 0
        else:
            key = F.lit(None).cast("string")
        found = F.struct(F.lit(table).alias("tabla"), F.lit(kind).alias("regla"), F.lit(",".join(cols)).alias("columna"), key.alias("clave"), F.col("filas").alias("filas"))
        broken.append(F.when((F.col("place") == place) & bad, found))
    counts = rows.groupBy("place", *keys).agg(F.sum("filas").alias("filas"), F.bit_or("known").alias("known"))
    found = counts.filter("filas > 0").select(F.inline(F.array_compact(F.array(*broken))))
    # a stage of its own for each table: under one union adaptive execution
    # would share the cores out among the tables, with few, large tasks for each
    return found.hint("rebalance")


def constraint_violations(ctx, rules=RULES) -> DataFrame:
    """One row per violation (tabla, regla, columna, clave, filas).

    UNIQUE: one row per duplicated key without NULLs (NULLs never collide, as
    in SQLite) with its count, a composite key (a tuple of columns) joined by
    '|'; FOREIGN KEY: one row per non-NULL value without a referenced row, with
    the number of rows using it; NOT NULL: one row with the number of NULL rows.
    One scan and one aggregate per table for all its rules, combined map-side."""
    tables = dict.fromkeys(r[0] for r in rules)
    return reduce(DataFrame.unionByName, [_table_violations(ctx, table, [r for r in rules if r[0] == table]) for table in tables])


def constraint_violations_sql(rules=RULES) -> str:
    """The same checks stated in SQL (for the DuckDB oracle)."""
    parts = []
    for table, kind, col, ref, ref_col in rules:
        if not isinstance(col, str):
            key = " || '|' || ".join(f"cast({c} as varchar)" for c in col)
            parts.append(f"select '{table}' tabla, '{kind}' regla, '{','.join(col)}' columna, {key} clave, count(*) filas "
                         f"from {table} where {key} is not null group by {', '.join(col)} having count(*) > 1")
            continue
        head = f"select '{table}' tabla, '{kind}' regla, '{col}' columna"
        if kind == "unique":
            parts.append(f"{head}, cast({col} as varchar) clave, count(*) filas from {table} "
                         f"where {col} is not null group by {col} having count(*) > 1")
        elif kind == "foreign":
            parts.append(f"{head}, cast(t.{col} as varchar) clave, count(*) filas from {table} t "
                         f"where t.{col} is not null and not exists (select 1 from {ref} r where r.{ref_col} = t.{col}) "
                         f"group by t.{col}")
        else:
            parts.append(f"select * from ({head}, cast(null as varchar) clave, count(*) filas from {table} "
                         f"where {col} is null) x where filas > 0")
    return "\nunion all\n".join(parts)
