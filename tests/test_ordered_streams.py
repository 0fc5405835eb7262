"""Streams over input out of order equal the batch jobs within the watermark."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vitrina.streaming import carts, ledger, ordered, streams

FAR = "2100-01-01 00:00:00"


@pytest.fixture(autouse=True)
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def _scratch():
    return tempfile.mkdtemp(prefix="vitrina-ordered-", dir="/tmp")


def _out_of_order(df, path, parts=3):
    """Files of neighbouring time ranges whose rows also slip into the next file,
    so that every file but the first holds rows older than the one before."""
    t = F.unix_micros(F.col("fecha").cast("timestamp"))
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    step = (hi - lo) // parts + 1
    late = (F.abs(F.xxhash64(*df.columns)) % 2).cast("long")
    df = df.withColumn("_p", F.expr(f"({lo})").cast("long")).withColumn("_p", F.floor((t - lo) / step) + late)
    for p in range(parts + 1):
        df.filter(F.col("_p") == p).drop("_p").orderBy(F.xxhash64("fecha")).coalesce(1).write.parquet(os.path.join(path, f"part_{p:02d}"))
    return f"{2 * step // 1_000_000 + 2} seconds"


def _far(df, path, **values):
    """A last file whose one row moves the watermark past all others."""
    row = df.limit(1).select(*[F.lit(FAR).cast("timestamp_ntz").alias(c) if c == "fecha" else
                               F.lit(values[c]).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])
    row.coalesce(1).write.parquet(os.path.join(path, "part_99"))


def _stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def _rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_cart_life_out_of_order_restarts_and_expires(spark, ctx):
    d = _scratch()
    ev = ctx["cart_events"].select("id_detalle", "id_carrito", "fecha").filter("id_carrito is not null and fecha is not null")
    ev = ev.filter(F.col("id_carrito") < 40)  # a fixture of its own: each batch opens one Python state channel a task
    delay = _out_of_order(ev, f"{d}/ev")
    streams.run_to_parquet(ordered.cart_life_stream(_stream(spark, ev, f"{d}/ev"), delay), f"{d}/out", f"{d}/ck")
    first = spark.read.parquet(f"{d}/out").count()
    _far(ev, f"{d}/ev", id_carrito=-1)
    streams.run_to_parquet(ordered.cart_life_stream(_stream(spark, ev, f"{d}/ev"), delay), f"{d}/out", f"{d}/ck")  # from the checkpoint
    want = carts.active_carts(ev).select("id_detalle", "id_carrito", "creacion_carrito")
    got = spark.read.parquet(f"{d}/out")
    assert first < got.count()
    assert _rows(got, want.columns) == _rows(want, want.columns)
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(f"{d}/ck")
    assert kept.count() == 0  # every cart is over, no client leaves a record


def test_oversell_out_of_order(spark, ctx):
    d = _scratch()
    lines = ctx["detalle_ventas"].filter("id_producto < 30 and fecha is not null")
    delay = _out_of_order(lines, f"{d}/sales")
    _far(lines, f"{d}/sales", id_producto=-1)
    streams.run_to_parquet(ordered.oversell_stream(_stream(spark, lines, f"{d}/sales"), ctx["inventario"], delay), f"{d}/out", f"{d}/ck")
    cols = ["id_venta", "id_detalle", "id_producto", "fecha", "cantidad", "aceptada"]
    assert _rows(spark.read.parquet(f"{d}/out"), cols) == _rows(ledger.oversell_guard(lines, ctx["inventario"]), cols)


def test_ledger_out_of_order(spark, ctx):
    d = _scratch()
    sales, buys = (ctx[t].filter("id_producto < 30 and fecha is not null") for t in ("detalle_ventas", "detalle_compras"))
    delay = _out_of_order(sales, f"{d}/sales")
    buys.coalesce(1).write.parquet(f"{d}/buys/part_00")
    _far(sales, f"{d}/sales", id_producto=-1)
    _far(buys, f"{d}/buys", id_producto=-1)
    b = spark.readStream.schema(buys.schema).option("recursiveFileLookup", "true").parquet(f"{d}/buys")
    streams.run_to_parquet(ordered.ledger_stream(_stream(spark, sales, f"{d}/sales"), b, ctx["inventario"], delay), f"{d}/out", f"{d}/ck")
    cols = ["id_producto", "fecha", "tipo", "cantidad", "ref", "linea", "stock_despues"]
    want = ledger.stock_ledger(sales, buys, ctx["inventario"])
    assert _rows(spark.read.parquet(f"{d}/out"), cols) == _rows(want, cols)
