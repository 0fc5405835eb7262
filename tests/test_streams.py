"""Streaming jobs equal their batch twins when input arrives in order."""

import os
import tempfile

from pyspark.sql import functions as F

from vitrina.streaming import carts, ledger, limits, streams


def _scratch():
    return tempfile.mkdtemp(prefix="vitrina-stream-", dir="/tmp")


def _write_by(df, col, path):
    """One parquet folder per distinct value of ``col`` (written in order, so
    file times follow the values)."""
    for (v,) in sorted(df.select(col).distinct().collect()):
        df.filter(F.col(col) == v).drop(col).write.parquet(os.path.join(path, f"part_{v:05d}"))


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ledger_and_alert_streams_equal_batch(spark, ctx):
    d = _scratch()
    ctx["detalle_ventas"].write.parquet(f"{d}/sales/a")
    ctx["detalle_compras"].write.parquet(f"{d}/purchases/a")
    s = spark.readStream.schema(ctx["detalle_ventas"].schema).option("recursiveFileLookup", "true").parquet(f"{d}/sales")
    p = spark.readStream.schema(ctx["detalle_compras"].schema).option("recursiveFileLookup", "true").parquet(f"{d}/purchases")
    led = streams.ledger_stream(s, p, ctx["inventario"])
    streams.run_to_parquet(led, f"{d}/out", f"{d}/ck")
    streams.run_to_parquet(streams.alerts_stream(
        streams.ledger_stream(s, p, ctx["inventario"])), f"{d}/alerts", f"{d}/ck2")
    cols = ["id_producto", "fecha", "tipo", "cantidad", "ref", "linea", "stock_despues"]
    want = ledger.stock_ledger(ctx["detalle_ventas"], ctx["detalle_compras"], ctx["inventario"])
    assert _rows(spark.read.parquet(f"{d}/out"), cols) == _rows(want, cols)
    acols = ["id_producto", "fecha", "tipo", "ref", "linea", "stock_despues"]
    assert _rows(spark.read.parquet(f"{d}/alerts"), acols) == _rows(
        ledger.low_stock_alerts(want, ctx["inventario"]), acols)


def test_oversell_stream_over_many_batches_equals_batch(spark, ctx):
    d = _scratch()
    lines = ctx["detalle_ventas"].withColumn("_y", F.year("fecha"))
    _write_by(lines, "_y", f"{d}/sales")
    s = (spark.readStream.schema(ctx["detalle_ventas"].schema).option("maxFilesPerTrigger", 1)
         .option("recursiveFileLookup", "true").parquet(f"{d}/sales"))
    streams.run_to_parquet(streams.oversell_stream(s, ctx["inventario"]), f"{d}/out", f"{d}/ck")
    cols = ["id_venta", "id_detalle", "id_producto", "fecha", "cantidad", "aceptada"]
    got = spark.read.parquet(f"{d}/out")
    want = ledger.oversell_guard(ctx["detalle_ventas"], ctx["inventario"])
    assert _rows(got, cols) == _rows(want, cols)


def test_cart_life_stream_equals_batch(spark, ctx):
    d = _scratch()
    ev = ctx["cart_events"].select("id_detalle", "id_carrito", "fecha").withColumn("_d", F.dayofyear("fecha"))
    _write_by(ev, "_d", f"{d}/ev")
    s = (spark.readStream.schema("id_detalle long, id_carrito long, fecha timestamp_ntz")
         .option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(f"{d}/ev"))
    streams.run_to_parquet(streams.cart_life_stream(s), f"{d}/out", f"{d}/ck")
    cols = ["id_detalle", "carrito_n", "creacion_carrito"]
    want = carts.active_carts(ctx["cart_events"])
    assert _rows(spark.read.parquet(f"{d}/out"), cols) == _rows(want, cols)


def test_rate_limit_stream_final_counts_equal_batch(spark, ctx):
    d = _scratch()
    ev = ctx.raw("events").withColumn("_d", F.dayofyear("ts"))
    _write_by(ev, "_d", f"{d}/ev")
    s = (spark.readStream.schema(ctx.raw("events").schema).option("maxFilesPerTrigger", 2)
         .option("recursiveFileLookup", "true").parquet(f"{d}/ev"))
    streams.run_to_parquet(streams.rate_limit_stream(s, 2, "1 day"), f"{d}/out", f"{d}/ck", mode="update")
    got = (spark.read.parquet(f"{d}/out").groupBy("user_id", "ventana_inicio")
           .agg(F.max("solicitudes").alias("solicitudes")))
    want = limits.rate_limit_flags(ctx.raw("events"), 2, "1 day")
    cols = ["user_id", "ventana_inicio", "solicitudes"]
    assert _rows(got, cols) == _rows(want, cols)
    assert got.count() > 0


class _State:
    """The part of a group state that the folds use."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_state_functions_take_missing_quantities_like_the_batch_jobs(spark):
    import pandas as pd
    from vitrina.streaming import ledger, streams
    days = pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"])
    qty = [None, 4, 3, None]
    lines = spark.createDataFrame([(i, i, 7, d.to_pydatetime(), q) for i, (d, q) in enumerate(zip(days, qty))],
                                  "id_venta long, id_detalle int, id_producto long, fecha timestamp_ntz, cantidad int")
    stock = spark.createDataFrame([(7, 5, 2)], "id_producto long, stock_actual int, stock_minimo int")
    batch = {r.id_venta: r.aceptada for r in ledger.oversell_guard(lines, stock).collect()}
    pdf = pd.DataFrame({"id_venta": range(4), "id_detalle": range(4), "id_producto": 7, "fecha": days, "cantidad": qty, "_open": 5})
    state, got = _State(), {}
    for lo in (0, 2):  # two micro-batches
        for out in streams._guard_state((7,), iter([pdf.iloc[lo : lo + 2].copy()]), state):
            got |= dict(zip(out["id_venta"], map(bool, out["aceptada"])))
    assert got == batch == {0: True, 1: True, 2: False, 3: True}
    sales_ = lines.withColumn("precio_unitario", lines.id_venta * 0)
    buys = spark.createDataFrame([], "id_proveedor long, id_producto long, cantidad int, fecha timestamp_ntz")
    want = {r.ref: r.stock_despues for r in ledger.stock_ledger(sales_, buys, stock).collect()}
    move = pd.DataFrame({"id_producto": 7, "fecha": days, "tipo": "salida", "cantidad": qty, "descripcion": "Venta realizada",
                         "ref": range(4), "linea": range(4), "_signed": [None if q is None else -q for q in qty], "_open": 5, "stock_minimo": 2})
    state, got = _State(), {}
    for lo in (0, 2):
        for out in streams._ledger_state((7,), iter([move.iloc[lo : lo + 2].copy()]), state):
            got |= dict(zip(out["ref"], out["stock_despues"]))
    assert got == want == {0: 5, 1: 1, 2: -2, 3: -2}
