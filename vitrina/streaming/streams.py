"""Structured Streaming forms of the event operators.

Each job reads file streams with a fixed schema, keeps per-key state in the
state store (``applyInPandasWithState``: one small record per product or
client, never the rows) and writes append-only output. Checkpoints go under
the session's ``spark.checkpoint.dir`` (shared storage on a cluster), so a
restarted query resumes where it stopped. When input arrives in event order
the rows equal the batch twins in ``ledger``, ``limits`` and ``carts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from vitrina.streaming import carts as carts_mod
from vitrina.streaming import ledger as ledger_mod
from vitrina.streaming.limits import rate_limit_counts

LEDGER_OUT = ("id_producto long, fecha timestamp_ntz, tipo string, cantidad int, descripcion string, "
              "ref long, linea long, stock_despues long, stock_minimo int")


def _ledger_state(key, pdfs: Iterator[pd.DataFrame], state):
    """Per product: running stock across micro-batches. State: (stock, has_row)."""
    pdf = pd.concat(list(pdfs), ignore_index=True)  # one micro-batch of one product
    pdf = pdf.sort_values(ledger_mod.MOVE_ORDER, kind="stable")
    if state.exists:
        stock, has_row = state.get
    else:
        opening = pdf["_open"].iloc[0]
        has_row = not pd.isna(opening)
        stock = int(opening) if has_row else 0
    run = stock + pdf["_signed"].fillna(0).astype("int64").cumsum().to_numpy()  # no quantity moves nothing
    pdf["cantidad"] = pdf["cantidad"].astype("Int64")
    state.update((int(run[-1]), bool(has_row)))
    pdf["stock_despues"] = pd.array(run, dtype="Int64") if has_row else pd.array([None] * len(pdf), dtype="Int64")
    yield pdf[["id_producto", "fecha", "tipo", "cantidad", "descripcion", "ref", "linea",
               "stock_despues", "stock_minimo"]]


def ledger_stream(sales: DataFrame, purchases: DataFrame, inventory: DataFrame) -> DataFrame:
    """O70 stream: two line streams -> movement rows with the stock after
    each; O74 is ``alerts_stream`` on top of it. ``inventory`` is static."""
    m = ledger_mod.movements(sales, purchases)
    inv = inventory.select("id_producto", F.col("stock_actual").alias("_open"), "stock_minimo")
    m = m.join(inv, "id_producto", "left")
    return m.groupBy("id_producto").applyInPandasWithState(
        _ledger_state, LEDGER_OUT, "stock long, has_row boolean", "append", GroupStateTimeout.NoTimeout)


def alerts_stream(ledger: DataFrame) -> DataFrame:
    """O74 stream: every movement that leaves stock at or below the minimum."""
    return ledger.filter(F.col("stock_despues") <= F.col("stock_minimo")).select(
        "id_producto", "fecha", "tipo", "ref", "linea", "stock_despues", "stock_minimo",
        F.lit(ledger_mod.ALERT_TEXT).alias("mensaje"))


def _guard_state(key, pdfs: Iterator[pd.DataFrame], state):
    pdf = pd.concat(list(pdfs), ignore_index=True)
    pdf = pdf.sort_values(ledger_mod.GUARD_ORDER, kind="stable")
    if state.exists:
        (left,) = state.get
    else:
        o = pdf["_open"].iloc[0]
        left = None if pd.isna(o) else int(o)
    missing = pdf["cantidad"].isna().to_numpy()
    ok, left = ledger_mod.guard_scan(pdf["cantidad"].fillna(0).astype("int64").to_numpy(), left)
    ok = np.asarray(ok, bool) | missing  # a line without quantity takes nothing and passes, as in the batch job
    pdf["cantidad"] = pdf["cantidad"].astype("Int64")
    state.update((None if left is None else int(left),))
    pdf["aceptada"] = ok
    yield pdf[["id_venta", "id_detalle", "id_producto", "fecha", "cantidad", "aceptada"]]


def oversell_stream(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """O73 stream: per product, reject a line that needs more than the stock
    left (state: the stock left; NULL = no stock row, everything passes)."""
    s = sales.select("id_venta", "id_detalle", "id_producto", "fecha", F.col("cantidad").cast("long").alias("cantidad"))
    s = s.join(inventory.select("id_producto", F.col("stock_actual").cast("long").alias("_open")), "id_producto", "left")
    return s.groupBy("id_producto").applyInPandasWithState(
        _guard_state, "id_venta long, id_detalle int, id_producto long, fecha timestamp_ntz, cantidad long, "
                      "aceptada boolean", "left long", "append", GroupStateTimeout.NoTimeout)


def rate_limit_stream(events: DataFrame, n: int, window: str, delay: str = "1 hour") -> DataFrame:
    """O75 stream: counts per (fixed window, user) with a watermark, so state
    for closed windows is dropped; rows over the limit are emitted as their
    count grows (update mode). Events later than the watermark are dropped."""
    # watermarks need a zoned timestamp; the session zone is UTC, so the
    # wall-clock values do not move
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    c = rate_limit_counts(e, window)
    return c.filter(F.col("solicitudes") > n).select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("ventana_inicio"),
        F.col("w.end").cast("timestamp_ntz").alias("ventana_fin"), "solicitudes", F.lit(n).alias("limite"))


def _cart_state(key, pdfs: Iterator[pd.DataFrame], state):
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", "id_detalle"], kind="stable")
    start, number = state.get if state.exists else (None, 0)
    life = carts_mod.LIFE_SECONDS * 1_000_000
    starts, numbers = [], []
    for t in pdf["_t"].to_numpy():
        if start is None or t > start + life:
            start, number = int(t), number + 1
        starts.append(start)
        numbers.append(number)
    state.update((start, number))
    pdf["_start"], pdf["carrito_n"] = starts, numbers
    yield pdf[["id_detalle", "id_carrito", "_start", "carrito_n"]]


def cart_life_stream(events: DataFrame) -> DataFrame:
    """O76 stream: state per client = (current cart creation, cart number)."""
    e = events.select("id_detalle", "id_carrito", F.unix_micros(F.col("fecha").cast("timestamp")).alias("_t"))
    out = e.groupBy("id_carrito").applyInPandasWithState(
        _cart_state, "id_detalle long, id_carrito long, _start long, carrito_n long",
        "start long, number long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("creacion_carrito", F.timestamp_micros("_start").cast("timestamp_ntz")).drop("_start")


def checkpoint_location(spark, name: str) -> str:
    """Streaming checkpoint folder under the session's shared checkpoint dir."""
    from vitrina.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def run_to_parquet(df: DataFrame, out: str, checkpoint: str | None = None, mode: str = "append",
                   name: str = "stream") -> None:
    """Run a streaming frame over everything available, then stop.

    ``append`` writes the rows as parquet files; ``update`` (for aggregates
    whose rows change) writes every micro-batch's changed rows through
    ``foreachBatch`` into its own folder, so a retried batch replaces itself. The checkpoint defaults to the shared checkpoint dir, so
    a restarted job resumes from the last committed micro-batch."""
    ck = checkpoint or checkpoint_location(df.sparkSession, name)
    w = df.writeStream.option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        # one folder per micro-batch id, overwritten on a retry: idempotent
        q = w.foreachBatch(lambda batch, bid: batch.write.mode("overwrite").parquet(f"{out}/lote={bid}")).start()
    q.awaitTermination()
