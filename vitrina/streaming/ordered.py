"""Event-time forms of the stock and cart streams (O70, O73, O76) for input that
arrives out of order.

Rows wait in list state until the watermark passes them, are then replayed in
the batch job's order and go; what a key keeps between replays is one small
record. So within ``delay`` the rows equal the batch job's in whatever order
they arrive, also after a restart from the checkpoint; later rows are dropped, as
by every watermark. A row comes out when the watermark reaches its time. Rows
without key or time have no place in that order and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from vitrina.streaming import carts as carts_mod
from vitrina.streaming import ledger as ledger_mod

#: Fixed value: the state store that keeps list state and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Fold = Callable[[list[Row], tuple | None], tuple[list[tuple], tuple]]


class OrderedReplay(StatefulProcessor):
    """Buffers a key's rows, replays those the watermark has passed.

    ``fold(rows in order, record or None)`` gives the output rows and the new
    record; ``expires(record)`` the time (microseconds) from which the record
    changes no later row, or None.
    """

    def __init__(self, rows: StructType, order: list[str], record: str, fold: Fold,
                 expires: Callable[[tuple], int | None], out: StructType):
        self.rows, self.order, self.record, self.fold, self.expires, self.out = rows, order, record, fold, expires, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.kept = handle.getValueState("kept", self.record)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def _place(self, row: Row) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in self.order)  # no value comes first

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.rows.names) for r in rows]
        self.waiting.appendList(new)
        at = self.rows.names.index("_t")
        self._wake(min(r[at] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [Row(*self.rows.names)(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r["_t"] <= passed), key=self._place)
        rest = [tuple(r) for r in rows if r["_t"] > passed]
        if rest:
            self._wake(min(r[self.rows.names.index("_t")] for r in rest))
        record = tuple(self.kept.get()) if self.kept.exists() else None
        out: list[tuple] = []
        if due:
            out, record = self.fold(due, record)
            self.waiting.put(rest) if rest else self.waiting.clear()
        end = self.expires(record) if record is not None else None
        if end is not None and end <= passed:
            self.kept.clear()
        elif due:
            self.kept.update(record)
            if end is not None:
                self._wake(end)
        return iter([Row(*self.out.names)(*r) for r in out])

    def close(self) -> None:
        pass


def _replayed(df: DataFrame, key: str, time: str, order: list[str], record: str, fold: Fold, out: str, delay: str | None,
              expires: Callable[[tuple], int | None] = lambda record: None) -> DataFrame:
    """``df`` by ``key`` through an ``OrderedReplay``; ``time`` gives way to its
    microseconds ``_t`` in rows and output. Without ``delay`` the column ``time``
    has its watermark already."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    at = F.col(time).cast("timestamp")
    df = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_ts", at).withColumn("_t", F.unix_micros("_ts"))
    rows = df.drop("_ts", time).schema
    order = ["_t" if c == time else c for c in order]
    got = StructType.fromDDL(out)
    replay = OrderedReplay(rows, order, record, fold, expires, got)
    done = (df.withWatermark("_ts", delay) if delay else df.drop("_ts")).groupBy(key).transformWithState(replay, got, "Append", "EventTime")
    return done.withColumn(time, F.timestamp_micros("_t").cast("timestamp_ntz")).drop("_t")


def _ledger_fold(rows: list[Row], record: tuple | None) -> tuple[list[tuple], tuple]:
    stock, known = record or (rows[0]["_open"] or 0, rows[0]["_open"] is not None)
    out = []
    for r in rows:
        stock += r["_signed"] or 0  # no quantity moves nothing
        out.append((r["id_producto"], r["_t"], r["tipo"], r["cantidad"], r["descripcion"], r["ref"], r["linea"], stock if known else None, r["stock_minimo"]))
    return out, (stock, known)


def ledger_stream(sales: DataFrame, purchases: DataFrame, inventory: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Movements with the stock after each. ``inventory`` is static, its
    opening stock is read with the product's first movement. Each source has a
    watermark of its own and the slower one counts, so a source that runs ahead
    makes no row of the other late."""
    sales, purchases = (df.withColumn("fecha", F.col("fecha").cast("timestamp")).withWatermark("fecha", delay) for df in (sales, purchases))
    m = ledger_mod.movements(sales, purchases)
    inv = inventory.select("id_producto", F.col("stock_actual").cast("long").alias("_open"), "stock_minimo")
    return _replayed(m.join(inv, "id_producto", "left"), "id_producto", "fecha", ledger_mod.MOVE_ORDER, "stock long, known boolean", _ledger_fold,
                     "id_producto long, _t long, tipo string, cantidad int, descripcion string, ref long, linea long, stock_despues long, stock_minimo int", None)


def _guard_fold(rows: list[Row], record: tuple | None) -> tuple[list[tuple], tuple]:
    left = record[0] if record else rows[0]["_open"]
    out = []
    for r in rows:
        n = r["cantidad"]
        ok = n is None or left is None or n <= left  # a line without quantity takes nothing
        if ok and n is not None and left is not None:
            left -= n
        out.append((r["id_venta"], r["id_detalle"], r["id_producto"], r["_t"], n, ok))
    return out, (left,)


def oversell_stream(sales: DataFrame, inventory: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A line that needs more than the stock left is rejected; products
    without a stock row accept everything."""
    s = sales.select("id_venta", "id_detalle", "id_producto", "fecha", F.col("cantidad").cast("long").alias("cantidad"))
    s = s.join(inventory.select("id_producto", F.col("stock_actual").cast("long").alias("_open")), "id_producto", "left")
    return _replayed(s, "id_producto", "fecha", ledger_mod.GUARD_ORDER, "left long", _guard_fold,
                     "id_venta long, id_detalle int, id_producto long, _t long, cantidad long, aceptada boolean", delay)


def _cart_fold(rows: list[Row], record: tuple | None) -> tuple[list[tuple], tuple]:
    start = record[0] if record else None
    out = []
    for r in rows:
        if start is None or r["_t"] > start + carts_mod.LIFE_SECONDS * 1_000_000:
            start = r["_t"]
        out.append((r["id_detalle"], r["id_carrito"], r["_t"], start))
    return out, (start,)


def cart_life_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The creation of the cart each event belongs to. A client's record
    expires with the cart, 24 h after its creation, so a client who stays away
    leaves no state; carts are named by (client, creation), not numbered."""
    e = events.select("id_detalle", "id_carrito", "fecha")
    out = _replayed(e, "id_carrito", "fecha", ["fecha", "id_detalle"], "start long", _cart_fold,
                    "id_detalle long, id_carrito long, _t long, _start long", delay,
                    expires=lambda record: record[0] + carts_mod.LIFE_SECONDS * 1_000_000)
    return out.withColumn("creacion_carrito", F.timestamp_micros("_start").cast("timestamp_ntz")).drop("_start")
