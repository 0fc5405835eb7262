"""First come, first served: orders that draw on limited items, decided in their
order, in rounds that are bounded by the number of partitions and not by the
length of a chain of orders that wait for each other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.scan import ordered_parts


def _replay(decide: bool):
    """Replay partitions one after another. Of each, the rows of kind 0 come first
    (what is left of an item at its start, in ``need``), then the lines in order.
    Gives the refused orders (``decide``), else what the partition took of each item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = order = None
        left: dict = {}
        taken: dict = {}
        lines: list = []
        out: list = []

        def settle() -> None:  # the order whose lines are all read
            if all(need <= left[item] for item, need, _ in lines):
                for item, _, used in lines:
                    left[item] = max(0, left[item] - used)
                    taken[item] = taken.get(item, 0) + used
            elif decide:
                out.append((order,))
            lines.clear()

        def close() -> None:  # the partition
            if lines:
                settle()
            if not decide:
                out.extend((item, part, n) for item, n in taken.items())
            left.clear()
            taken.clear()

        def frame() -> pd.DataFrame:
            rows = pd.DataFrame(out, columns=["order"] if decide else ["item", "_part", "taken"])
            out.clear()
            return rows

        for pdf in batches:
            columns = (pdf[c].tolist() for c in ("_part", "_kind", "order", "item", "need", "used"))
            for p, kind, o, item, need, used in zip(*columns):
                if p != part:
                    close()
                    part, order = p, None
                if kind == 0:
                    left[item] = need
                    continue
                if o != order and lines:
                    settle()
                order = o
                lines.append((item, need, used))
            if out:
                yield frame()
        close()
        if out:
            yield frame()

    return run


def _replayed(lines: DataFrame, entries: DataFrame, decide: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    start = entries.select("_part", F.lit(0).alias("_kind"), F.lit(0).cast(kinds["order"]).alias("order"), "item",
                           F.col("_left").alias("need"), F.lit(0).cast("long").alias("used"))
    rows = start.unionByName(lines.select("_part", F.lit(1).alias("_kind"), "order", "item", "need", "used"))
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "_part").sortWithinPartitions("_part", "_kind", "order", "item")
    schema = f"order {kinds['order']}" if decide else f"item {kinds['item']}, _part int, taken long"
    return rows.mapInPandas(_replay(decide), schema)


def refused_in_order(wants: DataFrame) -> DataFrame:
    """The orders (column ``order``) that are refused when all are decided from the
    smallest to the largest. ``wants`` has one row per order and item: (order,
    item, need, used, stock). An order is served if each of its items has at least
    ``need`` left, and then takes ``used`` of each; what is left is never below 0,
    a negative ``used`` and what is NULL count as 0. Rows without order or item are left out.

    Items that cannot run out, whoever is served, drop out first. The other lines
    are range-partitioned by order. Every partition replays its orders from what
    earlier partitions leave, first taken from their whole demand, then corrected:
    each round replays the partitions whose start has changed, until none has.
    The first of these is final after a round, so there are at most as many
    rounds as partitions, however many orders wait for each other. A task keeps
    the items of one partition and the lines of one order; between rounds go one
    row per item and partition.
    """
    wants = wants.where("order is not null and item is not null").select(
        "order", "item", F.coalesce(F.col("need").cast("long"), F.lit(0)).alias("need"), F.greatest(F.lit(0), "used").cast("long").alias("used"),
        F.coalesce("stock", F.lit(0)).cast("long").alias("stock"))
    gap = F.max(F.when(F.col("need") > 0, F.col("need") - F.col("used")))
    scarce = wants.groupBy("item").agg(gap.alias("_gap"), (F.max("stock") - F.sum("used")).alias("_rest")).where("_rest < _gap")
    lines = ordered_parts(wants.join(scarce.select("item"), "item", "left_semi"), ["order"], [])
    spans = lines.groupBy("item", "_part").agg(F.max("stock").alias("stock"), F.sum("used").alias("taken")).checkpoint(eager=True)
    earlier = Window.partitionBy("item").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition at most

    def starts(taken: DataFrame) -> DataFrame:
        j = spans.select("item", "_part", "stock").join(taken, ["item", "_part"], "left")
        left = F.col("stock") - F.coalesce(F.sum("taken").over(earlier), F.lit(0))
        return j.select("item", "_part", F.greatest(F.lit(0), left).cast("long").alias("_left")).checkpoint(eager=True)

    entries = starts(spans.select("item", "_part", "taken"))
    taken = _replayed(lines, entries, False).checkpoint(eager=True)
    while True:
        now = starts(taken)
        was = entries.withColumnRenamed("_left", "_was")
        changed = now.join(was, ["item", "_part"]).where("_left <> _was").select("_part").distinct().checkpoint(eager=True)
        entries = now
        if changed.isEmpty():
            return _replayed(lines, entries, True)
        few = F.broadcast(changed)  # at most a row a partition
        again = _replayed(lines.join(few, "_part", "left_semi"), entries.join(few, "_part", "left_semi"), False)
        taken = taken.join(few, "_part", "left_anti").unionByName(again).checkpoint(eager=True)
