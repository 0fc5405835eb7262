"""Stock movements, low-stock alerts and the oversell guard.

The reference declares these as row triggers on sale / purchase lines and
stock updates. Here each is a batch job over whole tables (the "twin") plus a
Structured Streaming job in ``vitrina.streaming.streams`` that gives the same
rows when the input arrives in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.scan import ordered_parts, running_sum

# Movement kinds and texts written by the triggers.
OUT, IN = "salida", "entrada"
SALE_TEXT, PURCHASE_TEXT = "Venta realizada", "Compra realizada"
ALERT_TEXT = "Stock bajo del mínimo permitido"

MOVE_ORDER = ["fecha", "tipo", "ref", "linea", "cantidad"]


def movements(sale_lines: DataFrame, purchase_lines: DataFrame) -> DataFrame:
    """O70 rows: one movement per sale line ('salida') and purchase line
    ('entrada'), with a signed quantity."""
    s = sale_lines.select("id_producto", "fecha", F.lit(OUT).alias("tipo"), "cantidad",
                          F.lit(SALE_TEXT).alias("descripcion"), F.col("id_venta").alias("ref"),
                          F.col("id_detalle").cast("long").alias("linea"),
                          (-F.col("cantidad")).cast("long").alias("_signed"))
    p = purchase_lines.select("id_producto", "fecha", F.lit(IN).alias("tipo"), "cantidad",
                              F.lit(PURCHASE_TEXT).alias("descripcion"), F.col("id_proveedor").alias("ref"),
                              F.lit(0).cast("long").alias("linea"), F.col("cantidad").cast("long").alias("_signed"))
    return s.unionByName(p)


def stock_ledger(sale_lines: DataFrame, purchase_lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every movement with the stock after it = opening stock + running
    signed sum in (date, kind, reference, line, quantity) order. Products
    without a stock row keep their movements with a NULL stock (the trigger's
    UPDATE touches no row, its INSERT still runs)."""
    m = movements(sale_lines, purchase_lines)
    m = running_sum(m, ["id_producto"], MOVE_ORDER, "_signed", "_run")
    inv = inventory.select("id_producto", F.col("stock_actual").alias("_open"))
    j = m.join(inv, "id_producto", "left")
    return j.select("id_producto", "fecha", "tipo", "cantidad", "descripcion", "ref", "linea",
                    (F.col("_open") + F.col("_run")).cast("long").alias("stock_despues"))


def low_stock_alerts(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """One alert for every stock update that ends at or below the
    product's minimum (every such update, not only the crossing)."""
    inv = inventory.select("id_producto", "stock_minimo")
    j = ledger.join(inv, "id_producto", "inner")
    return j.filter(F.col("stock_despues") <= F.col("stock_minimo")).select(
        "id_producto", "fecha", "tipo", "ref", "linea", "stock_despues", "stock_minimo",
        F.lit(ALERT_TEXT).alias("mensaje"))


# ---------------------------------------------------------------- O73
GUARD_ORDER = ["fecha", "id_venta", "id_detalle", "cantidad"]
GUARD_COLS = ["id_venta", "id_detalle", "id_producto", "fecha", "cantidad"]


GUARD_SCHEMA = ("id_venta long, id_detalle int, id_producto long, fecha timestamp_ntz, cantidad long, "
                "aceptada boolean")


def guard_scan(qty: np.ndarray, left) -> tuple[np.ndarray, object]:
    """Sequential oversell decisions for one product's lines in order, from
    stock ``left``: a line is accepted iff it fits in what is left (a negative
    quantity adds). Numpy jumps over stretches: all lines up to the first one
    that does not fit by the running sum, then on to the next one that does, in
    growing windows. ``left`` None (no stock row) accepts everything."""
    n = len(qty)
    ok = np.zeros(n, dtype=bool)
    if left is None:
        ok[:] = True
        return ok, None
    i, w = 0, 64
    while i < n:
        sums = np.cumsum(qty[i:i + w])
        bad = np.flatnonzero(sums > left)
        take = int(bad[0]) if len(bad) else len(sums)
        if take:
            ok[i:i + take] = True
            left = left - sums[take - 1]
            i += take
            w = 2 * w if take == len(sums) else 64
        else:
            hit = np.flatnonzero(qty[i:i + w] <= left)
            i, w = (i + int(hit[0]), 64) if len(hit) else (i + w, 2 * w)
    return ok, left


def _guard_stretches(pdf: pd.DataFrame, current):
    """(from, to, product, stock before) of the products of a sorted batch.
    ``current`` is (product, stock left) of the stretch before."""
    prods = pdf["id_producto"].to_numpy()
    cuts = np.flatnonzero(prods[1:] != prods[:-1]) + 1
    entry, given = pdf["_entry"].to_numpy(), pdf["_entry"].notna().to_numpy()
    for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
        if current and current[0] == prods[a]:
            yield a, b, prods[a], current[1]
        else:
            yield a, b, prods[a], int(entry[a]) if given[a] else int(pdf["_open"].iloc[a])


def _guard_exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's first product, and the stock its last product leaves."""
    current = first = part = None
    for pdf in batches:
        qty = pdf["cantidad"].to_numpy()
        for a, b, product, left in _guard_stretches(pdf, current):
            part = int(pdf["_part"].iloc[0]) if part is None else part
            first = product if first is None else first
            current = product, guard_scan(qty[a:b], left)[1]
    if current:
        rows = [] if first == current[0] else [(first, part, None, False)]
        rows.append((current[0], part, int(current[1]), bool(first == current[0])))
        out = pd.DataFrame(rows, columns=["id_producto", "_part", "_exit", "_whole"])
        out["_exit"] = out["_exit"].astype("Int64")
        yield out


def _guard_decisions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current = None
    for pdf in batches:
        qty, ok = pdf["cantidad"].to_numpy(), np.zeros(len(pdf), dtype=bool)
        for a, b, product, left in _guard_stretches(pdf, current):
            ok[a:b], left = guard_scan(qty[a:b], left)
            current = product, left
        out = pdf[GUARD_COLS].copy()
        out["aceptada"] = ok
        yield out


def oversell_guard(sale_lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """In arrival order per product, a line that needs more than the
    stock left is rejected; accepted lines reduce the stock, negative ones add
    to it. A product without a stock row accepts everything (the check compares
    with NULL), and so does a line without a quantity.

    One path for all products, whatever their size or stock: the lines are
    range-partitioned by (product, order), so that a boundary splits at most one
    product. Every partition replays its lines; a product that begins in it
    starts from its opening stock. Where a product fills whole partitions, their
    stock before is first taken from the running demand (exact until the first
    rejection) and then corrected: each round replays from the stock that the
    partition before left, until no such stock changes. A round makes at least
    one more partition of each product final, so there are at most as many
    rounds as partitions that one product fills; since a product that is sold
    out forgets how it got there, two or three are usual. Between rounds only
    one number per partition is carried (a broadcast of at most that many rows).
    """
    lines = sale_lines.select(*GUARD_COLS).withColumn("cantidad", F.col("cantidad").cast("long"))
    inv = inventory.select("id_producto", F.col("stock_actual").cast("long").alias("_open"))
    x = lines.join(inv, "id_producto", "left")
    free = x.filter("_open is null or cantidad is null").select(*GUARD_COLS, F.lit(True).alias("aceptada"))
    parts = ordered_parts(x.filter("_open is not null and cantidad is not null"), ["id_producto"], GUARD_ORDER)
    by_part = Window.partitionBy("id_producto").orderBy("_part")
    demand = parts.groupBy("id_producto", "_part").agg(F.sum("cantidad").alias("_sum"), F.first("_open").alias("_o"))
    before = demand.withColumn("_before", F.sum("_sum").over(by_part.rowsBetween(Window.unboundedPreceding, -1))).filter("_before is not null")
    guess = F.greatest(F.lit(0), F.col("_o") - F.col("_before")).cast("long")
    entries = before.select("id_producto", "_part", guess.alias("_entry")).checkpoint(eager=True)

    def with_entries(e: DataFrame) -> DataFrame:
        return parts.join(F.broadcast(e), ["id_producto", "_part"], "left")  # at most a row a partition

    while True:
        exits = with_entries(entries).mapInPandas(_guard_exits, "id_producto long, _part int, _exit long, _whole boolean")
        now = exits.withColumn("_entry", F.lag("_exit").over(by_part)).filter("_entry is not null").checkpoint(eager=True)
        was = entries.select("id_producto", "_part", F.col("_entry").alias("_was"))
        changed = now.filter("_whole").join(was, ["id_producto", "_part"]).filter("_entry <> _was")
        entries = now.select("id_producto", "_part", "_entry")
        if changed.isEmpty():
            break
    return with_entries(entries).mapInPandas(_guard_decisions, GUARD_SCHEMA).unionByName(free)
