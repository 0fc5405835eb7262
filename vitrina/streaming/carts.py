"""Cart life (O76): a client's newest cart is reused while its creation is at
most 24 hours old; the first event after that starts a new cart.

This is not a session window (a session extends with activity; a cart's life
is fixed from its creation). Events are range-partitioned by (client, time), so
a boundary splits at most one client. A partition that one client fills becomes a
map from the cart the client enters with to the cart it leaves with; the maps are
composed in order, and every partition is then replayed from its own entry. Inside
a partition the next cart start is found by binary search, so the work is per
cart, not per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.functions.scan import ordered_parts

LIFE_SECONDS = 24 * 3600  # Fixed value: cart life, inclusive boundary.
_LIFE = LIFE_SECONDS * 1_000_000


def _place(t: np.ndarray, start, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Cart start and number of each event time of one client, ascending, who
    enters with cart ``number`` created at ``start`` (None: no cart yet)."""
    starts, numbers = np.empty(len(t), dtype=np.int64), np.empty(len(t), dtype=np.int64)
    i = 0
    while i < len(t):
        if start is None or t[i] > start + _LIFE:
            start, number = int(t[i]), number + 1
        j = i + int(np.searchsorted(t[i:], start + _LIFE, side="right"))  # up to creation + life
        starts[i:j], numbers[i:j] = start, number
        i = j
    return starts, numbers


def _entry_map(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a partition of one client's event times does to an entering cart:
    (first, last, carts). A cart that ends before ``first[k]`` (and not before
    ``first[k - 1]``) is followed by ``carts[k]`` new ones, the last created at
    ``last[k]``; one that outlives all of ``first`` outlives the partition. Only
    events within one life of the first can be the first new start; chains of
    starts are followed by doubling."""
    t = np.unique(t)
    n = len(t)
    step = np.append(np.searchsorted(t, t + _LIFE, side="right"), n)  # n: behind the partition
    last = np.arange(n + 1)
    count = np.append(np.ones(n, np.int64), 0)
    while (step[:n] < n).any():
        last = np.where(step < n, last[np.minimum(step, n)], last)
        count = count + count[step]
        step = step[step]
    k = np.arange(min(n, int(np.searchsorted(t, t[0] + _LIFE, side="right")) + 1))
    same = (last[k][1:] == last[k][:-1]) & (count[k][1:] == count[k][:-1])
    k = k[np.append(~same, True)]
    return t[k], t[last[k]], count[k]


def _part_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for the last client of a partition (and one for the first, if
    another): the client's event times there as a map, or, for a client that
    begins here, the cart it leaves with."""
    client = first = part = None
    times: list[np.ndarray] = []
    for pdf in batches:
        keys, t = pdf["_client"].to_numpy(), pdf["_t"].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if client is None or keys[a] != client:
                client, times = keys[a], []
            first = client if first is None else first
            part = int(pdf["_part"].iloc[0])
            times.append(t[a:b])
    if client is not None:
        t, none = np.concatenate(times), [None, None, None]
        rows = []
        if first != client:
            starts, numbers = _place(t, None, 0)
            rows = [(first, part, 0, *none), (client, part, 2, [int(starts[-1])], [int(starts[-1])], [int(numbers[-1])])]
        else:
            rows = [(client, part, 1, *(x.tolist() for x in _entry_map(t)))]
        yield pd.DataFrame(rows, columns=["_client", "_part", "_kind", "_first", "_last", "_carts"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compose a client's maps in the order of the partitions: the cart it
    enters each later partition with."""
    client = start = None
    number = 0
    for pdf in batches:
        rows = []
        for key, part, kind, first, last, carts in zip(*(pdf[c] for c in ("_client", "_part", "_kind", "_first", "_last", "_carts"))):
            if client is None or key != client:
                client, start, number = key, None, 0
            if start is not None:
                rows.append((key, part, start, number))
            if kind == 2:
                start, number = int(last[0]), int(carts[0])
            elif kind == 1:
                k = 0 if start is None else int(np.searchsorted(first, start + _LIFE, side="right"))
                if k < len(first):
                    start, number = int(last[k]), number + int(carts[k])
        yield pd.DataFrame(rows, columns=["_client", "_part", "_s0", "_n0"])


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    client = start = None
    number = 0
    for pdf in batches:
        keys, t = pdf["_client"].to_numpy(), pdf["_t"].to_numpy()
        known, s0, n0 = pdf["_s0"].notna().to_numpy(), pdf["_s0"].to_numpy(), pdf["_n0"].to_numpy()
        starts, numbers = np.empty(len(pdf), dtype=np.int64), np.empty(len(pdf), dtype=np.int64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            if client is None or keys[a] != client:
                client, start, number = keys[a], int(s0[a]) if known[a] else None, int(n0[a]) if known[a] else 0
            starts[a:b], numbers[a:b] = _place(t[a:b], start, number)
            start, number = int(starts[b - 1]), int(numbers[b - 1])
        out = pdf.drop(columns=["_client", "_t", "_k", "_part", "_s0", "_n0"])
        out["_start"], out["carrito_n"] = starts, numbers
        yield out


def active_carts(events: DataFrame, client: str = "id_carrito", ts: str = "fecha",
                 event_id: str = "id_detalle") -> DataFrame:
    """Each cart event with its cart: (client, cart number 1.., cart creation).

    One path for all clients, whatever their size. An event without a client or
    without a time belongs to no cart: its number and creation are NULL. Events at
    one time are in the order of their ids."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = events.select("*", F.col(event_id).alias("_k"), F.col(client).alias("_client"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    parts = ordered_parts(e.filter("_client is not null and _t is not null"), ["_client"], ["_t", "_k"])
    kind = e.schema["_client"].dataType.simpleString()
    maps = parts.select("_client", "_t", "_part").mapInPandas(
        _part_maps, f"_client {kind}, _part int, _kind int, _first array<long>, _last array<long>, _carts array<long>")
    entries = (maps.repartition(n, F.xxhash64("_client")).sortWithinPartitions("_client", "_part")
               .mapInPandas(_entries, f"_client {kind}, _part int, _s0 long, _n0 long"))
    carried = T.StructType([*events.schema.fields, T.StructField("_start", T.LongType()), T.StructField("carrito_n", T.LongType())])
    placed = parts.join(F.broadcast(entries), ["_client", "_part"], "left")  # at most a row a partition
    placed = placed.select(*events.columns, "_k", "_client", "_t", "_part", "_s0", "_n0").mapInPandas(_replay, carried)
    nowhere = e.filter("_client is null or _t is null").select(*events.columns, F.lit(None).cast("long").alias("_start"), F.lit(None).cast("long").alias("carrito_n"))
    return placed.unionByName(nowhere).withColumn(
        "creacion_carrito", F.timestamp_micros("_start").cast("timestamp_ntz")).drop("_start")
