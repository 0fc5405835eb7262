"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve orders the vectors by the Hilbert key of a random projection, shifted
at random. Quantiles of the keys divide every order into ranges of about equal
size; a query meets the ranges around its own place on every curve, and the
candidates of all curves are merged by their exact inner products. Equal vectors
are one place on the curves, which stands for the smallest of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrina.llm.near_dup import mix
from vitrina.llm.shared import written

CURVES, DIMS, BITS = 8, 8, 5
TIE_BITS = 12  # a hash of id and curve behind the key divides the vectors of one cell, on every curve in another order
RANGES, RANGE_ROWS = 32, 4096  # ranges per curve: RANGES, or more if they had more rows
SMALL_RANGE = 128  # tables of a few such ranges are divided less, so that every query meets enough rows
WINDOW = 0.1  # part of the order that a query meets on either side of its range
QUERY_ROWS = 4096  # queries that meet a range in one task, about
SAMPLE = 10_000  # vectors that scale the projections


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, d): Gray-code transposition of the
    axes, then interleaving of their bits."""
    x = cells.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        for i in range(d):
            on = (x[i] & q) > 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & (q - one))
            x[0] = np.where(on, x[0] ^ (q - one), x[0]) ^ swap
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        flip = np.where((x[d - 1] & q) > 0, flip ^ (q - one), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def projections(dim: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Orthonormal projections of every curve, and its shifts."""
    rng = np.random.default_rng(20240903)
    out: list[np.ndarray] = []
    while len(out) < CURVES:
        full = np.linalg.qr(rng.standard_normal((max(dim, DIMS), max(dim, DIMS))))[0][:dim]
        out += [full[:, k : k + DIMS] for k in range(0, full.shape[1] - DIMS + 1, DIMS)]
    return out[:CURVES], rng.random((CURVES, DIMS)) * 0.5


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Points on the unit sphere whose nearest neighbour to a query (x / |x|, 0)
    has the largest inner product."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])


def _keys(dim: int, longest: float, mean: np.ndarray, spread: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, shifts = projections(dim + 1)

        def keys(points: np.ndarray, tie: np.ndarray) -> np.ndarray:
            out = np.zeros((len(points), CURVES), np.int64)
            for c in range(CURVES):
                last = (mix(tie + np.uint64(c)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
                z = (points @ planes[c] - mean[c]) / spread[c]
                cells = np.clip((z + 4 + shifts[c]) / 8.5, 0, 1 - 1e-9) * (1 << BITS)
                out[:, c] = (hilbert_keys(cells.astype(np.uint64), BITS) << np.uint64(TIE_BITS)).astype(np.int64) | last
            return out

        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
            tie = frame["h1"].to_numpy(np.int64).view(np.uint64)
            frame["keys"] = list(keys(lifted(x, longest), tie))
            unit = x / np.sqrt((x * x).sum(1, keepdims=True))
            frame["query_keys"] = list(keys(np.hstack([unit, np.zeros((len(x), 1))]), tie))
            yield frame[["h1", "h2", "ids", "embedding", "keys", "query_keys"]]

    return run


def _nearest(k: int):
    """The ``k`` places with the largest products of every query place, ties to
    the smaller first id; each place with its ids."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"q1": np.zeros(0, np.int64), "q2": np.zeros(0, np.int64), "ids": np.zeros(0, object), "score": np.zeros(0)})
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        q = np.stack(queries["query"].to_numpy()).astype(np.float64)
        ids = rows["ids"].to_numpy()
        first = np.fromiter((i[0] for i in ids), np.int64, len(ids))
        q1, q2 = queries["q1"].to_numpy(np.int64), queries["q2"].to_numpy(np.int64)
        out = []
        for lo in range(0, len(q), 512):
            near = q[lo : lo + 512] @ x.T
            kth = -np.partition(-near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            # the order of summation in a matrix product varies: sums within the rounding error are kept, then made exactly alike
            a, b = np.nonzero(near >= (kth - 1e-9 * np.maximum(1, np.abs(kth)))[:, None])
            score = np.zeros(len(a))
            for at in range(0, len(a), 100_000):
                s = slice(at, at + 100_000)
                score[s] = np.cumsum(q[lo + a[s]] * x[b[s]], axis=1)[:, -1]
            order = np.lexsort((first[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            a, b, score = a[place < k], b[place < k], score[place < k]
            out.append(pd.DataFrame({"q1": q1[lo + a], "q2": q2[lo + a], "ids": ids[b], "score": score}))
        return pd.concat(out, ignore_index=True)

    return run


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
                       window: float = WINDOW) -> DataFrame:
    """The ``k`` nearest found for the rows where ``is_query``, by inner product.

    Rows (query_id, rank, vec_id, score), ties to the smaller id. Vectors that
    are NULL, empty, all zero, or hold NULL, NaN or infinite components, rows
    without id, and vectors whose length is not the commonest take no part. Rows
    that repeat an id count as one candidate with its best score, and never meet
    a query of that id. An empty table gives no rows. Equal vectors are indexed
    once, with their ``k + 1`` smallest ids, which is all that a list of ``k``
    without the query's own id can hold; at most SAMPLE vectors scale the
    projections.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim, _, longest = sizes[0]
    equal = ["h1", "h2"]
    rows = rows.where(F.size("embedding") == dim).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    points = lifted(np.unique(np.array([r["embedding"] for r in sample], float), axis=0), longest)
    planes, _ = projections(dim + 1)
    mean = np.array([(points @ p).mean(0) for p in planes])
    spread = np.array([(points @ p).std(0) + 1e-12 for p in planes])
    element = rows.schema["embedding"].dataType.simpleString()
    # ranks up to a bound are cut in every task before the shuffle: of a large group of equal vectors few rows are sent
    places = (rows.select(*equal, "vec_id", "embedding").withColumn("rank", F.dense_rank().over(Window.partitionBy(*equal).orderBy("vec_id"))).where(F.col("rank") <= k + 1)
              .groupBy(*equal).agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("embedding").alias("embedding")))
    keyed = places.mapInPandas(_keys(dim, longest, mean, spread), f"h1 long, h2 long, ids array<long>, embedding {element}, keys array<long>, query_keys array<long>")
    keyed = written(keyed, "hilbert_keys")
    total = keyed.count()
    ranges = max(min(RANGES, total // SMALL_RANGE + 1), -(-total // RANGE_ROWS))
    cuts = [] if ranges == 1 else (keyed.select(F.posexplode("keys").alias("curve", "key")).groupBy("curve")
            .agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("cuts")).collect())
    cuts_of = dict.fromkeys(range(CURVES), np.zeros(0, np.int64)) | {r["curve"]: np.array(r["cuts"], np.int64) for r in cuts}

    @F.pandas_udf("int")
    def range_of(curve: pd.Series, key: pd.Series) -> pd.Series:
        got = np.zeros(len(key), np.int32)
        c, v = curve.to_numpy(), key.to_numpy()
        for one in np.unique(c):
            got[c == one] = np.searchsorted(cuts_of[int(one)], v[c == one], "right")
        return pd.Series(got)

    side = max(1, round(window * ranges))
    queries = vectors.where(is_query).select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    queries = written(rows.select(*equal, "vec_id").join(queries, "vec_id", "left_semi").distinct(), "hilbert_queries")
    asking = keyed.join(queries.select(*equal).distinct(), equal, "left_semi")
    parts = max(1, round(asking.count() * (2 * side + 1) / ranges / QUERY_ROWS))
    placed = (keyed.select("ids", "embedding", F.posexplode("keys").alias("curve", "key"))
              .select("ids", "embedding", "curve", range_of("curve", "key").alias("range"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    asking = (asking.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("embedding").alias("query"), F.posexplode("query_keys").alias("curve", "key"))
              .select("q1", "q2", "query", "curve", range_of("curve", "key").alias("own"), F.pmod(F.xxhash64("q1"), F.lit(parts)).cast("int").alias("part"))
              .select("q1", "q2", "query", "curve", "part", F.explode(F.sequence(F.greatest(F.lit(0), F.col("own") - side), F.least(F.lit(ranges - 1), F.col("own") + side))).alias("range")))
    block = ["curve", "range", "part"]
    found = placed.groupBy(*block).cogroup(asking.groupBy(*block)).applyInPandas(_nearest(k + 1), "q1 long, q2 long, ids array<long>, score double")
    best = found.select("q1", "q2", "score", F.explode("ids").alias("vec_id")).groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score"))
    rank = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("rank", rank("q1", "q2")).where(F.col("rank") <= k + 1)
    lists = best.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    got = queries.withColumnRenamed("vec_id", "query_id").join(lists, equal).select("query_id", F.inline("near")).where("vec_id <> query_id")
    got = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return got.withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
