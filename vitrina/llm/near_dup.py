"""Near-duplicate join on word n-grams: MinHash banding, then exact Jaccard.

Banding finds candidates, the full n-gram sets decide. Rows with the same word
sequence collapse to one representative first, so large groups of copies cost
one row. Bucket members are tied to the bucket's smallest member, the stars'
components hold every candidate pair, and each component is verified in blocks
of bounded size: the tasks return one link count per text and a spanning forest,
never the pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.shared import connected_components, id_or_last, written

WORDS = re.compile(r"\w+")
BLOCK = 256  # texts of a component in one block
CACHE = 200_000  # words a task remembers the hash of


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` hashes that find a pair at ``similarity`` with
    probability ``recall``: 1 - (1 - s^r)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word to 64-bit hash; remembers at most CACHE words."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


def word_hashes(texts: list, known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and the word count of each."""
    words = [WORDS.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    return flat, counts


def shingles(flat: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of all texts in a row, and how many each text has. A
    text of fewer than n words, but at least one, has a single n-gram: itself."""
    power = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(flat), np.uint64)
    full = max(0, len(flat) - n + 1)
    for k in range(n):
        h[:full] = h[:full] * power + flat[k : k + full]
    ends = np.cumsum(counts)
    starts = ends - counts
    valid = np.zeros(len(flat) + 1, np.int64)
    long = counts >= n
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - n + 1, -1)
    keep = np.cumsum(valid[:-1]) > 0
    for i in np.flatnonzero((counts > 0) & ~long):
        x = 0
        for w in flat[starts[i] : ends[i]]:
            x = (x * int(power) + int(w) + 1) & (2**64 - 1)
        h[starts[i]] = x ^ 0x5BD1E995
        keep[starts[i]] = True
    return mix(h[keep]), np.where(long, counts - n + 1, (counts > 0).astype(np.int64))


def _signatures(n: int, bands: int, rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(20240901)
        a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        known = WordHash()
        for whole in frames:
            for at in range(0, len(whole), 1000):
                frame = whole.iloc[at : at + 1000]
                flat, counts = word_hashes(frame["t"].tolist(), known)
                h, m = shingles(flat, counts, n)
                has = m > 0
                first = (np.cumsum(m) - m)[has]
                keys = np.zeros((int(has.sum()), bands), np.uint64)
                d1, d2 = np.zeros(len(m), np.uint64), np.zeros(len(m), np.uint64)
                if len(h):
                    for i in range(bands * rows):
                        least = np.minimum.reduceat(h * a[i] + b[i], first)
                        keys[:, i // rows] = mix(keys[:, i // rows] * np.uint64(31) + least)
                    place = np.arange(len(flat), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
                    begins = (np.cumsum(counts) - counts)[has]
                    d1[has] = np.add.reduceat(mix(flat + place * np.uint64(0x9E3779B97F4A7C15)), begins)
                    d2[has] = np.add.reduceat(mix(flat ^ mix(place + np.uint64(99))), begins)
                out = frame[["id", "th"]].copy()
                out["d1"], out["d2"] = d1.view(np.int64), d2.view(np.int64)
                out["n_words"] = counts
                bands_of = iter(keys.view(np.int64))
                out["bands"] = [next(bands_of) if x else None for x in has]
                yield out

    return run


def link_matrix(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of n-gram sets reach the Jaccard similarity."""
    size = np.array([len(s) for s in sets], np.float64)
    values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = times > 1  # an n-gram of one text adds to no intersection
    column = (np.cumsum(shared) - 1)[where]
    use = shared[where]
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = 8192
    for lo in range(0, int(shared.sum()), step):
        x, y = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((len(sets), step), np.float32)
        part[row[x:y], column[x:y] - lo] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    return both >= similarity * union - 1e-9


def _verify(n: int, similarity: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node", ignore_index=True)
        flat, counts = word_hashes(frame["t"].tolist(), WordHash())
        h, m = shingles(flat, counts, n)
        sets = [np.unique(x) for x in np.split(h, np.cumsum(m)[:-1])]
        link = link_matrix(sets, similarity)
        np.fill_diagonal(link, False)
        first, second = int(frame["b1"].iat[0]), int(frame["b2"].iat[0])
        if first != second:  # two blocks: only pairs across them
            side = (frame["block"] == first).to_numpy()
            link &= side[:, None] != side[None, :]
        copies = frame["copies"].to_numpy(np.int64)
        links = link.astype(np.int64) @ copies
        parent = np.arange(len(frame))
        for i in range(len(frame)):  # the forest: each text's component root
            if parent[i] != i:
                continue
            reach = np.zeros(len(frame), bool)
            edge = np.zeros(len(frame), bool)
            reach[i] = edge[i] = True
            while edge.any():
                edge = link[edge].any(axis=0) & ~reach
                reach |= edge
            parent[reach] = i
        node = frame["node"].to_numpy()
        return pd.DataFrame({"node": node, "root": node[parent], "links": links})

    return run


def near_dup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                     similarity: float = 0.8, recall: float = 0.999, rows: int = 4) -> DataFrame:
    """Class and links of every row: (id, th, class_id, n_links, class_size).

    ``th`` is xxhash64 of the text, so (id, th) names a row. ``class_id`` is the
    smallest id in the row's connected component of links, ``n_links`` the
    number of other rows whose n-gram set has at least the similarity, copies
    included. Words are ``\\w+`` in lower case; a text of one to four words is
    one n-gram; NULL texts and texts without words link to nothing. A repeated
    row is a copy. A NULL id counts as 2^63-1. An empty table gives no rows.
    """
    bands = bands_for(similarity, recall, rows)
    src = docs.select(id_or_last(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    src = src.withColumn("th", F.xxhash64("t"))
    sig = written(src.mapInPandas(_signatures(n, bands, rows), "id long, th long, d1 long, d2 long, n_words long, bands array<long>"), "signatures")
    texts = (sig.where("n_words > 0").groupBy("d1", "d2")
             .agg(F.min(F.struct("id", "th", "bands")).alias("r"), F.count("*").alias("copies"))
             .select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "r.id", "r.th", "copies", "r.bands"))
    texts = written(texts, "texts")
    keys = texts.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = keys.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    stars = keys.join(hubs.select("band", "key", "hub"), ["band", "key"]).where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    groups = connected_components(stars)
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    members = (groups.join(sizes, "label").join(texts.select("node", "id", "th", "copies"), "node")
               .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
               .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    members = written(members.select("node", "label", "id", "th", "copies", "blocks", "block"), "members")
    blocks = (src.join(members.hint("merge"), ["id", "th"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("label", "node", "t", "copies", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")))
    found = written(blocks.groupBy("label", "b1", "b2").applyInPandas(_verify(n, similarity), "node long, root long, links long"), "links")
    classes = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = texts.select("node", "d1", "d2", "id", "copies").join(classes, "node", "left").join(links, "node", "left")
    info = info.withColumn("label", F.coalesce("label", "node"))
    lead = info.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    info = info.join(lead, "label").select("d1", "d2", "class_id", "class_size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    some = sig.where("n_words > 0").join(info, ["d1", "d2"]).select("id", "th", "class_id", "n_links", "class_size")
    none = sig.where("n_words = 0").select("id", "th", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return some.union(none)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with
    the smallest (id, text hash) stays; of equal rows one."""
    rows = written(near_dup_classes(docs, id_col, text_col, **options), "classes")
    rows = rows.where("class_size > 1")
    first = rows.groupBy("class_id").agg(F.min(F.struct("id", "th")).alias("first"))
    marks = (rows.join(first, "class_id").groupBy("id", "th")
             .agg(F.bool_or(F.struct("id", "th") != F.col("first")).alias("gone"), (F.count("*") > 1).alias("doubled")).where("gone or doubled"))
    out = docs.select(F.struct("*").alias("row"), id_or_last(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"))
    out = out.join(marks.hint("merge"), ["id", "th"], "left").where("gone is null or not gone")
    single = out.where("doubled is null").select("row.*")
    return single.union(out.where("doubled").dropDuplicates(["id", "th"]).select("row.*"))
