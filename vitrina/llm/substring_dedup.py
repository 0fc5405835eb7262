"""Substring deduplication by content-defined chunking.

A gear rolling hash over the text's bytes cuts where its top bits are zero, so
cuts depend on the last 16 bytes only and come back into step after an
insertion. Chunks are compared by 128-bit digests; runs of chunks that an
earlier document holds are repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.shared import id_or_last, written

CUT_BITS, SHORTEST, LONGEST = 5, 16, 256  # about 48 bytes a chunk
MIN_PASSAGE = 80  # bytes of repeated chunks in a row
GEAR = np.random.default_rng(20240902).integers(0, 2**16, 256, dtype=np.uint16)


def cut_places(data: bytes) -> np.ndarray:
    """Places after which the gear hash says to cut: h = (h << 1) + gear[byte]
    over 16 bits, computed for all places at once by doubling."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return np.flatnonzero(h >> np.uint16(16 - CUT_BITS) == 0) + 1


def chunk_ends(cuts: list[int], size: int) -> list[int]:
    """Ends of the chunks: cuts at least SHORTEST apart; gaps above LONGEST are
    divided at fixed steps."""
    ends, last = [], 0
    for c in [*cuts, size]:
        while c - last > LONGEST + SHORTEST:
            last += LONGEST
            ends.append(last)
        if c - last >= SHORTEST or c == size and c > last:
            ends.append(c)
            last = c
    return ends


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in frames:
        for lo in range(0, len(whole), 500):
            frame = whole.iloc[lo : lo + 500]
            data = [t.encode("utf-8", "surrogatepass") for t in frame["t"]]
            ids, hashes, number, start, size, digest = [], [], [], [], [], []
            for doc, th, d in zip(frame["id"], frame["th"], data):
                ends = chunk_ends(cut_places(d).tolist(), len(d)) if d else []
                begin = 0
                for k, e in enumerate(ends):
                    digest.append(xxhash.xxh3_128_digest(d[begin:e]))
                    start.append(begin)
                    size.append(e - begin)
                    number.append(k)
                    begin = e
                ids += [doc] * len(ends)
                hashes += [th] * len(ends)
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id": np.array(ids, np.int64), "th": np.array(hashes, np.int64), "k": np.array(number, np.int32), "at": np.array(start, np.int32), "n": np.array(size, np.int32), "d1": both[:, 0], "d2": both[:, 1]})


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_PASSAGE) -> DataFrame:
    """Passages an earlier document holds: rows (id, th, start, length,
    n_chunks, first_id), byte offsets in the UTF-8 text.

    A chunk is repeated if its digest occurs under a smaller id. Neighbouring
    repeated chunks form a run; runs below ``min_bytes`` are chance and are left
    out. ``first_id`` is the smallest id that holds one of the run's chunks, so
    the first copy of a passage is never reported. Repeats inside a document, or
    between rows with one id, do not count. Equal rows are reported once; NULL
    and empty texts have no chunks; a NULL id counts as 2^63-1; an empty table
    gives no rows.
    """
    src = docs.select(id_or_last(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    chunks = written(src.mapInPandas(_chunks, "id long, th long, k int, at int, n int, d1 long, d2 long"), "chunks")
    firsts = (chunks.groupBy("d1", "d2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
              .where("first_id < last_id").select("d1", "d2", "first_id"))
    again = chunks.join(firsts, ["d1", "d2"]).where("id > first_id").select("id", "th", "k", "at", "n", "first_id")
    # (id, th) holds one text's own repeated chunks only
    runs = again.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("k", "at", "n", "first_id"))).alias("c"))
    runs = runs.mapInPandas(_runs(min_bytes), "id long, th long, start long, length long, n_chunks int, first_id long")
    return runs


def _runs(min_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, th, chunks in zip(frame["id"], frame["th"], frame["c"]):
                k = np.array([c["k"] for c in chunks])
                for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k) != 1) + 1):
                    first, last = chunks[part[0]], chunks[part[-1]]
                    length = last["at"] + last["n"] - first["at"]
                    if length >= min_bytes:
                        rows.append((doc, th, first["at"], length, len(part), min(chunks[i]["first_id"] for i in part)))
            yield pd.DataFrame(rows, columns=["id", "th", "start", "length", "n_chunks", "first_id"])

    return run


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_PASSAGE) -> DataFrame:
    """``docs`` as struct ``row`` with ``kept_text``: the text without repeated
    passages, whole characters only."""
    spans = repeated_passages(docs, id_col, text_col, min_bytes).groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("cut"))

    @F.pandas_udf("string")
    def without(text: pd.Series, cut: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(text, cut):
            if spans_ is not None and len(spans_):
                data, at, keep = t.encode("utf-8", "surrogatepass"), 0, []
                for s in spans_:
                    keep.append(data[at : s["start"]])
                    at = s["start"] + s["length"]
                t = b"".join([*keep, data[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out)

    rows = docs.select(F.struct("*").alias("row"), id_or_last(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("th", F.xxhash64("t")).join(spans, ["id", "th"], "left")
    return rows.select("row", without("t", "cut").alias("kept_text"))
