"""Sequence packing as a cutting-stock problem solved by column generation.

Documents become token pieces in one pass: full pieces of the sequence length,
and a rest. The lengths' histogram in classes is all the driver sees. A linear
program over patterns (what classes fill a sequence) is grown column by column,
each priced by an unbounded knapsack; the rounded patterns become a table of
slots per class, and the n-th piece of a class takes its n-th slot.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrina.llm.shared import id_or_last, written

SEQUENCE = 4096
CLASS_WIDTH = 16
UNITS = SEQUENCE // CLASS_WIDTH
BUCKET_ROWS = 1_000  # pieces of a class ranked in one window, about
WORD_CACHE, CORE_CACHE = 120_000, 250_000
MARKS = ".,;:!?"
# Lower-case letters whose case and composition all Unicode libraries agree on.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
ODD = re.compile("[\x1c-\x1f]|<\\|")


class PieceTokenizer:
    """Ids of a text as native (little-endian) unsigned 32-bit bytes.

    White space always ends a token of this vocabulary, so the ids of a text are
    those of its words in a row. Frequent words are remembered (bounded); a rare
    word of plain letters goes to the BPE model directly, any other through the
    whole tokenizer. Texts with control separators or special-token marks are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, core: str) -> bytes:
        got = self.cores.get(core)
        if got is None:
            if PLAIN.fullmatch(core):
                word = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
                got = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            else:
                got = self._encoded(core)
            if len(self.cores) < CORE_CACHE:
                self.cores[core] = got
        return got

    def _word(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        low = core.lower()
        if core and PLAIN.fullmatch(low) and unicodedata.is_normalized("NFC", core):
            got = self._core(low) + (self._core(word[len(core):]) if len(core) < len(word) else b"")
        else:
            got = self._encoded(word)
        if len(self.words) < WORD_CACHE:
            self.words[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if ODD.search(text):
            return self._encoded(text)
        get = self.words.get
        return b"".join([get(w) or self._word(w) for w in text.split()])


@functools.cache
def tokenizer_at(path: str) -> PieceTokenizer:
    """One tokenizer for all tasks of a worker, so that its words stay known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceTokenizer(path)


def _pieces(path: str, end_id: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_at(path)
        end = np.array([end_id], "<u4").tobytes()
        for frame in frames:
            rows = []
            for doc, key, text in zip(frame["doc"], frame["id"], frame["t"]):
                ids = tokenizer.ids(text) + end
                n = len(ids) // 4
                for at in range(0, n, SEQUENCE):
                    part = ids[4 * at : 4 * (at + SEQUENCE)]
                    rows.append((doc, key, at, len(part) // 4, zlib.crc32(part), n))
            out = pd.DataFrame(rows, columns=["doc", "id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc"] = out["doc"].astype("Int64")
            yield out

    return run


def best_pattern(price: np.ndarray, size: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within units."""
    value = np.zeros(units + 1)
    take = np.full(units + 1, -1)
    for w in range(1, units + 1):
        fits = int(np.searchsorted(size, w, "right"))
        value[w] = value[w - 1]
        if fits:
            v = value[w - size[:fits]] + price[:fits]
            k = int(v.argmax())
            if v[k] > value[w] + 1e-12:
                value[w], take[w] = v[k], k
    pattern, w = np.zeros(len(size)), units
    while w > 0:
        if take[w] < 0:
            w -= 1
        else:
            pattern[take[w]] += 1
            w -= size[take[w]]
    return float(value[units]), pattern


def column_generation(size: np.ndarray, demand: np.ndarray, units: int, most_columns: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns of the basis) and how often each is used, as reals.

    Revised simplex from the patterns of one size each; every entering column is
    the knapsack's answer to the dual prices. After ``most_columns`` columns the
    feasible solution at hand is returned.
    """
    basis = np.diag((units // size).astype(float))
    for _ in range(most_columns):
        price = np.linalg.solve(basis.T, np.ones(len(size)))
        value, column = best_pattern(price, size, units)
        if value <= 1 + 1e-7:
            break
        use, change = np.linalg.solve(basis, np.stack([demand.astype(float), column], 1)).T
        ratio = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return basis, np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


def packing_plan(histogram: dict[int, int], units: int = UNITS) -> dict[int, list[tuple[int, int, int]]]:
    """Slots by class: (first rank, first sequence, copies in each sequence).

    Patterns are used as often as the linear program says, rounded down; what is
    left over is packed first-fit by decreasing size. Every rank below the
    class's count has exactly one slot.
    """
    plan: dict[int, list[tuple[int, int, int]]] = {c: [] for c in histogram}
    size = np.array(sorted(c for c, n in histogram.items() if n > 0), np.int64)
    if not len(size):
        return plan
    demand = np.array([histogram[int(c)] for c in size], np.int64)
    basis, use = column_generation(size, demand, units)
    left, rank, sequence = demand.copy(), np.zeros(len(size), np.int64), 0

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        for i in np.flatnonzero(pattern):
            plan[int(size[i])].append((int(rank[i]), sequence, int(pattern[i])))
            rank[i] += times * pattern[i]
            left[i] -= times * pattern[i]
        sequence += times

    for k in range(len(size)):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        times = int(use[k] + 1e-6)
        if (pattern > 0).any():
            times = min(times, int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if times > 0:
                place(pattern, times)
    while left.any():
        pattern, room = np.zeros(len(size), np.int64), units
        for i in range(len(size) - 1, -1, -1):
            pattern[i] = min(left[i], room // size[i])
            room -= pattern[i] * size[i]
        place(pattern, max(1, int((left[pattern > 0] // pattern[pattern > 0]).min())))
    return plan


def _slots(plan: dict[int, list[tuple[int, int, int]]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = {c: np.array(v, np.int64) for c, v in plan.items()}
        for frame in frames:
            out = np.zeros(len(frame), np.int64)
            kind, rank = frame["class"].to_numpy(), frame["rank"].to_numpy()
            for c in np.unique(kind):
                at, a = kind == c, arrays[int(c)]
                k = np.searchsorted(a[:, 0], rank[at], "right") - 1
                out[at] = a[k, 1] + (rank[at] - a[k, 0]) // a[k, 2]
            frame["sequence_id"] = out
            yield frame.drop(columns=["class"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document's ids end with ``end_id``; a NULL or empty
    text is that id alone. Documents are cut at multiples of 4096 only. Repeated
    rows are packed each; rows without id keep a NULL doc_id. An empty table
    gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc"), id_or_last(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    piece = "doc long, id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = src.mapInPandas(_pieces(tokenizer_path, end_id), piece)
    pieces = written(pieces.withColumn("class", F.ceil(F.col("length") / CLASS_WIDTH).cast("int")), "pieces")
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most UNITS rows
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = (pieces.groupBy("class", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("class", "bucket", "before"))
    order = Window.partitionBy("class", "bucket").orderBy("id", "start", "ids_crc32")
    ranked = (pieces.withColumn("r", F.row_number().over(order)).join(before, ["class", "bucket"])
              .select("doc", "id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("r") - 1 + F.col("before")).alias("rank")))
    placed = ranked.mapInPandas(_slots(packing_plan(histogram)), piece + ", rank long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
