"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders, so a re-parameterised
question keeps its template. Windows of template tokens of the benchmark and of
the documents are hash-joined. A document window is shuffled only if a
fixed-size bit filter of the benchmark's windows lets it through. What the
placeholders stood for must map one to one between question and document, inside
every window; names also along the whole passage. Windows that hold names have a
second hash with the names as plain lower-case words, for copies in other case.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.near_dup import mix
from vitrina.llm.shared import id_or_last, written

TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|\w+|[%$€£°]|[.!?\n]")
# Number words and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("% $ € £ ° km m cm mm kg g mg lb lbs oz mph kmh l ml km² m² s ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ton tons liter liters litre litres gallon gallons dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit".split())
WINDOW = 8
SHORTEST = 4  # windows need this many literal tokens
RUN = 13  # so many tokens in a row are a leak whatever the item's length
FILTER_BITS = 24  # the filter has 2^24 bits (2 MB) whatever the benchmark's size
CACHE = 200_000
LITERAL, NUMBER, UNIT, TITLE, END = range(5)


class Tokens(dict):
    """Token to (64-bit hash, kind); remembers at most CACHE tokens."""

    def __missing__(self, token: str) -> tuple[int, int]:
        low = token.lower()
        if token in ".!?\n":
            kind = END
        elif token[0].isdecimal() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif len(token) > 1 and token[0].isupper() and token[1:].islower():
            kind = TITLE
        else:
            kind = LITERAL
        out = (xxhash.xxh3_64_intdigest(low), kind)
        if len(self) < CACHE:
            self[token] = out
        return out


def template(texts: list[str], known: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: template hash, the same with names as words, value
    hash, is-slot and is-name of every token, and the token count of each text.
    The last bit of a value hash tells names from numbers and units.

    A number word or digits are a number; a unit counts as one only after a
    number; a title-case word is a name unless a sentence begins with it.
    """
    found = [TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    total = int(sizes.sum())
    flat = np.fromiter((x for ws in found for w in ws for x in known[w]), np.uint64, 2 * total).reshape(total, 2)
    value, kind = flat[:, 0].copy(), flat[:, 1].astype(np.int8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.ones(total, bool)
    begin[1:] = (kind[:-1] == END) | (owner[1:] != owner[:-1])
    keep = kind != END
    value, kind, owner, begin = value[keep], kind[keep], owner[keep], begin[keep]
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])
    number, unit, name = kind == NUMBER, (kind == UNIT) & after_number, (kind == TITLE) & ~begin
    plain = value.copy()
    plain[number], plain[unit] = 11, 13
    shape = plain.copy()
    shape[name] = 17
    value = (value & ~np.uint64(1)) | name.astype(np.uint64)
    return shape, plain, value, number | unit | name, name, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def windows(shape: np.ndarray, slot: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` tokens inside one text with at least
    SHORTEST literal tokens, and their places in the row of tokens."""
    n = len(shape) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + shape[k : k + n]
    owner = np.repeat(np.arange(len(counts)), counts)
    literal = np.concatenate([[0], np.cumsum(~slot)])
    ok = (owner[:n] == owner[size - 1 :]) & (literal[size:] - literal[:n] >= SHORTEST)
    at = np.flatnonzero(ok)
    return mix(h[at]), at


def both_windows(shape: np.ndarray, plain: np.ndarray, slot: np.ndarray, name: np.ndarray, counts: np.ndarray,
                 size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes and places of all windows, then of those that hold names once more
    with the names as words; each with the slots that its hashes leave open."""
    yield *windows(shape, slot, counts, size), slot
    h, at = windows(plain, slot & ~name, counts, size) if name.any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    held = np.concatenate([[0], np.cumsum(name)])
    some = held[np.minimum(at + size, len(name))] > held[at]
    yield h[some], at[some], slot & ~name


def _benchmark_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Tokens()
    for frame in frames:
        rows = []
        for item, text in zip(frame["item_id"], frame["t"]):
            shape, plain, value, slot, name, counts = template([text], known)
            size = min(WINDOW, len(shape))
            if size < SHORTEST:
                continue
            places: set[int] = set()
            for h, at, open_ in both_windows(shape, plain, slot, name, counts, size):
                places = places or set(at.tolist())  # those of the first hashes count
                for x, p in zip(h, at):
                    if int(p) in places:
                        rows.append((item, int(np.int64(x.view(np.int64))), size, int(p), len(places), value[p : p + size][open_[p : p + size]].view(np.int64).tolist()))
        yield pd.DataFrame(rows, columns=["item_id", "h", "size", "b", "n", "b_slots"])


def _document_windows(sizes: list[int], bits: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Tokens()
        for whole in frames:
            for lo in range(0, len(whole), 1000):
                frame = whole.iloc[lo : lo + 1000]
                shape, plain, value, slot, name, counts = template(frame["t"].tolist(), known)
                owner = np.repeat(np.arange(len(counts)), counts)
                starts = np.cumsum(counts) - counts
                out = []
                for size in sizes:
                    for h, at, open_ in both_windows(shape, plain, slot, name, counts, size):
                        place = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        may = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                        h, at = h[may], at[may]
                        who = owner[at]
                        out.append(pd.DataFrame({"id": frame["id"].to_numpy()[who], "th": frame["th"].to_numpy()[who], "h": h.view(np.int64), "p": at - starts[who],
                                                 "d_slots": pd.Series([value[p : p + size][open_[p : p + size]].view(np.int64).tolist() for p in at], dtype=object)}))
                yield pd.concat(out, ignore_index=True)

    return run


def contradictions(pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """The pairs of names of which one stands for several others and nowhere for
    itself. Where it stands for itself too, the other pair is a misspelt name."""
    names = [(x, y) for x, y in pairs if x & 1]
    others: dict[tuple[int, int], set[int]] = defaultdict(set)
    for x, y in names:
        others[0, x].add(y)
        others[1, y].add(x)
    split = lambda side, one: len(others[side, one]) > 1 and one not in others[side, one]
    return {(x, y) for x, y in names if split(0, x) or split(1, y)}


def _alignments(min_coverage: float):
    """Of every alignment of a document with an item: the places in the item of
    its consistent windows, the most tokens in a row they cover, and how many
    slots these have and change.

    A window is consistent if its slots map one to one. If names contradict each
    other along the alignment, the windows that hold them count against the
    others; if too few are left, it is another question, and only windows
    without any changed slot count.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, (n, hits) in enumerate(zip(frame["n"], frame["hits"])):
                found = []
                for w in hits:
                    w = w.tolist()
                    half = len(w) // 2 + 1
                    pairs = set(zip(w[2:half], w[half:]))
                    if len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs):
                        found.append((w[0], w[1], pairs))
                clash = contradictions(set().union(*(pairs for _, _, pairs in found)))
                if clash:
                    bad = {b for b, _, pairs in found if pairs & clash}
                    rest = [f for f in found if f[0] not in bad]
                    same = [f for f in found if all(x == y for x, y in f[2])]
                    found = rest if len({f[0] for f in rest}) - len(bad) >= min_coverage * n else same
                if not found:
                    continue
                longest = begin = end = 0
                for b, size in sorted({f[:2] for f in found}):
                    if b > end:
                        begin = b
                    end = b + size
                    longest = max(longest, end - begin)
                pairs = set().union(*(f[2] for f in found))
                out.append((row, sorted({f[0] for f in found}), longest, len(pairs), sum(x != y for x, y in pairs)))
            got = pd.DataFrame(out, columns=["row", "found", "run", "slots", "changed"])
            keys = frame[["id", "th", "item_id", "n"]].iloc[got["row"].to_numpy(np.int64)].reset_index(drop=True)
            yield pd.concat([keys, got.drop(columns="row")], axis=1)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = 0.4) -> DataFrame:
    """Pairs of document and benchmark item whose template windows meet.

    Rows (id, th, item_id, coverage, n_windows, n_slots, n_changed): ``th`` is
    xxhash64 of the text; ``coverage`` the share of the item's windows found in
    the document with consistent slots (a value always meets the same value, both
    ways, inside a window; see ``_alignments`` for names); ``n_changed`` the slots whose value differs: 0
    means a verbatim leak, more a re-parameterised one. Pairs below
    ``min_coverage`` are a leak only if one such alignment covers RUN tokens in a
    row: a passage of a long item. Items of fewer than 8 tokens are one window;
    items with fewer than 4 literal tokens, NULL and empty items match nothing,
    as do NULL and empty texts. Repeated documents are one row; equal items
    each have theirs. A NULL document id counts as 2^63-1, NULL item ids stay.
    """
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    items = written(items.mapInPandas(_benchmark_windows, "item_id long, h long, size int, b int, n int, b_slots array<long>"), "bench_windows")
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most WINDOW - SHORTEST + 1
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = items.select((place / 8).cast("int").alias("w"), F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) % 8 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in words.collect():  # at most 2^21 bytes of the filter
        bits[r["w"]] = r["v"]
    src = docs.select(id_or_last(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    schema = "id long, th long, h long, p int, d_slots array<long>"
    if not sizes:
        hits = docs.sparkSession.createDataFrame([], schema)
    else:
        hits = src.select("id", "th", "t").mapInPandas(_document_windows(sorted(sizes), bits), schema)
    line = ["id", "th", "item_id", "diagonal"]
    hit = F.concat(F.array(F.col("b").cast("long"), F.col("size").cast("long")), "b_slots", "d_slots").alias("hit")
    pairs = hits.join(items, "h").select("id", "th", "item_id", (F.col("p") - F.col("b")).alias("diagonal"), "n", hit)
    lines = pairs.groupBy(*line).agg(F.max("n").alias("n"), F.collect_set("hit").alias("hits")).drop("diagonal")
    lines = written(lines.mapInPandas(_alignments(min_coverage), "id long, th long, item_id long, n int, found array<int>, run int, slots long, changed long"), "bench_lines")
    pair = ["id", "th", "item_id"]
    cover = lines.select(*pair, "n", "run", F.explode("found").alias("b")).groupBy(*pair).agg(
        F.max("n").alias("n"), F.max("run").alias("run"), F.count_distinct("b").cast("int").alias("n_windows"))
    cover = cover.withColumn("coverage", F.col("n_windows") / F.col("n")).where((F.col("coverage") >= min_coverage) | (F.col("run") >= RUN))
    marks = lines.groupBy(*pair).agg(F.sum("slots").alias("slots"), F.sum("changed").alias("changed"))
    same = (cover["id"] == marks["id"]) & (cover["th"] == marks["th"]) & cover["item_id"].eqNullSafe(marks["item_id"])
    return cover.join(marks, same, "left").select(
        cover["id"], cover["th"], cover["item_id"], "coverage", "n_windows",
        F.coalesce("slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("changed", F.lit(0)).cast("long").alias("n_changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = contaminated(docs, benchmark, id_col, text_col).select("id", "th").distinct()
    rows = docs.select(F.struct("*").alias("row"), id_or_last(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"))
    return rows.join(bad, ["id", "th"], "left_anti").select("row.*")
