"""Periodic runs of words, by seeds on diagonals that are extended.

A run of period q repeats its words q places on over at least max(12 - q, q)
places, so in each class of lags [Q, 2Q) every run holds two equal k-grams at its
own lag, one of them at a multiple of s, as long as k + s - 1 is no more than the
class's least overlap. The k-grams of a class are indexed by hash, the
same-document occurrence pairs with such a lag are enumerated (at most 2Q / s
for each place, whatever repeats), and each pair is extended along its
diagonal. A table of the furthest place covered at each lag, and the runs already
found, keep a stretch from being extended twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vitrina.llm.bpe_index import blocks

LEAST_LENGTH, LEAST_REPEATS = 12, 2
BLOCK_BYTES = 1_500_000  # of text searched at once; a longer text is a block of its own
PRIMES = (2147483629, 2147483587)  # moduli of the two word hashes
BASES = (911382323, 972663749)


def least_overlap(lag: int, length: int = LEAST_LENGTH) -> int:
    """Places at which a run of this period equals itself one period on."""
    return max(length - lag, (LEAST_REPEATS - 1) * lag)


def lag_classes(longest: int, length: int = LEAST_LENGTH) -> list[tuple[int, int, int, int]]:
    """(first lag, end of lags, k, s) of each class, for texts of up to so many words."""
    out, low = [], 1
    while LEAST_REPEATS * low <= longest:
        high = 4 if low == 1 else 2 * low
        overlap = min(least_overlap(q, length) for q in range(low, min(high, length + low + 1)))
        k = (overlap + 2) // 2 if overlap < 64 else overlap - overlap // 4
        out.append((low, high, k, overlap - k + 1))
        low = high
    return out


class GramHashes:
    """Hashes of every k-gram of a sequence of numbers, for any k, from two
    polynomial prefix sums."""

    def __init__(self, word: np.ndarray):
        n, self.parts = len(word), []
        rng = np.random.default_rng(20250311)
        for prime, base in zip(PRIMES, BASES):
            value = rng.integers(1, prime, int(word.max(initial=0)) + 1)[word]
            power = np.ones(n + 1, np.int64)
            width = 1
            while width <= n:  # powers by doubling
                step = power[width - 1] * base % prime
                power[width : 2 * width] = power[: min(width, n + 1 - width)] * step % prime
                width *= 2
            total = np.zeros(n + 1, np.int64)
            np.cumsum(value * power[:n] % prime, out=total[1:])
            self.parts.append((prime, total % prime, power))

    def at(self, places: np.ndarray, k: int) -> np.ndarray:
        """One 62-bit number per place; equal grams have equal numbers."""
        out = np.zeros(len(places), np.int64)
        for prime, total, power in self.parts:
            # scaled to one common exponent, so that places compare
            gram = (total[places + k] - total[places]) % prime * power[len(power) - 1 - places] % prime
            out = (out << 31) | gram
        return out


def seed_pairs(gram: np.ndarray, places: np.ndarray, low: int, high: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, lag) of equal grams with low <= lag < high, whose first
    place is a multiple of s. ``places`` ascend; ``gram`` may hold a document mark."""
    order = np.argsort(gram, kind="stable")
    sorted_gram, at = gram[order], places[order]
    group = np.cumsum(np.concatenate([[0], sorted_gram[1:] != sorted_gram[:-1]]))
    span = int(places[-1]) + high + 1
    key = group * span + at  # ascending
    left = np.flatnonzero(at % s == 0)
    first = np.searchsorted(key, key[left] + low)
    count = np.searchsorted(key, np.minimum(key[left] + high, (group[left] + 1) * span)) - first
    left, first, count = left[count > 0], first[count > 0], count[count > 0]
    here = np.repeat(left, count)
    there = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    return at[here], at[there] - at[here]


def matching(word: np.ndarray, i: int, j: int, step: int) -> int:
    """How many places from (i, j) on, in direction ``step``, hold equal words."""
    done, width = 0, 32
    while True:
        if step > 0:
            width = min(width, len(word) - max(i, j))
            a, b = word[i : i + width], word[j : j + width]
        else:
            width = min(width, 1 + min(i, j))
            a, b = word[i - width + 1 : i + 1][::-1], word[j - width + 1 : j + 1][::-1]
        if width <= 0:
            return done
        bad = np.flatnonzero(a != b)
        if len(bad):
            return done + int(bad[0])
        done += width
        i, j, width = i + step * width, j + step * width, 4 * width


def periodic_runs(word: np.ndarray, doc: np.ndarray, least_length: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of a sequence of word numbers.

    ``doc`` marks the document of each place, ascending; no run passes from one
    to the next (each document must be followed by a word of its own that
    occurs nowhere else). A run is longest for its smallest period q and has at
    least max(``least_length``, 2q) words.
    """
    if len(word) == 0:
        return []
    hashes = GramHashes(word)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(first, len(word)))
    places = np.arange(len(word))
    found: list[tuple[int, int, int]] = []
    extents: set[tuple[int, int]] = set()
    reach, period_at = np.zeros(len(word), np.int64), np.ones(len(word), np.int64)
    mark = (np.arange(len(first), dtype=np.int64) * 0x9E3779B1 + 1) << 20
    room = np.repeat(first + size, size)  # end of the place's document
    whole = np.repeat(size, size)
    classes = lag_classes(int(size.max()), least_length)
    for number, (low, high, k, s) in enumerate(classes):
        places = places[(whole[places] >= LEAST_REPEATS * low) & (places + k <= room[places])]
        if not len(places):
            break
        gram = hashes.at(places, k) ^ mark[np.searchsorted(first, places, "right") - 1]
        ordered = np.sort(gram)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        again = np.zeros(len(gram), bool)
        if len(twice):
            again = twice[np.minimum(np.searchsorted(twice, gram), len(twice) - 1)] == gram
        seeds, gram = places[again], gram[again]
        if all(k <= later for _, _, later, _ in classes[number + 1 :]):
            places = seeds  # a gram that stands once in its document begins no longer gram that stands twice
        if not len(seeds):
            continue
        start, lag = seed_pairs(gram, seeds, low, high, s)
        order = np.lexsort((start, lag))
        start, lag = start[order], lag[order]
        new = (reach[start] < start + lag + k) | (lag % period_at[start] != 0)
        covered: dict[int, int] = {}
        for i, q in zip(start[new].tolist(), lag[new].tolist()):
            if i < covered.get(q, 0) or (q % period_at[i] == 0 and i + q + k <= reach[i]):
                continue
            right = matching(word, i, i + q, 1)
            covered[q] = i + right  # the place there differs
            begin = i - matching(word, i - 1, i + q - 1, -1) if i else i
            end = i + right + q
            if end - begin >= max(least_length, LEAST_REPEATS * q) and (begin, end) not in extents:
                extents.add((begin, end))
                found.append((begin, end, q))
                further = reach[begin:end] < end
                reach[begin:end][further], period_at[begin:end][further] = end, q
    return found


def _runs_of(frames: Iterator[pa.RecordBatch], least_length: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        for lo, hi in blocks(batch.column("t"), BLOCK_BYTES):
            lists = [t.encode("utf-8", "surrogatepass").split() for t in batch.column("t").slice(lo, hi - lo).to_pylist()]  # bytes split at [\x20\x09-\x0D] only
            numbers: dict[bytes, int] = {}
            flat, starts = [], []
            for k, words in enumerate(lists):
                starts.append(len(flat))
                flat += [numbers.setdefault(w, len(numbers)) for w in words]
                flat.append(-1 - k)
            word = np.array(flat, np.int64)
            word[word < 0] = len(numbers) - 1 - word[word < 0]
            doc = np.repeat(np.arange(len(lists)), [len(w) + 1 for w in lists])
            runs: list[list[dict]] = [[] for _ in lists]
            drop = np.zeros(len(word) + 1, np.int64)
            for begin, end, period in sorted(periodic_runs(word, doc, least_length)):
                k = int(doc[begin])
                runs[k].append({"start": begin - starts[k], "length": end - begin, "period": period})
                drop[begin + period] += 1
                drop[end] -= 1
            kept = np.cumsum(drop) == 0
            collapsed = []
            for k, words in enumerate(lists):
                if runs[k]:
                    words = [w for w, stays in zip(words, kept[starts[k] :].tolist()) if stays]
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            counts = pa.array([len(w) for w in lists], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), counts, pa.array(runs, out.field("runs").type), pa.array(collapsed, pa.string())], schema=out)


def find_periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows (id, n_words, runs, collapsed) of every text.

    ``runs`` are structs (start, length, period; word numbers from 0) ordered by
    start, then period: each a stretch of words with smallest period q of at
    least max(``least_length``, 2q) words that keeps no period q one word further.
    ``collapsed`` joins by one space the words that no run holds after its first
    q words. Words are stretches without [\\x20\\x09-\\x0D].

    One row per input row in no order; repeated rows and ids stay, a NULL id
    stays NULL; a NULL or empty text has no words, no runs and an empty
    ``collapsed``; an empty table gives no rows; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    out = StructType([src.schema["id"], StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])
    arrow = to_arrow_schema(out)
    return src.mapInArrow(lambda frames: _runs_of(frames, least_length, arrow), out)
