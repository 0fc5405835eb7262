"""Brown class n-grams: log probabilities of whole texts.

Every training word has a class. The exchange algorithm first clusters a fixed
number of seed units (the most frequent words, and suffix groups for all others)
from their bigram counts; their classes are the contexts. Then the counts of
every word beside each context, on either side, are gathered by a shuffle on the
word, and some rounds of exchange move each word to the class that gains most
information. A text's probability is

    P(class of word | context of the word before) * P(word | class),

each smoothed. A bounded head of frequent words is broadcast with classes and
counts; all other words are looked up by a shuffle on their hash, so no
vocabulary has to fit anywhere and what is learned grows with the corpus. With
the head known, texts are written as numbers, which all later steps read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.shared import written

HEAD = 131_072  # words broadcast with their counts and classes
HEAD_BYTES = 48  # longer words never belong to the head, so it has at most 6.3 MB
HEAD_SHARE = 2.0**-19  # a word with this share of any task's tokens is a candidate for the head
TASK_WORDS = 400_000  # words a task counts exactly before it merges the rarest away
WORD_UNITS, SUFFIX_UNITS = 640, 383  # seed units of the exchange
UNITS = WORD_UNITS + SUFFIX_UNITS + 1  # the last unit is the end of a text
END = UNITS - 1
CLASSES = 48  # the last class is the end of a text
ROUNDS = 8  # exchange rounds over the seed units
WORD_ROUNDS = 2  # exchange rounds over all words
SIDES = 2 * CLASSES  # contexts before a word, then contexts after it
RARE_TOKENS = 2_000_000  # neighbour places of rare words a task holds before it adds them up
ENTRIES = 100_000  # neighbour counts in one exchange step
DELTA = 0.1  # added to word counts, and to unit counts of the seed
PRIOR = 5.0  # weight of the class unigrams in a context's transitions


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def suffix_unit(word: bytes) -> int:
    return WORD_UNITS + zlib.crc32(word[-3:]) % SUFFIX_UNITS


def training_row(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 != 0


def tokens(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _head_candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frequent words of a task with a lower bound of their counts. When there
    are too many words, all counts go down by the smallest kept one."""
    count: Counter = Counter()
    total = 0
    for frame in frames:
        for t in frame["t"]:
            words = tokens(t)
            total += len(words)
            count.update(words)
            if len(count) > 2 * TASK_WORDS:
                cut = sorted(count.values(), reverse=True)[TASK_WORDS]
                count = Counter({w: n - cut for w, n in count.items() if n > cut})
    keep = [(w, n) for w, n in count.items() if n >= max(2, HEAD_SHARE * total) and len(w) <= HEAD_BYTES]
    yield pd.DataFrame(keep, columns=["word", "n"])


def _numbers(texts, place_of: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """All texts in a row, each with a closing end: of every token its place in
    the head (HEAD: end, below 0: -1 - unit of a rare word), token counts of the
    texts, the rare words in order and their counts."""
    words, ends = [], []
    for t in texts:
        words += tokens(t)
        words.append(b"")
        ends.append(len(words))
    place = np.fromiter(map(place_of.get, words, repeat(-1)), np.int32, len(words))
    at = np.flatnonzero(place < 0)
    rare = [words[i] for i in at.tolist()]
    place[at] = np.fromiter((-1 - suffix_unit(w) for w in rare), np.int32, len(rare))
    return place, np.diff(ends, prepend=0), rare, np.diff(np.searchsorted(at, ends), prepend=0)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A column of bytes whose rows are the next ``counts`` values each."""
    ends = np.append(0, np.cumsum(counts) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _values(column: Iterable[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype)


def numbered(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """``texts`` (column ``t``) with every text in numbers, so that it is cut into
    words once: ``place`` has an int32 for each token as in ``_numbers``, ``rare``
    the 64-bit hashes of its rare words. All other columns stay."""
    others = [c for c in texts.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of = {w: i for i, w in enumerate(words)} | {b"": HEAD}
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                part = whole.slice(lo, 2000)
                place, counts, rare, rare_counts = _numbers(part.column("t").to_pylist(), place_of)
                yield pa.RecordBatch.from_arrays([*map(part.column, others), _binary(place, counts), _binary(_hashes(rare), rare_counts)], [*others, "place", "rare"])

    schema = texts.select(*others).schema.add("place", "binary").add("rare", "binary")
    return written(texts.mapInArrow(run, schema), "lm_tokens", compression="zstd")


def _units(head_unit: np.ndarray) -> np.ndarray:
    """Unit of every place; places below 0 count from the back."""
    unit = np.zeros(HEAD + 1 + UNITS, np.int64)
    unit[: len(head_unit)] = head_unit
    unit[HEAD] = END
    unit[HEAD + 1 :] = np.arange(UNITS)[::-1]
    return unit


def _unit_pairs(head_unit: np.ndarray):
    """Bigram counts of a task: (a * UNITS + b, n). An end also opens the next text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit_of = _units(head_unit)
        pairs = np.zeros(UNITS * UNITS, np.int64)
        for whole in frames:
            for lo in range(0, len(whole), 2000):
                unit = unit_of[_values(whole["place"].iloc[lo : lo + 2000], np.int32)]
                before = np.concatenate([[END], unit[:-1]])
                pairs += np.bincount(before * UNITS + unit, minlength=UNITS * UNITS)
        at = np.flatnonzero(pairs)
        yield pd.DataFrame({"a": at, "n": pairs[at]})

    return run


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words)).view(np.int64)


def _neighbours(words: list[bytes], head_unit: np.ndarray, unit_class: np.ndarray):
    """How often a task's words stand beside each context: rows (hash, head, seed,
    side, n). ``seed`` is the class of the word's seed unit; ``side`` is the
    context before, or CLASSES + the context after. The end of a text is the
    word of no bytes and has no context after it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ctx_of = unit_class[_units(head_unit)]
        known_hash = np.append(_hashes(words), np.zeros(HEAD - len(words), np.int64))
        known_hash = np.append(known_hash, _hashes([b""]))
        known_seed = np.full(HEAD + 1, unit_class[END])
        known_seed[: len(words)] = unit_class[head_unit[: len(words)]]
        dense = np.zeros((HEAD + 1) * SIDES, np.int32)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for whole in frames:
            for lo in range(0, len(whole), 2000):
                place = _values(whole["place"].iloc[lo : lo + 2000], np.int32)
                rare = _values(whole["rare"].iloc[lo : lo + 2000], np.int64)
                if not len(place):
                    continue
                ctx = ctx_of[place]
                before = np.concatenate([[unit_class[END]], ctx[:-1]])
                after = CLASSES + np.append(ctx[1:], 0)
                at = place >= 0
                np.add.at(dense, place[at] * SIDES + before[at], np.int32(1))  # of the same type: add.at is many times slower otherwise
                at &= place != HEAD
                np.add.at(dense, place[at] * SIDES + after[at], np.int32(1))
                if len(rare):
                    at = place < 0
                    held.append((rare, ctx[at], np.stack([before[at], after[at]], 1)))
                if sum(len(h) for h, _, _ in held) > RARE_TOKENS:
                    yield _rare_rows(held)
                    held = []
        if held:
            yield _rare_rows(held)
        cells = np.flatnonzero(dense)
        for lo in range(0, len(cells), 500_000):
            at = cells[lo : lo + 500_000]
            yield pd.DataFrame({"hash": known_hash[at // SIDES], "head": True, "seed": known_seed[at // SIDES].astype(np.int32),
                                "side": (at % SIDES).astype(np.int32), "n": dense[at].astype(np.int64)})

    return run


def _rare_rows(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    word, first, number = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
    seed = np.concatenate([c for _, c, _ in held])[first]
    cell, n = np.unique((number[:, None] * SIDES + np.concatenate([s for _, _, s in held])).ravel(), return_counts=True)
    return pd.DataFrame({"hash": word[cell // SIDES], "head": False, "seed": seed[cell // SIDES].astype(np.int32), "side": (cell % SIDES).astype(np.int32), "n": n})


def exchange_classes(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every unit: each in turn moves to the class that gains most
    average mutual information between neighbouring classes. The end of a text
    is a class of its own. Units never seen stay where they began."""
    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[order != n - 1]
    of = np.zeros(n, np.int64)
    of[order] = np.arange(len(order)) % (classes - 1)
    of[n - 1] = classes - 1
    member = np.eye(classes)[of]
    joint = member.T @ pairs @ member
    g = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            member[u] = 0
            right, left, own = pairs[u] @ member, pairs[:, u] @ member, pairs[u, u]
            c = of[u]
            joint[c, :] -= right
            joint[:, c] -= left
            joint[c, c] -= own
            rows, cols = joint.sum(1), joint.sum(0)
            gain = (g(joint + right[None, :]) - g(joint)).sum(1) + (g(joint + left[:, None]) - g(joint)).sum(0)
            d = np.diag(joint)
            gain += g(d + right + left + own) - g(d + right) - g(d + left) + g(d)
            gain -= g(rows + right.sum() + own) - g(rows) + g(cols + left.sum() + own) - g(cols)
            gain[classes - 1] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = int(c)
            moved += best != c
            of[u] = best
            member[u, best] = 1
            joint[best, :] += right
            joint[:, best] += left
            joint[best, best] += own
        if not moved:
            break
    return of


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_classes(word: np.ndarray, side: np.ndarray, n: np.ndarray, of: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The class of each word that gains most information between classes and
    their contexts, the other words staying where they are.

    ``word`` (ascending), ``side`` and ``n`` are neighbour counts, ``of`` the
    words' present classes and ``cells`` the counts of all words by (side,
    class). Of equal classes the present one, then the first, is taken.
    """
    n = n.astype(float)
    begins = np.searchsorted(word, np.arange(len(of)))
    now = _xlogx(cells).T  # (class, side), so that sums run along memory
    gain = (_xlogx(cells + 1).T - now)[:, side]
    more = np.flatnonzero(n > 1)
    gain[:, more] = _xlogx(cells.T[:, side[more]] + n[more]) - now[:, side[more]]
    own = cells[side, of[word]]
    gain[of[word], np.arange(len(n))] = _xlogx(own) - _xlogx(own - n)
    gain = np.add.reduceat(gain, begins, axis=1).T
    row = np.arange(len(of))
    for half in (slice(0, CLASSES), slice(CLASSES, SIDES)):
        total = cells[half].sum(0)
        mine = np.add.reduceat(np.where((side >= half.start) & (side < half.stop), n, 0.0), begins)
        loss = _xlogx(total + mine[:, None]) - _xlogx(total)
        loss[row, of] = _xlogx(total[of]) - _xlogx(total[of] - mine)
        gain -= loss
    gain[:, CLASSES - 1] = -np.inf  # the end of a text stays alone
    best = gain.argmax(1)
    return np.where((of == CLASSES - 1) | (gain[row, best] <= gain[row, of] + 1e-9), of, best)


def _moved(batch: pa.RecordBatch, rounds: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Words of a batch after some rounds: (rows, classes, word, side, n)."""
    sizes = np.diff(batch.column("side").offsets.to_numpy())
    ends = np.cumsum(sizes)
    sides, counts = batch.column("side").flatten().to_numpy(), batch.column("n").flatten().to_numpy()
    seed = batch.column("seed").to_numpy()
    lo = 0
    while lo < len(sizes):
        start = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, start + ENTRIES, side="right")))
        side, n = sides[start : ends[hi - 1]], counts[start : ends[hi - 1]]
        word = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        of = seed[lo:hi].astype(np.int64)
        for cells in rounds:
            of = best_classes(word, side, n, of, cells)
        yield np.arange(lo, hi), of, word, side, n
        lo = hi


def _class_cells(rounds: list[np.ndarray]):
    """Counts by (side, class) after some rounds, per task: (cell, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SIDES * CLASSES)
        for batch in batches:
            for _, of, word, side, n in _moved(batch, rounds):
                cells += np.bincount(side * CLASSES + of[word], weights=n, minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32), "n": cells[at].astype(np.int64)})

    return run


def _classified(rounds: list[np.ndarray]):
    """(hash, head, cls, n) of every word after all rounds; n: its tokens. Rows
    without ``head`` are the task's counts: hash is the context, cls the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "head", "cls", "n"]
        joint = np.zeros(CLASSES * CLASSES)
        for batch in batches:
            for rows, of, word, side, n in _moved(batch, rounds):
                left = side < CLASSES
                total = np.bincount(word[left], weights=n[left], minlength=len(rows))
                joint += np.bincount(side[left] * CLASSES + of[word[left]], weights=n[left], minlength=len(joint))
                part = batch.slice(int(rows[0]), len(rows))
                yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("head"), pa.array(of.astype(np.int32)), pa.array(total.astype(np.int64))], names)
        at = np.flatnonzero(joint)
        yield pa.RecordBatch.from_arrays([pa.array(at // CLASSES), pa.nulls(len(at), pa.bool_()), pa.array((at % CLASSES).astype(np.int32)), pa.array(joint[at].astype(np.int64))], names)

    return run


@dataclass
class ClassModel:
    """What scoring needs: bounded tables, and the classes and counts of all
    words outside the head as rows."""

    words: list[bytes]
    head_count: np.ndarray
    head_class: np.ndarray
    head_unit: np.ndarray
    unit_class: np.ndarray  # contexts
    gain: np.ndarray  # log10 P(class | context) / smoothed tokens of the class
    n_tokens: int
    n_types: int
    rare: DataFrame  # (hash, cls, n)


def head_words(texts: DataFrame) -> list[bytes]:
    """The most frequent words of ``texts`` (column ``t``), at most HEAD."""
    top = (texts.mapInPandas(_head_candidates, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(HEAD).select("word").toArrow())
    return top["word"].to_pylist()


def fit_class_model(texts: DataFrame) -> ClassModel:
    """Learn from all rows of ``texts`` (column ``t``)."""
    words = head_words(texts)
    return _fit(numbered(texts.select("t"), words), words)


def _fit(numbers: DataFrame, words: list[bytes]) -> ClassModel:
    numbers = numbers.select("place", "rare")
    head_unit = np.array([i if i < WORD_UNITS else suffix_unit(w) for i, w in enumerate(words)] or [0], np.int64)
    pairs = np.zeros(UNITS * UNITS, np.int64)
    seen = numbers.select("place").mapInPandas(_unit_pairs(head_unit), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most UNITS^2 cells
    pairs[seen["a"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    pairs = pairs.reshape(UNITS, UNITS)
    unit_class = exchange_classes(pairs.astype(float))
    beside = numbers.mapInPandas(_neighbours(words, head_unit, unit_class), "hash long, head boolean, seed int, side int, n long")
    # a task holds a word's counts added up already; both aggregates use one shuffle
    beside = (beside.repartition("hash").groupBy("hash", "side").agg(F.sum("n").alias("n"), F.min("seed").alias("seed"), F.max("head").alias("head"))
              .groupBy("hash").agg(F.max("head").alias("head"), F.min("seed").alias("seed"), F.collect_list(F.struct("side", "n")).alias("c")))
    beside = written(beside.select("hash", "head", "seed", F.col("c.side").alias("side"), F.col("c.n").alias("n")), "lm_words")

    def cells_after(rounds: list[np.ndarray]) -> np.ndarray:
        cells = np.zeros(SIDES * CLASSES)
        for r in beside.mapInArrow(_class_cells(rounds), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most SIDES * CLASSES
            cells[r["cell"]] = r["n"]
        return cells.reshape(SIDES, CLASSES)

    member = np.eye(CLASSES)[unit_class]
    seed = member.T @ pairs @ member
    after = seed.T.copy()
    after[:, CLASSES - 1] = 0  # the end of a text has no context after it
    rounds = [np.vstack([seed, after])]
    while len(rounds) < WORD_ROUNDS:
        rounds.append(cells_after(rounds))
    rows = written(beside.mapInArrow(_classified(rounds), "hash long, head boolean, cls int, n long"), "lm_classes")
    classes, joint = rows.where("head is not null"), np.zeros((CLASSES, CLASSES))
    for r in rows.where("head is null").groupBy("hash", "cls").agg(F.sum("n").alias("n")).collect():  # at most CLASSES^2
        joint[r["hash"], r["cls"]] = r["n"]
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r["cls"]], types[r["cls"]] = r["n"], r["v"]
    share = (mass + 1.0) / (mass + 1.0).sum()
    transition = (joint + PRIOR * share) / (joint.sum(1, keepdims=True) + PRIOR)
    place = {h: i for i, h in enumerate(_hashes(words).tolist())} | {int(_hashes([b""])[0]): HEAD}
    head_count, head_class = np.zeros(HEAD + 1, np.int64), np.full(HEAD + 1, CLASSES - 1)
    head_class[: len(words)] = unit_class[head_unit[: len(words)]]
    for r in classes.where("head").select("hash", "cls", "n").collect():  # at most HEAD + 1 rows
        head_count[place[r["hash"]]], head_class[place[r["hash"]]] = r["n"], r["cls"]
    return ClassModel(words, head_count, head_class, head_unit, unit_class, np.log10(transition) - np.log10(mass + DELTA * (types + 1)),
                      int(mass.sum()), int(types.sum()), classes.where("not head").select("hash", "cls", "n"))


def _scores(m: ClassModel):
    """Per text (hash NULL): its sums over head words. Per text, rare word,
    context before it and class of its suffix: how often (tf)."""
    head_class, head_unit, unit_class, gain = m.head_class, m.head_unit, m.unit_class, m.gain
    log_count, is_known = np.log10(m.head_count + DELTA), m.head_count > 0
    names = ["uid", "hash", "ctx", "seed", "tf", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx_of = unit_class[_units(head_unit)]
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                part = whole.slice(lo, 2000)
                place, h = _values(part.column("place").to_pylist(), np.int32), _values(part.column("rare").to_pylist(), np.int64)
                counts = pc.binary_length(part.column("place")).to_numpy() // place.itemsize
                ctx = ctx_of[place]
                before = np.concatenate([[unit_class[END]], ctx[:-1]])
                at = place >= 0
                known = np.where(at, log_count[place], 0.0)
                score = np.where(at, gain[before, head_class[place]] + known, 0.0)
                first = np.cumsum(counts) - counts
                none = pa.nulls(len(counts), pa.int64())
                sums = [np.add.reduceat(x, first) for x in ((at & is_known[place]).astype(np.int64), known, score)]
                yield pa.RecordBatch.from_arrays([part.column("uid"), none, none, none, none, part.column("doc_id"), part.column("held_out"), pa.array(counts.astype(np.int64)),
                                                  *map(pa.array, sums)], names)
                owner, cell = np.repeat(np.arange(len(counts)), counts)[~at], (before * CLASSES + ctx)[~at]
                order = np.lexsort((cell, h, owner))
                h, owner, cell = h[order], owner[order], cell[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])
                at = np.flatnonzero(new)
                none, no_number = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64())
                rare = [part.column("uid").to_numpy()[owner[at]], h[at], cell[at] // CLASSES, cell[at] % CLASSES, np.diff(np.append(at, len(h)))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, rare), none, pa.nulls(len(at), pa.bool_()), none, none, no_number, no_number], names)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows whose crc32(id as text) mod 10 is not 0 and score all.

    Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score);
    the two scores are log10 probabilities of the whole text, its end included;
    base_score is the additive unigram model. A word never seen in training has
    the class of its suffix and the share of one unseen word there. A NULL or
    empty text is its end alone; repeated rows each have a row; a NULL id counts
    as the empty text for crc32 and stays NULL; an empty table gives no rows.
    """
    held = ~training_row(id_col)
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    words = head_words(src.where("not held_out").select("t"))
    numbers = numbered(src, words)
    model = _fit(numbers.where("not held_out"), words)
    schema = "uid long, hash long, ctx long, seed long, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    rows = written(numbers.mapInArrow(_scores(model), schema), "lm_scores")
    rare = rows.where("hash is not null").select("uid", "hash", "ctx", "seed", "tf").join(model.rare, "hash", "left")
    log_c = F.log10(F.coalesce("n", F.lit(0)) + F.lit(DELTA))
    gains = F.split(F.lit(",".join(repr(float(x)) for x in model.gain.ravel())), ",").cast("array<double>")  # one constant of CLASSES^2 numbers
    gain = F.get(gains, (F.col("ctx") * CLASSES + F.coalesce("cls", "seed")).cast("int"))
    rare = rare.groupBy("uid").agg(F.sum(F.col("tf") * log_c).alias("rare_log"), F.sum(F.col("tf") * (gain + log_c)).alias("rare_score"),
                                   F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    norm = float(np.log10(model.n_tokens + DELTA * (model.n_types + 1)))
    return rows.where("hash is null").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
