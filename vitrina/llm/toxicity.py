"""Toxicity scores from a learned lexicon matched with Levenshtein automata.

The lexicon (words and word stems) is learned from labelled documents. Matching
walks each distinct word of a text through the product of the lexicon's trie and
the Levenshtein automata of its terms, made deterministic state by state as words
need it, from the first letter on with all edits. Only texts with matches
are looked at again: windows around the matches tell quotation from abuse. A
logistic regression turns the counts into a probability.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.near_dup import WordHash, shingles, word_hashes
from vitrina.llm.shared import written

WORD = re.compile(r"\w+")
SIGNED = re.compile(r"(?<!\w)(?:[@$]\w+|\w+(?=[@$!*]+\w))(?:[@$!*]+\w+)*")  # words with signs between letters or before them
# Words that introduce a quotation, words of the second person,
# digits and signs written for letters.
REPORTING = frozenset("called dijo dit gesagt insult insulto insulte mot palabra quote quoted said says slur term word words wort wrote".split())
SECOND_PERSON = frozenset("du dich dir euch ihr te tu tus tú toi usted vous you your yours yourself".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
VOWELS = "aeiou"  # what a "*" mostly stands for
QUOTES = "\"“”„«»"

MAX_TOXIC, MAX_CLEAN = 4000, 12000
CACHE = 200_000
STATES = 50_000  # automaton states and steps a task remembers; beyond, they are built anew
FEATURES = ("plain", "types", "quoted", "misspelt", "misspelt_quoted", "directed", "density", "length")
WORD_PRECISION, STEM_PRECISION = 0.85, 0.6  # least toxic share of the texts that hold a term


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class LexiconAutomaton:
    """Trie of (term, is_stem) intersected with Levenshtein automata.

    The first letter must agree unless ``any_start``. ``find(word)`` gives (term,
    edits) of the nearest term, or None. A stem also matches words that go on
    after it.
    """

    def __init__(self, terms: list[tuple[str, bool]], any_start: bool = False):
        self.any_start = any_start
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # (term, is_stem, edits allowed)
        self.reach = [0]  # most edits allowed below a node
        for i, (term, stem) in enumerate(terms):
            k, node = allowed_edits(len(term)), 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], k)
            self.ends[node].append((i, stem, k))
            self.reach[0] = max(self.reach[0], k)
        self.known: dict[str, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        """Only the start state; the others are built as words need them."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.stem: list[tuple[int, int] | None] = []
        self.n_steps = 0
        self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:  # a letter of the term is missing in the word
            node, e = todo.pop()
            if e > self.reach[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            if node or self.any_start:
                todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hits = [(e, i, stem) for node, e in key for i, stem, k in self.ends[node] if e <= k]
            self.final.append(min(((i, e) for e, i, _ in hits), key=lambda x: (x[1], x[0]), default=None))
            self.stem.append(min(((i, e) for e, i, stem in hits if stem), key=lambda x: (x[1], x[0]), default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            if node or self.any_start:
                out.add((node, e + 1))
                out.update((child, e + 1) for child in self.children[node].values())
        self.steps[state][c] = to = self._state(out)
        self.n_steps += 1
        return to

    def _walk(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) + self.n_steps > STATES:
            self._forget()
        state, best = 0, None
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return best
            hit = self.stem[state]
            if hit and (best is None or hit[1] < best[1]):
                best = hit
        hit = self.final[state]
        return hit if hit and (best is None or hit[1] <= best[1]) else best

    def find(self, word: str) -> tuple[int, int] | None:
        if word in self.known:
            return self.known[word]
        hit = self._walk(word)
        if hit is None and not word.isalpha() and not word.isdigit():
            hit = self._walk(word.translate(LOOKALIKES))
            hit = hit and (hit[0], max(1, hit[1]))
        if len(self.known) < CACHE:
            self.known[word] = hit
        return hit

    def find_signed(self, word: str) -> tuple[int, int] | None:
        """``find`` of a word in which signs stand for letters: always an edit."""
        plain = word.translate(LOOKALIKES)
        hits = [h for w in ([plain.replace("*", v) for v in VOWELS] if "*" in plain else [plain]) if (h := self.find(w))]
        return min(((i, max(1, e)) for i, e in hits), key=lambda h: (h[1], h[0]), default=None)


def features(text: str, automaton: LexiconAutomaton) -> list[float] | None:
    """The match counts of a text by context, or None without a match."""
    low = text.lower()
    words = WORD.findall(low)
    hits = {w: h for w in set(words) if (h := automaton.find(w))}
    signed = [(m.start(), m.end(), h) for m in SIGNED.finditer(low) if any(map(str.isalpha, m.group())) and (h := automaton.find_signed(m.group()))]
    if not hits and not signed:
        return None
    plain = quoted = directed = 0
    misspelt: tuple[set[int], set[int]] = (set(), set())  # terms by context
    places = [(m.group(), m.start()) for m in WORD.finditer(low)]
    found = [(i, at, hits[w]) for i, (w, at) in enumerate(places) if w in hits]
    exact_at = [at for _, at, h in found if not h[1]]
    starts = [at for _, at in places]
    found += [(bisect_left(starts, lo), lo, h) for lo, hi, h in signed if not any(lo <= at < hi for at in exact_at)]
    for i, at, (term, edits) in found:
        near = [x for x, _ in places[max(0, i - 4) : i + 5]]
        before = low[max(0, at - 80) : at]
        after = low[at : at + 80]
        in_quotes = sum(map(before.count, QUOTES)) % 2 == 1 and any(q in after for q in QUOTES)
        is_quoted = in_quotes or any(x in REPORTING for x in near[: min(i, 4)])
        if edits:
            misspelt[is_quoted].add(term)
        elif is_quoted:
            quoted += 1
        else:
            plain += 1
            directed += any(x in SECOND_PERSON for x in near)
    exact = {h[0] for h in hits.values() if not h[1]}
    types = sum(not h[1] for h in hits.values())
    return [math.log1p(plain), math.log1p(types), math.log1p(quoted), math.log1p(len(misspelt[0] - exact)),
            math.log1p(len(misspelt[1] - misspelt[0] - exact)), math.log1p(directed), math.log1p(100 * (plain + quoted) / len(words)), math.log1p(len(words))]


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool]]
    weights: list[float]
    bias: float

    def score(self, x: list[float] | None) -> float:
        z = self.bias + (sum(a * b for a, b in zip(self.weights, x)) if x else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_row(id_col: str = "doc_id") -> Column:
    """Labels are learned where crc32(id as text) mod 4 is not 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def _sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds one min-hash of the text's five-word n-grams."""
    known = WordHash()
    for frame in frames:
        flat, counts = word_hashes(frame["t"].tolist(), known)
        h, m = shingles(flat, counts, 5)
        least = np.zeros(len(m), np.uint64)
        if len(h):
            least[m > 0] = np.minimum.reduceat(h, (np.cumsum(m) - m)[m > 0])
        frame["sketch"] = least.view(np.int64)
        yield frame


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for frame in frames:
        for t, y in zip(frame["t"], frame["y"]):
            count[int(y)].update(set(WORD.findall(t.lower())))
    for y in (0, 1):
        yield pd.DataFrame({"word": list(count[y]), "toxic": [n * y for n in count[y].values()], "clean": [n * (1 - y) for n in count[y].values()]})


def surprise(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Log-likelihood ratio of a term's share in toxic and clean texts."""
    n, share = toxic + clean, n_toxic / (n_toxic + n_clean)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    return 2 * (part(toxic, n * share) + part(clean, n * (1 - share)))


def choose_terms(words: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """Words and stems that speak for toxicity (the sample's bound is theirs).

    A stem is the beginning of at least three toxic words, none of them with
    more than 70 % of its occurrences; the shortest one that is as precise as
    the longer stands for all. Stems may be less precise than words: several
    words of one stem in a text say more than one does, and the regression
    weighs their number against the text's length.
    """
    least = max(4, round(0.002 * n_toxic))
    keep = lambda df, share: (df.where((F.col("toxic") >= least) & (F.col("toxic") >= share * (F.col("toxic") + F.col("clean"))))
                       .withColumn("g", surprise(F.col("toxic"), F.col("clean"), n_toxic, n_clean)).where("g > 28")
                       .orderBy(F.desc("g"), "term"))
    whole = keep(words.where(F.length("word") >= 3).withColumnRenamed("word", "term"), WORD_PRECISION).collect()
    stems = (words.where(F.length("word") >= 4).select("*", F.explode(F.sequence(F.lit(4), F.least(F.length("word"), F.lit(8)))).alias("n"))
             .groupBy(F.expr("left(word, n)").alias("term"))
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("toxic").alias("top"), F.count(F.when(F.col("toxic") > 0, 1)).alias("types"))
             .where("types >= 3 and top <= 0.7 * toxic"))
    chosen: list[tuple[str, float]] = []
    for r in sorted(keep(stems, STEM_PRECISION).collect(), key=lambda r: (len(r["term"]), r["term"])):
        p = r["toxic"] / (r["toxic"] + r["clean"])
        if not any(r["term"].startswith(t) and q >= p - 0.02 for t, q in chosen):
            chosen.append((r["term"], p))
    out = [(t, True) for t, _ in chosen]
    return out + [(r["term"], False) for r in whole if not any(r["term"].startswith(t) for t, _ in chosen)]


def _feature_rows(terms: list[tuple[str, bool]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(terms, any_start=True)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "x": [features(t, automaton) or [0.0] * len(FEATURES) for t in frame["t"]]})

    return run


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; bias last."""
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([0.5] * x.shape[1] + [1e-3])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel:
    """Learn lexicon and weights from at most ``max_toxic`` + ``max_clean``
    labelled documents (those with the smallest hash of their id; the bound is
    what is broadcast and what the regression sees). Near copies in the sample
    count once. Rows whose crc32 mod 4 is 2, and NULL labels, are never used.
    Two pseudo-observations of weight 5 state that texts with misspelt terms are
    toxic, so that misspellings count before the labels show any.
    """
    y = labels.where(training_row() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    y = y.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = y.where("y = 1").orderBy(*order).limit(max_toxic).union(y.where("y = 0").orderBy(*order).limit(max_clean))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
            .join(F.broadcast(sample), "doc_id").mapInPandas(_sketched, "doc_id long, t string, y int, sketch long"))
    # of near copies the smallest id stays, however the rows lie
    rows = written(rows, "toxic_sample").groupBy("sketch", "y").agg(F.min_by(F.struct("doc_id", "t"), F.struct("doc_id", "t")).alias("row"))
    rows = written(rows.select("row.doc_id", "row.t", "y"), "toxic_training")
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = seen.get(1, 0), seen.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel([], [0.0] * len(FEATURES), 3.0 if n_toxic else -3.0)
    words = written(rows.mapInPandas(_count_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic_words")
    terms = choose_terms(words, n_toxic, n_clean)
    got = sorted(rows.mapInPandas(_feature_rows(terms), "doc_id long, y int, x array<double>").collect())
    x = np.array([r["x"] for r in got], float)
    t = np.array([r["y"] for r in got], float)
    weight = np.where(t > 0, counts.get(1, 1) / n_toxic, counts.get(0, 1) / n_clean)
    weight = weight * len(t) / weight.sum()
    prior = np.zeros((2, len(FEATURES)))
    prior[:, FEATURES.index("misspelt")] = [math.log1p(2), math.log1p(3)]
    w = fit_weights(np.vstack([x, prior]), np.append(t, [1.0, 1.0]), np.append(weight, [5.0, 5.0]))
    return ToxicityModel(terms, [float(v) for v in w[:-1]], float(w[-1]))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with ``score`` (0 to 1).

    The score depends on the text alone. NULL and empty texts, and texts without
    a match, get the score of a text without matches. Rows are scored one by
    one, so repeated rows agree; an empty table gives no rows.
    """
    terms, model_ = model.terms, model
    automata: dict[int, LexiconAutomaton] = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not automata:
            automata[0] = LexiconAutomaton(terms, any_start=True)
        return texts.map(lambda t: model_.score(features(t, automata[0]))).astype(float)

    return docs.select(F.struct("*").alias("row"), score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("score"))
