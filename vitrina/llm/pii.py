"""Personal data by weak supervision.

One pass finds candidate spans (the base patterns and wider ones) and lets six
labelers vote on each: shape, checksum, gazetteer, cue words, contrary cue words
and boundaries. Only counts of (kind, votes, features) leave the executors.
Expectation-maximisation estimates each labeler's reliability from the vote
patterns; the posteriors train a logistic span classifier over the features,
which decides about the candidates the base patterns do not cover.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.shared import written

KINDS = ("email", "ip", "card", "phone", "iban", "key", "name", "ssn")  # the first four are the base kinds
BASE = 4
# The base patterns, as given.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # holds the matches of the ip pattern: each four parts in a row
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider patterns, cue words and gazetteers.
WIDE = {
    "email": re.compile(r" ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]+)+"),  # after the local part
    "ip": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<!\w)[0-9]{13,15}(?!\w)"),
    "phone": re.compile(r"(?<![\w+.])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "key": re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64}|ghp_[0-9A-Za-z]{36})(?!\w)"),
    "name": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
}
CUES = {
    "email": "mail email e-mail contact write correo kontakt courriel address".split(),
    "ip": "ip host server address login from adresse".split(),
    "card": "card visa mastercard amex credit karte carte tarjeta payment".split(),
    "phone": "phone tel call mobile cell fax telefon telefono whatsapp téléphone ring".split(),
    "iban": "iban account bank konto cuenta compte".split(),
    "key": "key secret token password api access credential".split(),
    "name": "name dear from signed sincerely patient client".split(),
    "ssn": "ssn social security tax id".split(),
}
AGAINST = frozenset("version isbn issn page pages section chapter article v ver release year line figure table total".split())
MAIL_ENDS = frozenset("com org net edu gov de fr es uk io info example local".split())
GIVEN_NAMES = frozenset("james mary john anna maria peter paul laura carlos jose luis marie pierre hans klaus julia sofia david michael sarah".split())
LABELERS = ("shape", "checksum", "gazetteer", "cue", "contrary", "boundary")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping
    within a kind; a match that fails its check is gone without a retry."""
    out, end = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):  # the run before an @ is the leftmost match's start
            start = email_run(text, m.start(), end)
            if start < m.start():
                out.append((0, start, m.end()))
                end = m.end()
    if text.count(".") > 2:
        for m in DOTTED.finditer(text):
            if m.end() - m.start() > 6:
                out += dotted_quads(m.group(), m.start())
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def dotted_quads(run: str, at: int) -> list[tuple[int, int, int]]:
    """Every four parts in a row of a dotted run of numbers, if none is above 255."""
    out, parts = [], run.split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        size = sum(map(len, four)) + 3
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in four):
            out.append((1, at, at + size))
        at += size + 1
    return out


def email_run(text: str, at: int, lo: int) -> int:
    """Where the run of local-part characters that ends at ``at`` begins."""
    while at > lo and (text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "._%+-")):
        at -= 1
    return at


def votes_and_features(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, int]:
    """Six votes (0 no, 1 yes, 2 abstains) as base-3 digits; the feature cell."""
    name, span = KINDS[kind], text[start:end]
    digits = digits_of(span)
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 60) : start].lower())[-4:]
    checksum = 2
    if name == "card":
        checksum = int(luhn(digits))
    elif name == "phone":
        checksum = int(8 <= len(digits) <= 15)
    elif name == "iban":
        checksum = int(int("".join(str(int(c, 36)) for c in (span.replace(" ", "")[4:] + span[:4]))) % 97 == 1)
    gazetteer = 2
    if name == "email":
        gazetteer = int(re.split(r"[.\s)\]]", span.lower())[-1] in MAIL_ENDS)
    elif name == "name":
        gazetteer = 1 if any(w in GIVEN_NAMES for w in span.lower().split()) else 2
    elif name == "key":
        gazetteer = 1 if span.startswith(("AKIA", "ghp_")) else 2
    cue = 1 if any(w in CUES[name] for w in before) else 2
    contrary = 0 if any(w in AGAINST for w in before[-2:]) else 2
    alone = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    votes = 0
    for v in (1 if base else 2 if checksum == 1 or cue == 1 else 0, checksum, gazetteer, cue, contrary, int(alone)):
        votes = votes * 3 + v
    length = min(5, (end - start) // 8)
    apart = 0 if span.isalnum() else 1 if " " not in span else 2
    cell = ((((kind * 6 + length) * 3 + apart) * 2 + (cue == 1)) * 2 + (contrary == 0)) * 2 + alone
    return votes, (cell * 3 + checksum) * 3 + gazetteer


CELL_SIZES = (len(KINDS), 6, 3, 2, 2, 2, 3, 3)  # digits of a feature cell


def candidates(text: str) -> list[tuple[int, int, int, int, int, bool]]:
    """(kind, start, end, votes, cell, is base) by kind and start. A wider match
    that overlaps a span already taken is no candidate."""
    spans = [(k, s, e, True) for k, s, e in base_spans(text)]
    for name, pattern in WIDE.items():
        starts, reach = [], []  # spans taken so far by start, and the furthest end up to each
        for s, e in sorted((s, e) for _, s, e, _ in spans):
            starts.append(s)
            reach.append(max(e, reach[-1]) if reach else e)
        end = 0
        for m in pattern.finditer(text):
            start = m.start()
            if name == "email":
                start = email_run(text, m.start(), end)
                if start == m.start():
                    continue
            end = m.end()
            before = bisect.bisect_left(starts, end)
            if not before or reach[before - 1] <= start:
                spans.append((KINDS.index(name), start, end, False))
    return [(k, s, e, *votes_and_features(text, k, s, e, b), b) for k, s, e, b in sorted(spans)]


MAYBE = re.compile(r"[0-9@+]|\(at\)|\[at\]|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme)\.? [A-Z]")


def _candidate_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [candidates(t) if MAYBE.search(t) else [] for t in frame["t"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": [[dict(zip(("kind", "s", "e", "votes", "cell", "base"), x)) for x in xs] for xs in found]})


def estimate_reliabilities(votes: np.ndarray, kind: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation over vote patterns; the posterior of each row.

    A labeler has, for true and false spans, a probability of each vote; a kind
    has a prior. Starts from the majority of votes.
    """
    yes, no = (votes == 1).sum(1), (votes == 0).sum(1)
    q = (yes + 0.5) / (yes + no + 1.0)
    kinds = kind.max() + 1 if len(kind) else 1
    for _ in range(rounds):
        prior = (np.bincount(kind, count * q, kinds) + 1) / (np.bincount(kind, count, kinds) + 2)
        on, off = np.log(prior)[kind], np.log(1 - prior)[kind]
        for j in range(votes.shape[1]):
            for share, side in ((q, "on"), (1 - q, "off")):
                # Dirichlet prior: a labeler is taken to be right more often than not
                start = np.array([1.0, 4.0, 2.0] if side == "on" else [4.0, 1.0, 2.0])
                p = start + np.bincount(votes[:, j], count * share, 3)
                term = np.log(p / p.sum())[votes[:, j]]
                if side == "on":
                    on = on + term
                else:
                    off = off + term
        q = 1 / (1 + np.exp(np.clip(off - on, -50, 50)))
    return q


def one_hot(cell: np.ndarray) -> np.ndarray:
    parts, rest = [], cell.copy()
    for size in reversed(CELL_SIZES):
        parts.append(np.eye(size)[rest % size])
        rest //= size
    return np.hstack(parts)


def train_span_classifier(cell: np.ndarray, q: np.ndarray, count: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression on one-hot cells against the posteriors; weights."""
    x = one_hot(cell)
    weight = count / count.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - q)) + 1e-4 * w)
    return w


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, spans) with spans an array of struct(kind, s, e, votes,
    cell, base), by kind and start, code points, end exclusive.

    Base spans always stay; a wider candidate stays if the span classifier gives
    its cell at least ``threshold``. NULL and empty texts have no spans; repeated
    rows and NULL ids each keep their row; an empty table gives no rows.
    """
    # the ids pass pandas as text: beside a NULL it would make them doubles
    src = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    span = "array<struct<kind: int, s: long, e: long, votes: int, cell: int, base: boolean>>"
    found = src.mapInPandas(_candidate_rows, f"doc_id string, spans {span}")
    rows = written(found.select(F.col("doc_id").cast("long").alias("doc_id"), "spans"), "pii_spans")
    x = F.explode("spans").alias("x")
    table = rows.select(x).groupBy("x.votes", "x.cell").agg(F.count("*").alias("n")).orderBy("votes", "cell").collect()  # bounded by the cells
    accepted: list[int] = []
    if table:
        cell = np.array([r["cell"] for r in table])
        code = np.array([r["votes"] for r in table])
        votes = np.stack([code // 3 ** (5 - j) % 3 for j in range(6)], 1)
        count = np.array([r["n"] for r in table], float)
        kind = cell // int(np.prod(CELL_SIZES[1:]))
        q = estimate_reliabilities(votes, kind, count)
        w = train_span_classifier(cell, q, count)
        cells = np.unique(cell)
        accepted = [int(c) for c in cells[1 / (1 + np.exp(-one_hot(cells) @ w)) >= threshold]]
    good = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<int>")
    return rows.select("doc_id", F.filter("spans", lambda s: s["base"] | F.array_contains(good, s["cell"])).alias("spans"))
