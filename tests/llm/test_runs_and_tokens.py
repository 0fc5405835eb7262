"""Periodic runs, pair-index BPE and token alignment against brute force and
against the tokenizers' own libraries."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrina.llm import bpe_index, periodic_runs, queries, token_align

SF_SMALL = "/root/testdata/sf0.001"
BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = "doc_id long, text string, id string, t string, row string, block string, ids string, runs string"


@pytest.fixture(scope="module")
def small_docs():
    return [(i, t or "") for i, t in duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null ids and texts, empty and long texts, repeated rows, an id with two
    texts, and extra columns whose names the operators use inside."""
    texts = [(1, "ab " * 30), (2, "ab " * 30), (2, "ab " * 30), (3, None), (4, ""), (None, "x y " * 8), (5, "long words and more " * 20_000), (6, " \n\t\n"),
             (7, "end<|endoftext|>of text <s> ▁ piece"), (7, "plain text"), (2**60 + 1, "é中🙂  \x00 " * 9), (8, "q" * 50_000)]
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in texts], NAMES).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# periodic runs

def brute_runs(words):
    """(start, length, period) by walking every diagonal; the smallest period first."""
    word = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    out, extents = [], set()
    for q in range(1, len(words) // 2 + 1):
        same = np.concatenate([[0], word[:-q] == word[q:], [0]]).astype(np.int8)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if j + q - i >= max(12, 2 * q) and (i, j + q) not in extents:
                extents.add((i, j + q))
                out.append((i, j + q - i, q))
    return sorted(out)


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs_query_matches_brute_force(spark, small_docs):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(small_docs)
    for doc, text in small_docs:
        words = [w.decode() for w in text.encode().split()]
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = got[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r["collapsed_sha256"] == sha(collapse(words, runs))
    assert sum(r["n_runs"] for r in got.values()) > 20


def test_periodic_runs_of_small_alphabets():
    rnd = random.Random(5)

    def words():
        n, letters = rnd.randrange(140), rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.randrange(letters) for _ in range(n)]
        if n > 20 and rnd.random() < 0.6:  # a repetition with a few errors
            a, p = rnd.randrange(n // 2), rnd.randrange(1, n // 2)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(n)] = rnd.randrange(letters + 2)
        return w

    fibonacci, x = [0, 1], [0]
    while len(fibonacci) < 200:
        fibonacci, x = fibonacci + x, fibonacci
    for docs in [[fibonacci], *([words() for _ in range(15)] for _ in range(60))]:
        starts = np.cumsum([0, *(len(w) + 1 for w in docs)])
        flat = np.array([x for k, w in enumerate(docs) for x in [*w, 1000 + k]])
        found = periodic_runs.periodic_runs(flat, np.repeat(np.arange(len(docs)), np.diff(starts)))
        for k, w in enumerate(docs):
            mine = sorted((b - starts[k], e - b, q) for b, e, q in found if starts[k] <= b < starts[k + 1])
            assert mine == brute_runs(w)


def test_long_repetitions_take_bounded_work():
    """One word 200,000 times, and blocks of a rare word between: pairs per lag
    class stay within a few times the words."""
    for w in ([1] * 200_000, ([1] * 100 + [2]) * 500):
        word = np.array([*w, 9])
        hashes, n = periodic_runs.GramHashes(word), len(word)
        for low, high, k, s in periodic_runs.lag_classes(n):
            places = np.arange(n - k + 1)
            assert len(periodic_runs.seed_pairs(hashes.at(places, k), places, low, high, s)[0]) <= 6 * n
    assert periodic_runs.periodic_runs(np.array([1] * 200_000 + [9]), np.zeros(200_001, int)) == [(0, 200_000, 1)]


def test_every_class_meets_its_least_overlap():
    for low, high, k, s in periodic_runs.lag_classes(100_000):
        assert k >= 1 and s >= 1 and all(k + s - 1 <= periodic_runs.least_overlap(q) for q in range(low, high))
    bounds = periodic_runs.lag_classes(100_000)
    assert bounds[0][0] == 1 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:])) and bounds[-1][1] > 50_000


def test_periodic_runs_edge_cases(odd_docs):
    rows = periodic_runs.find_periodic_runs(odd_docs).collect()
    assert len(rows) == 12
    by = defaultdict(list)
    for r in rows:
        by[r["id"]].append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert by[1] == [(30, [(0, 30, 1)], "ab")] and by[2] == by[1] * 2
    assert by[3] == by[4] == by[6] == [(0, [], "")]
    assert by[None] == [(16, [(0, 16, 2)], "x y")]
    assert by[5] == [(80_000, [(0, 80_000, 4)], "long words and more")]
    assert by[8][0][:2] == (1, [])
    assert by[2**60 + 1][0][1] == [(0, 18, 2)]  # U+2028 is no white space here
    assert periodic_runs.find_periodic_runs(odd_docs.limit(0)).count() == 0


# pair-index BPE

ODD_TEXTS = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  \n\n c'll 'S ", " " * 999, "x" * 3000, "ab" * 500, "don't I'VE", "\t\t \r\n x",
             "🙂👩‍👩‍👧 é é ﬁ", "\U000323b0x ՘y", "aaaaaaa bbbbbbbbb", "\x1c\x85　a"]


def decode(ids):
    return bpe_index.decode_ids(ids, bpe_index.token_bytes(BYTE_BPE))


def random_texts(n):
    rnd = random.Random(7)
    some = ["a", "b", " ", "'s", "1", "\n", "é", "中", "<|endoftext|>", "the", "  "]
    return ["".join(rnd.choice([*some, chr(rnd.randrange(0x20, 0x3000)), chr(rnd.choice([rnd.randrange(0xD7FF), rnd.randrange(0xE000, 0x110000)]))])
                    for _ in range(rnd.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("specials", [True, False])
def test_pair_index_equals_the_library(specials):
    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = not specials
    texts = ODD_TEXTS + random_texts(800)
    encoder = bpe_index.PairIndexBPE(BYTE_BPE, specials)
    for _ in range(2):  # new words, then known ones
        for text, ids in zip(texts, encoder.encode(texts)):
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids == array("I", expected).tobytes()
            assert decode(ids) == library.decode(expected, skip_special_tokens=False) == text


def test_decoding_any_ids_equals_the_library():
    library, rnd = Tokenizer.from_file(BYTE_BPE), random.Random(3)
    for _ in range(300):
        ids = [rnd.randrange(50_300) for _ in range(rnd.randrange(12))]
        assert decode(array("I", ids).tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_word_patterns_agree():
    encoder = bpe_index.PairIndexBPE(BYTE_BPE)
    chars = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2100), *range(0x550, 0x5A0), *range(0xC50, 0xC60)]]
    for text in [x + c + y for c in chars for x, y in (("a", "1"), ("1", "a"), (" ", "!"), ("\t", "\t a"))]:
        assert encoder.words(text) == encoder.library_words(text)


def test_known_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe_index, "KNOWN_WORDS", 40)
    encoder, library = bpe_index.PairIndexBPE(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text in random_texts(60):
        assert encoder.encode([text]) == [array("I", library.encode(text, add_special_tokens=False).ids).tobytes()]
        assert len(encoder.known) <= 40 + len(text)


def test_bpe_query_matches_the_library(spark, small_docs):
    library = Tokenizer.from_file(BYTE_BPE)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_pair_index_bpe(spark, SF_SMALL).collect()}
    expected = {}
    for doc, text in small_docs:
        ids = library.encode(text, add_special_tokens=False).ids
        expected[doc] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == expected


def test_bpe_edge_cases(odd_docs):
    rows = bpe_index.bpe_encode(odd_docs, BYTE_BPE).select("id", "ids", bpe_index.bpe_decode(F.col("ids"), BYTE_BPE).alias("text")).collect()
    source = Counter((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert Counter((r["id"], r["text"]) for r in rows) == source
    assert any(r["id"] == 7 and 50256 in np.frombuffer(r["ids"], "<u4") for r in rows)
    assert bpe_index.bpe_encode(odd_docs.limit(0), BYTE_BPE).count() == 0


# token alignment

def brute_alignment(texts):
    """Per text: (A ids, B ids, groups as lists of ids), and the pairs' document counts."""
    one, two = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    one.encode_special_tokens = True
    values = {c: b for b, c in enumerate(bpe_index.byte_letters())}
    docs, counts = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(values[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a[: len(a)]]), np.cumsum([len(x) for x in bytes_b[: len(b)]])
        cuts = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        groups, i, j = [], 0, 0
        for c in cuts:
            g, h = [], []
            while i < len(a) and ends_a[i] <= c:
                g.append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= c:
                h.append(b[j])
                j += 1
            groups.append((g, h))
        docs.append((a, b, groups))
        counts.update({(x, y) for g, h in groups for x in g for y in h})
    return docs, counts


def brute_scores(texts):
    docs, counts = brute_alignment(texts)
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups in docs:
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), text))
    return out


def test_alignment_query_matches_brute_force(spark, small_docs):
    docs = small_docs
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_alignment(spark, SF_SMALL).collect()}
    expected = {doc: (*s[:6], sha(s[6]) if s[6] else "") for (doc, _), s in zip(docs, brute_scores([t for _, t in docs]))}
    assert got == expected


def test_alignment_edge_cases(spark, odd_docs, monkeypatch):
    sizes = len(bpe_index.token_bytes(BYTE_BPE)), token_align.pieces_at(PIECE_BPE).size
    source = odd_docs.where("length(coalesce(text, '')) < 1000")
    texts = [(r["doc_id"], r["text"] or "") for r in source.collect()] + [(100 + k, t) for k, t in enumerate(ODD_TEXTS[1:3] + ODD_TEXTS[5:])]
    docs = source.select("doc_id", "text").union(spark.createDataFrame(texts[source.count():], "doc_id long, text string"))
    rows = token_align.link_scores(token_align.align_tokens(docs.repartition(4), BYTE_BPE, PIECE_BPE), *sizes).collect()
    assert Counter(map(tuple, rows)) == Counter((i, *s) for (i, _), s in zip(texts, brute_scores([t for _, t in texts])))
    assert all(r["n_a"] == 0 and r["groups"] == "" for r in rows if r["id"] in (3, 4))
    long = token_align.link_scores(token_align.align_tokens(odd_docs.where("doc_id in (5, 8)"), BYTE_BPE, PIECE_BPE), *sizes).collect()
    assert len(long) == 2 and all(r["n_links"] >= max(r["n_a"], r["n_b"]) > 0 for r in long)
    assert token_align.link_scores(token_align.align_tokens(odd_docs.limit(0), BYTE_BPE, PIECE_BPE), *sizes).count() == 0


def test_stretches_stand_alone_on_both_sides(monkeypatch):
    """Ids put together from stretches, remembered or not, are those of the whole text."""
    monkeypatch.setattr(token_align, "KNOWN_STRETCHES", 60)
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    byte = Tokenizer.from_file(BYTE_BPE)
    byte.encode_special_tokens = True
    entry = token_align.pieces_at(PIECE_BPE).entry
    texts = [t for t in ODD_TEXTS + random_texts(800) if t] + [
        "  a  b ", "\n x", " ", "   ", "a " * 40, "a\n\n  b", "x\t y\x1c z\x85 w\xa0 v", "fi \ufb01 \uff21 ok", "end\n", "\u0378 a \U0001fae9 b", ""]
    both = token_align.StretchTokens(BYTE_BPE, PIECE_BPE)
    empty = 0
    for lo in range(0, len(texts), 7):
        some = texts[lo : lo + 7]
        for text, a, b in zip(some, *both.encode(some)):
            whole = piece.encode(text)
            if not text or b"".join(entry[i] for i in whole) != (" " + text).encode():
                assert len(a) == len(b) == 0
                empty += 1
            else:
                assert b.tolist() == whole and a.tolist() == byte.encode(" " + text, add_special_tokens=False).ids
    assert 0 < empty < len(texts)


def test_lanes_of_any_length_give_the_same_links():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 30, 400):
        a = np.unique(np.append(rnd.integers(1, 4 * n, n), 4 * n))
        b = np.unique(np.append(rnd.integers(1, 4 * n, n), 4 * n))
        begin_a, begin_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        overlaps = {(i, j) for i in range(len(a)) for j in range(len(b)) if begin_a[i] < b[j] and begin_b[j] < a[i]}
        for lane in (1, 3, 64, 10**6):
            links, cuts = Counter(), Counter()
            for i, j, cut in token_align.lockstep(a, b, lane):
                links.update(zip(i.tolist(), j.tolist()))
                cuts.update(a[i[cut]].tolist())
            assert set(links) == overlaps and set(links.values()) == {1}
            assert set(cuts) == set(a) & set(b) and set(cuts.values()) == {1}


def test_large_groups_are_multiplied_by_distinct_ids():
    a, b = np.arange(60) % 7, np.arange(50) % 5
    end = lambda n: np.arange(n) == n - 1
    _, key, times = token_align.group_links(a, b, end(60), end(50), 100)
    expected = Counter(int(x) * 100 + int(y) for x in a for y in b)
    assert dict(zip(key.tolist(), times.tolist())) == expected
