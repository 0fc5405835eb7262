"""Edge cases of every corpus operator, and comparisons with brute force on the
smallest tables."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vitrina.llm import class_lm, decontam, hilbert_ann, line_dedup, near_dup, packing, pii, queries, substring_dedup, toxicity
from vitrina.llm.main_text import main_blocks, main_text, minimum_cut
from vitrina.llm.shared import connected_components

SF_SMALL = "/root/testdata/sf0.001"
NULL_ID = 2**63 - 1
LONG = "der lange Satz hat viele Worte und kein Ende " * 3000


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, an id with
    two texts, and extra columns whose names the operators use inside."""
    names = ["doc_id", "text", "row", "id", "t", "th", "label", "node", "k"]
    schema = StructType([StructField("doc_id", LongType())] + [StructField(n, StringType()) for n in names[1:]])
    passage = "one two three four five six seven eight nine ten eleven twelve"
    texts = [(1, passage), (2, passage), (2, passage), (3, None), (4, ""), (None, passage + " thirteen"), (5, LONG), (6, " \n\t\n"),
             (7, "short"), (8, "short"), (9, "shared line of text\nown line number nine"), (10, "Shared line of TEXT  \nown line ten here"), (10, "another text of id ten")]
    rows = [(i, t, *["x"] * 7) for i, t in texts]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="module")
def small_docs():
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF_SMALL}/documents.parquet'").fetchall()


# line dedup

def test_line_dedup_matches_sql(spark):
    got = {tuple(r) for r in queries.op2_line_dedup(spark, SF_SMALL).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    assert got == set(con.sql(queries.LINE_DEDUP_SQL).fetchall())


def test_line_dedup_edge_cases(odd_docs, no_docs):
    rows = line_dedup.line_dedup(odd_docs).select("row.*", "n_lines", "n_dropped", "kept_text").collect()
    assert len(rows) == 13
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["n_lines"], r["n_dropped"], r["kept_text"]))
    assert by[1][0][1] == 0 and [x[1] for x in by[2]] == [1, 1] and by[3] == by[4] == [(1, 0, "")]
    assert by[6] == [(3, 0, " \n\t\n")]
    assert by[10][0][1:] == (1, "own line ten here") or by[10][1][1:] == (1, "own line ten here")
    assert by[7][0][1] == by[8][0][1] == 0  # short keys stay
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_line_dedup_without_ids(spark):
    """Rows without id are one document, also if they are most of the table."""
    line = "a line that every row of the table holds"
    rows = [(None, line)] * 6 + [(None, None), (2**63 - 2, line), (3, line + "\nand one more line here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(docs).select("row.*", "*").collect())
    assert got == {(None, 1, 1, ""): 6, (None, 1, 0, ""): 1, (2**63 - 2, 1, 1, ""): 1, (3, 2, 0, line + "\nand one more line here"): 1}


def test_line_runs_are_merged_by_level(spark):
    index = line_dedup.LineRuns(spark, buckets=2)
    batches = [[(1, 1, 10), (2, 2, 10)], [(1, 1, 20), (3, 3, 20), (3, 3, 21)], [(2, 2, 30)], [(4, 4, 40), (3, 3, 41)]]
    found = [sorted(tuple(r) for r in index.ingest(spark.createDataFrame(b, "h1 long, h2 long, id long")).collect()) for b in batches]
    assert found == [[], [(1, 1, 10), (3, 3, 20)], [(2, 2, 10)], [(3, 3, 20)]]
    assert [len(x) for x in index.levels] == [0, 0, 1]
    assert sorted((r["h1"], r["first_id"]) for r in index.runs()[0].collect()) == [(1, 10), (2, 10), (3, 20), (4, 40)]
    index.forget()


# near duplicates

def test_jaccard_join_matches_brute_force(spark, small_docs):
    sets = {}
    for d, t in small_docs:
        w = re.findall(r"\w+", t.lower())
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    links, parent = Counter(), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and inter >= 0.8 * (len(sets[a]) + len(sets[b]) - inter):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op9_ngram_jaccard_join(spark, SF_SMALL).collect()}
    assert got == {d: (root(d), links[d]) for d in ids}


def test_large_group_is_verified_in_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(700)]
    got = near_dup.near_dup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"], r["class_size"]) for r in got} == {(0, 699, 700)}


def test_near_dup_edge_cases(odd_docs, no_docs):
    got = near_dup.near_dup_classes(odd_docs).collect()
    by = {(r["id"], r["th"]): r for r in got}
    assert len(got) == 13
    of = defaultdict(set)
    for i, _ in by:
        of[i] |= {(r["class_id"], r["n_links"]) for (j, _), r in by.items() if j == i}
    assert of[1] == {(1, 3)} and of[2] == {(1, 3)} and of[NULL_ID] == {(1, 3)}
    assert of[3] == {(3, 0)} and of[4] == {(4, 0)} and of[6] == {(6, 0)} and of[8] == {(7, 1)}
    kept = near_dup.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 9, 10, 10]))
    assert near_dup.near_dup_classes(no_docs).count() == 0 and near_dup.keep_one_of_each(no_docs).count() == 0


def test_equal_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3, "doc_id long, text string")
    assert near_dup.keep_one_of_each(df).count() == 1


def test_bands_reach_the_recall():
    b = near_dup.bands_for(0.8, 0.999, 4)
    assert 1 - (1 - 0.8**4) ** b >= 0.999 > 1 - (1 - 0.8**4) ** (b - 1)


def test_connected_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


# benchmark decontamination

BENCH = [(1, "If Tom buys 12 apples and 5 pears at the market, how many pieces does Tom carry home?"), (2, None), (3, ""), (4, "too short"), (5, "Why is it so")]


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "intro words. If Tom buys 12 apples and 5 pears at the market, how many pieces does Tom carry home?"),
        (2, "So if Anna buys 31 apples and 7 pears at the market, how many pieces does Anna carry home? Yes."),
        (3, "So if Anna buys 31 apples and 7 pears at the market, how many pieces does Berta carry home?"),  # slots disagree
        (4, "nothing of the kind is said in this text about markets and fruit at all"), (5, None)], "doc_id long, text string")
    got = {r["id"]: (r["item_id"], r["n_changed"] > 0) for r in decontam.contaminated(docs, bench).collect()}
    assert got[1] == (1, False) and got[2] == (1, True) and 3 not in got and 4 not in got
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()) == [3, 4, 5]


def test_decontamination_edge_cases(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontam.contaminated(odd_docs, bench).count() == 0
    assert decontam.drop_contaminated(odd_docs, bench).columns == odd_docs.columns
    assert decontam.contaminated(no_docs, bench).count() == 0
    assert decontam.drop_contaminated(odd_docs, bench.limit(0)).count() == 13


def test_verbatim_passages_are_found(spark, small_docs):
    bench = duckdb.sql(f"select item_id, text from '{SF_SMALL}/benchmark.parquet'").fetchall()
    want = {(d, i) for d, t in small_docs for i, x in bench if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_benchmark_decontamination(spark, SF_SMALL).collect()}
    assert want <= got


def test_passages_of_long_items_are_found(spark):
    """A run of 13 tokens is a leak whatever the item's length; the share stays a column."""
    words = [f"word{i}x" for i in range(300)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(f"item{i}y" for i in range(59)))], "item_id long, text string")
    own = lambda k: " ".join(f"own{k}z{i}" for i in range(30))
    cut = lambda k, lo, n: f"{own(k)} {' '.join(words[lo:lo + n])} {own(-k)}"
    docs = [(1, cut(1, 100, 100)), (2, cut(2, 0, 13)), (3, cut(3, 287, 13)), (4, cut(4, 50, 12)), (5, f"{own(5)} {' '.join(f'item{i}y' for i in range(20, 40))}"),
            (6, f"{own(6)} {' '.join(words[10:19])} {own(-6)} {' '.join(words[40:49])}")]  # two runs of 9
    got = {r["id"]: (r["item_id"], r["n_windows"], r["coverage"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: (1, 93, 93 / 293), 2: (1, 6, 6 / 293), 3: (1, 6, 6 / 293), 5: (2, 13, 13 / 52)}


def test_clashing_slots_drop_only_their_windows(spark):
    long = lambda k: " ".join(f"w{c}{k}" for c in "abcdefghijklmnop")
    bench = [(1, f"Every day 2 boxes are filled by hand while {long(1)} and then after 2 hours they close"),
             (2, f"On one day a man buys 3 apples and 5 pears while {long(2)} and asks for more"),
             (3, f"So here comes Karl with his dog while {long(3)} and then Karl goes home with his small dog"),
             (4, "What does Maria give to her friend Paul"), (5, "What does a Hund cost in the town of Bremen when the Markt is open")]
    docs = [(1, bench[0][1].replace("2 boxes", "3 boxes").replace("2 hours", "4 hours")), (2, bench[1][1].replace("3", "4").replace("5", "4")),
            (3, bench[2][1].replace("Karl goes", "Kral goes")), (4, bench[3][1].lower()), (5, bench[4][1].lower()),
            (6, "Question: " + bench[3][1]), (7, "QUESTION: " + bench[4][1].upper()), (8, bench[4][1].replace("Bremen", "Trier"))]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = {r["id"]: (r["item_id"], r["n_changed"]) for r in decontam.contaminated(frame(docs, "doc_id"), frame(bench, "item_id")).collect()}
    assert {d: i for d, (i, _) in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 4, 7: 5, 8: 5}
    assert got[1][1] == 2 and got[3][1] == 1 and got[4][1] == got[5][1] == got[6][1] == got[7][1] == 0 and got[8][1] == 1


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(s[::-1])) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_match_the_patterns(small_docs):
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("ab@.+1 2-0()9é%"), 40)) for _ in range(4000)]
    hard = ["@a.b@c.d", "x@a.b@c.d", "x@@a.b", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "+1 (212) 555-0100"]
    for t in hard + noise + [t for _, t in small_docs]:
        assert pii.base_spans(t) == plain_base_spans(t), t


def test_pii_query_and_edge_cases(spark, small_docs, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in queries.op3_pii(spark, SF_SMALL).collect()}
    for d, t in small_docs:
        base = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in plain_base_spans(t)]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[d]["spans"].split(","))  or not base
    assert pii.find_pii(odd_docs).count() == 13 and pii.find_pii(no_docs).count() == 0


def test_pii_counts_and_ids_of_mixed_rows(spark, tmp_path):
    """Each kind has its own count, and large ids beside NULL ids stay exact."""
    texts = [None, "", "mail a@b.co", "two x@y.z, a@b.co at 10.0.0.1", "ring +1 (555) 123-4567", "4111 1111 1111 1111 from 1.2.3.4 and 999.1.1.1",
             "1.1.1.1 2.2.2.2 3.3.3.3", "+1 555 123 4567 a@b.co 4111111111111111 8.8.8.8"]
    ids = [2**53 + 1, None, 2**53 + 3, -(2**60) - 1, 2**62 + 1, 7, 7, None]
    rows = list(zip(ids, texts))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        base = plain_base_spans(t or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        want.append((d, *(sum(x[0] == k for x in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    got = [tuple(r)[:6] for r in queries.op3_pii(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_runs_take_linear_time():
    """A megabyte of digits, letters, dotted numbers or spans within seconds."""
    import time
    start = time.process_time()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + " 1 (at) b", "1." * 500_000, "1.." * 300_000, "a.b" * 300_000 + "@", "tel 0414-555-1234, " * 40_000, "x (at) y.com " * 40_000):
        pii.candidates(text)
    assert time.process_time() - start < 60


def test_dotted_numbers_match_the_pattern():
    pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(8)
    for _ in range(3000):
        text = "".join(rng.choice(list("1253900.... a"), rng.integers(0, 40)))
        want = [(1, m.start(), m.end()) for m in pattern.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [x for x in pii.base_spans(text) if x[0] == 1] == want


def test_em_tells_good_labelers_from_bad():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth).astype(int) for a in (0.95, 0.9, 0.9, 0.55, 0.5, 0.5)], 1)
    q = pii.estimate_reliabilities(votes, np.zeros(4000, int), np.ones(4000))
    assert ((q > 0.5) == truth).mean() > 0.95


def test_wider_spans_are_added(spark):
    rows = [(i, f"please call our phone 212-555-01{i:02d} or mail bob{i}(at)site{i}.com now") for i in range(40)] + [(99, "plain words only")]
    got = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == [] and all("phone" in got[i] and "email" in got[i] for i in range(40))


# class n-grams

def test_class_lm_matches_brute_force(spark, small_docs):
    count = Counter()
    for d, t in small_docs:
        if zlib.crc32(str(d).encode()) % 10:
            count.update([*t.encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.op4_class_lm(spark, SF_SMALL).collect()}
    held = [0.0, 0.0]
    for d, t in small_docs:
        w = [*t.encode().lower().split(), None]
        r = got[d]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        if r["held_out"]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]  # classes predict unseen texts better than unigrams


@pytest.mark.parametrize("head_bytes", [class_lm.HEAD_BYTES, 3])  # 3: nearly all words go by the shuffle
def test_class_lm_score_matches_brute_force(spark, small_docs, monkeypatch, head_bytes):
    monkeypatch.setattr(class_lm, "HEAD_BYTES", head_bytes)
    docs = spark.createDataFrame([(d, t) for d, t in small_docs], "doc_id long, text string").repartition(3)
    train = docs.where(class_lm.training_row()).select(F.coalesce("text", F.lit("")).alias("t"))
    m = class_lm.fit_class_model(train)
    k, end = class_lm.CLASSES, class_lm.CLASSES - 1
    place = {w: i for i, w in enumerate(m.words)}
    rare = {r["hash"]: (r["cls"], r["n"]) for r in m.rare.collect()}
    hash_of = lambda w: int(np.array([class_lm.word_hash(w)], np.uint64).view(np.int64)[0])
    suffix = lambda w: m.unit_class[class_lm.suffix_unit(w)]
    context = lambda w: end if w is None else m.unit_class[m.head_unit[place[w]]] if w in place else suffix(w)

    def class_of(w):
        return end if w is None else m.head_class[place[w]] if w in place else rare.get(hash_of(w), (suffix(w), 0))[0]

    words = lambda t: [*(t or "").encode().lower().split(), None]
    count, joint, types = Counter(), np.zeros((k, k)), np.zeros(k)
    for d, t in small_docs:
        if zlib.crc32(str(d).encode()) % 10:
            last = None
            for w in words(t):
                count[w] += 1
                joint[context(last), class_of(w)] += 1
                last = w
    assert all((m.head_count[place[w]] if w in place else rare[hash_of(w)][1]) == n for w, n in count.items() if w is not None)
    assert len(set(map(class_of, count))) > 20  # rare words too are spread over the classes
    assert any(class_of(w) != suffix(w) for w in count if w is not None and w not in place) or not rare
    mass = joint.sum(0)
    for w in count:
        types[class_of(w)] += 1
    share = (mass + 1) / (mass + 1).sum()
    p = (joint + class_lm.PRIOR * share) / (joint.sum(1, keepdims=True) + class_lm.PRIOR)
    got = {r["doc_id"]: r["score"] for r in class_lm.score_texts(docs).collect()}
    for d, t in small_docs:
        score, last = 0.0, None
        for w in words(t):
            c = class_of(w)
            score += math.log10(p[context(last), c]) + math.log10((count[w] + class_lm.DELTA) / (mass[c] + class_lm.DELTA * (types[c] + 1)))
            last = w
        assert got[d] == pytest.approx(score, rel=1e-9)


def test_best_classes_is_the_full_information_difference():
    rng = np.random.default_rng(8)
    k, sides = class_lm.CLASSES, class_lm.SIDES
    of = rng.integers(0, 4, 12)
    table = np.zeros((12, sides))
    for w in range(12):
        table[w, rng.integers(0, 5, 6)] += rng.integers(1, 4)
        table[w, k + rng.integers(0, 5, 6)] += rng.integers(1, 4)

    def information(classes):
        cells = np.zeros((sides, k))
        for w, c in enumerate(classes):
            cells[:, c] += table[w]
        return sum(class_lm._xlogx(h).sum() - class_lm._xlogx(h.sum(0)).sum() for h in (cells[:k], cells[k:])), cells

    word, side = np.nonzero(table)
    got = class_lm.best_classes(word, side, table[word, side], of, information(of)[1])
    for w in range(12):
        tried = [information([*of[:w], c, *of[w + 1 :]])[0] for c in range(k - 1)]
        assert tried[got[w]] == pytest.approx(max(tried), abs=1e-9)


def test_class_lm_edge_cases(odd_docs, no_docs):
    rows = class_lm.score_texts(odd_docs).collect()
    assert len(rows) == 13 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 6)} == {1}
    assert class_lm.score_texts(no_docs).count() == 0


def test_class_lm_numbers_match_the_words(spark):
    rows = [(1, "B a  rare\tA end"), (2, ""), (None, "rare other rare"), (1, "a"), (3, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, t string").coalesce(1)
    got = [tuple(r) for r in class_lm.numbered(docs, [b"a", b"b"]).collect()]
    place, hashed = {"a": 0, "b": 1}, class_lm.word_hash
    for (d, t), (doc_id, numbers, rare) in zip(rows, got, strict=True):
        w = t.lower().split()
        assert doc_id == d
        assert np.frombuffer(numbers, np.int32).tolist() == [*(place.get(x, -1 - class_lm.suffix_unit(x.encode())) for x in w), class_lm.HEAD]
        assert np.frombuffer(rare, np.uint64).tolist() == [hashed(x.encode()) for x in w if x not in place]


def test_class_lm_cuts_texts_only_for_the_head_and_the_numbers(odd_docs, monkeypatch):
    from_texts = []
    for name in ("mapInPandas", "mapInArrow"):
        def recorded(self, *args, run=getattr(type(odd_docs), name), **kwargs):
            from_texts.append("t" in self.columns)
            return run(self, *args, **kwargs)

        monkeypatch.setattr(type(odd_docs), name, recorded)
    assert class_lm.score_texts(odd_docs).count() == 13
    assert sum(from_texts) == 2


def test_exchange_separates_alternating_words():
    rng = np.random.default_rng(6)
    pairs = np.zeros((33, 33))
    pairs[:16, 16:32] = rng.integers(20, 80, (16, 16))  # words of one kind follow words of the other
    pairs[16:32, :16] = rng.integers(20, 80, (16, 16))
    pairs[32, :16] = pairs[16:32, 32] = 5
    of = class_lm.exchange_classes(pairs, classes=3)
    assert len(set(of[:16])) == 1 and len(set(of[16:32])) == 1 and of[0] != of[16] and of[32] == 2


ARTICLE = "The council met on Monday and agreed to build a new bridge across the river. Work is to begin in the spring of next year."
TALK = "I have said for many years that nobody in this town would ever listen to us about that old bridge and its many holes. " * 4


@pytest.mark.parametrize("page", [
    f'<div class="widget"><article><p>{ARTICLE}</p></article></div><div class="comments"><p>{TALK}</p><p>{TALK}</p></div>',
    f'<div id="search"><article><p>{ARTICLE}</p></article></div><div class="related"><p>{TALK}</p><p>{TALK}</p></div>',
    f'<div class="social"><div><p>{ARTICLE}</p></div></div><section id="user-comments"><p>{TALK}</p></section>',
    f'<article><p>{ARTICLE}</p></article><div class="user-reviews"><p>{TALK}</p></div>',
    f'<article><p>{ARTICLE}</p></article><div id="responses"><p>{TALK}</p></div>',
    f'<div class="post comments-open"><p>{ARTICLE}</p></div><ol class="comment-list"><li>{TALK}</li></ol>',
    f'<main class="related"><p>{ARTICLE}</p></main>',
])
def test_main_text_is_the_article_however_long_the_comments(page):
    assert main_blocks(f"<html><body>{page}</body></html>") == [ARTICLE]


def test_main_text_of_comments_alone_is_empty():
    assert main_blocks(f'<body><div class="comments"><p>{TALK}</p></div></body>') == []


def test_unclosed_inline_elements_take_linear_time():
    def seconds(n):
        begin = time.process_time()
        blocks = main_blocks("<body><article>" + "<b>" * n + f"<p>{ARTICLE}</p>" * n)
        assert len(blocks) == n
        return time.process_time() - begin

    seconds(500)
    assert seconds(8000) < 3 * seconds(4000)


# toxicity


def test_automaton_forgets_states_but_not_results(monkeypatch):
    rng = np.random.default_rng(4)
    terms = [("".join(rng.choice(list("abcdefgh"), rng.integers(5, 10))), False) for _ in range(60)]
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 10))) for _ in range(3000)]
    whole = toxicity.LexiconAutomaton(terms, any_start=True)
    want = [whole.find(w) for w in words]
    monkeypatch.setattr(toxicity, "STATES", 2000)
    small = toxicity.LexiconAutomaton(terms, any_start=True)
    most = 0
    for w, hit in zip(words, want):
        assert small.find(w) == hit
        most = max(most, len(small.sets) + small.n_steps)
    # a word may add a state and a step a letter before the next look at the bound
    assert most <= 2000 + 2 * 10 < len(whole.sets) + whole.n_steps


def test_automaton_finds_misspellings():
    a = toxicity.LexiconAutomaton([("stupid", False), ("worthless", False), ("scum", False), ("lowei", True)])
    assert a.find("stupid") == (0, 0) and a.find("stuppid") == (0, 1) and a.find("stupd") == (0, 1) and a.find("st0pid") == (0, 1)
    assert a.find("wortles") == (1, 2) and a.find("scun") is None and a.find("scums") is None
    assert a.find("loweischaft") == (3, 0) and a.find("stud") is None


def test_automaton_matches_edit_distance():
    rng = np.random.default_rng(2)
    terms = ["".join(rng.choice(list("abc"), n)) for n in (4, 5, 6, 7, 9, 10)]
    a = toxicity.LexiconAutomaton([(t, False) for t in terms])

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    for _ in range(3000):
        w = "".join(rng.choice(list("abc"), int(rng.integers(3, 12))))
        near = [distance(w[1:], t[1:]) for t in terms if t[0] == w[0] and distance(w[1:], t[1:]) <= toxicity.allowed_edits(len(t))]
        assert (a.find(w) or (0, None))[1] == min(near, default=None), w


def test_first_letters_signs_and_quoted_misspellings():
    terms = [("stupid", False), ("worthless", False), ("scum", False), ("idiot", False)]
    a = toxicity.LexiconAutomaton(terms, any_start=True)
    assert [a.find(w) for w in ("xtupid", "tupid", "astupid", "orthles", "zworthless", "scun")] == [(0, 1), (0, 1), (0, 1), (1, 2), (1, 1), None]
    of = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, a) or [0.0] * len(toxicity.FEATURES)))
    for t in ("what a $tupid one", "a stup!d one", "these sc*m here", "an id!ot, he", "such w@rthless things", "an xdiot here"):
        assert of(t)["misspelt"] == math.log1p(1) and of(t)["misspelt_quoted"] == of(t)["plain"] == 0, t
    assert of("go!idiot and stop")["plain"] == math.log1p(1)  # signs without a space hide no word
    quoted = of("they said the word stuppid here")
    assert quoted["misspelt"] == 0 and quoted["misspelt_quoted"] == math.log1p(1)


def test_toxicity_held_out(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    got = {r["doc_id"]: (r["held_out"], r["predicted"], r["score"]) for r in queries.op5_toxicity(spark, sf).collect()}
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
    held = [(y, got[d][1]) for d, y in labels if got[d][0]]
    hit = sum(y and p for y, p in held)
    assert hit / sum(y for y, _ in held) > 0.8 and hit / max(1, sum(p for _, p in held)) > 0.85
    assert all(0 <= s <= 1 for _, _, s in got.values())


def test_toxicity_does_not_depend_on_the_layout(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    one, two = (toxicity.fit_toxicity(docs.repartition(n, F.rand(n)), labels.repartition(n)) for n in (2, 7))
    assert one.terms == two.terms and one.bias == two.bias and list(one.weights) == list(two.weights)


def test_toxicity_edge_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (None, 1, "x"), (4, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit_toxicity(odd_docs, labels)
    rows = toxicity.toxicity_scores(odd_docs, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity_scores(no_docs, model).count() == 0
    assert toxicity.fit_toxicity(no_docs, labels.limit(0)).terms == []


# packing

def test_packing_round_trip(spark, small_docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in queries.op6_packing(spark, SF_SMALL).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in small_docs:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= packing.SEQUENCE


def test_tokenizer_equals_the_whole_one():
    own = packing.PieceTokenizer(queries.tokenizer_path())
    for t in ["Hello, WORLD's 12 cafés!", "étude Åİ ΣΑΣ ßẞ", "a\x1cb <|endoftext|> c", "  \n", "日本 语!? don't 've", "x" * 5000, "naïve–dash … “q”"]:
        assert own.ids(t) == np.array(own.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing_plan_places_every_piece():
    rng = np.random.default_rng(4)
    histogram = Counter(int(x) for x in np.minimum(256, 1 + rng.gamma(2, 30, 30_000)))
    plan = packing.packing_plan(dict(histogram))
    used = Counter()
    for c, n in histogram.items():
        starts = [s for s, _, _ in plan[c]]
        assert starts == sorted(starts)
        for k, (rank, first, copies) in enumerate(plan[c]):
            for r in range(rank, plan[c][k + 1][0] if k + 1 < len(plan[c]) else n):
                used[first + (r - rank) // copies] += c
    assert max(used.values()) <= packing.UNITS
    assert len(used) <= 1.01 * sum(c * n for c, n in histogram.items()) / packing.UNITS + 3


def test_packing_edge_cases(odd_docs, no_docs):
    rows = packing.pack(odd_docs, queries.tokenizer_path()).collect()
    assert sum(r["start"] == 0 for r in rows) == 13
    assert {(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 1)}
    assert any(r["doc_id"] is None for r in rows)
    assert packing.pack(no_docs, queries.tokenizer_path()).count() == 0


# main text

def test_main_text_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>x";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them all now please.</div>
    <main><article><h2>Head &amp; line</h2><p>First  para<b>graph</b> with&nbsp;enough words to be called a sentence.<br>It goes on.<p>Second paragraph without end tag.
    <div class="ad">Buy now! Cheap things for everyone, today only in this shop.</div><ul><li>item one</li><li>item two</li></ul></article>
    <section id="comments"><p>I am a reader and I have a long comment about this article here.</p></section></main>
    <aside class=sidebar><p>Related reading that is long enough to look like some content.</p></aside><form><label>Mail</label><button>Send</button></form><footer>&copy; me</footer></body></html>"""
    assert main_blocks(page) == ["Head & line", "First paragraph with enough words to be called a sentence. It goes on.", "Second paragraph without end tag.", "item one", "item two"]


def test_notices_and_headers_by_class():
    words = "a sentence with more than ten words that could well be content."
    page = (f"<body><div id=header><p>Header, {words}</div><div class='site-notices'><p>Notice, {words}</div><article><div class=entry-header><h1>Title</h1></div>"
            f"<p>Text, {words}</p></article><ol class=commentlist><li>Comment, {words}</ol></body>")
    assert main_blocks(page) == ["Title", f"Text, {words}"]


@pytest.mark.parametrize("opening, closing", [
    ("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div class='no-sidebar'>", "</div>"), ("<div class='with-comments'>", "</div>"),
    ("<div class='social-story'><div>", "</div></div>"), ("<div class='page widget'><article>", "</article></div>"), ("<form id=aspnetForm><div>", "</div></form>"),
    ("<form><div class='sidebar-layout'><main>", "</main></div></form>")])
def test_marked_wrappers_do_not_hide_the_article(opening, closing):
    a, b, c = (f"Sentence number {k} of the article has more than ten plain words in it." for k in "abc")
    page = (f"<body><nav><a href=/>Home</a></nav>{opening}<h1>Title</h1><p>{a}<p>{b}<p>{c}<div id=comments><p>A comment that has more than ten words, but is no part of it.</p></div>"
            f"{closing}<footer><p>All rights of this page are reserved by the owner of the whole shop.</p></footer></body>")
    assert main_blocks(page) == ["Title", a, b, c]


def test_comments_longer_than_the_article_stay_out():
    words = "has more than ten plain words in it as sentences often do."
    page = f"<body><article><p>The article {words}</article><div id=comments>{f'<p>A comment {words}' * 9}</div></body>"
    assert main_blocks(page) == [f"The article {words}"]


@pytest.mark.parametrize("head", [
    "<body><svg class='i'/>", "<head><title>T</title><meta charset=x>", "<head><title>T</title><body>", "<body><div><svg class=i></div>", "<body><div><svg class=i><svg></svg></div>",
    "<body><select><option>one<option>two</select>", "<body><button>Go", "<head><noscript><img src=x></noscript><link href=x>", "<body><template><div>not shown</div></template>",
    "<body><iframe src=x/>", "<body><button>Go<div><button>On</button></div>"])
def test_unclosed_dropped_elements_do_not_hide_the_page(head):
    text = "This sentence of the page has more than ten plain words in it."
    assert main_blocks(f"<html>{head}<p>{text}</p><p>{text}</p></html>") == [text, text]


def test_minimum_cut_matches_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        cap = list(rng.normal(0, 2, n).round(2))
        edges = [(i, j, float(rng.random().__round__(2))) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(max(0, c) if not k else max(0, -c) for c, k in zip(cap, side)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(cap, edges)) == pytest.approx(best, abs=1e-6)


def test_pages_equal_their_articles(spark):
    pages = dict(duckdb.sql(f"select page_id, html from '{SF_SMALL}/pages.parquet'").fetchall())
    got = {r["page_id"]: r["text"] for r in queries.op7_main_text(spark, SF_SMALL).collect()}
    assert got.keys() == pages.keys()
    import html

    for i, h in pages.items():
        if h.count("<article>") == 1 and "<nav>" in h:
            body = h[h.index("<article>") : h.index("</article>")]
            want = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|article)>", body)]
            assert got[i] == "\n\n".join(x for x in want if x)


def test_main_text_edge_cases(spark):
    deep = "<div>" * 3000 + "<p>This is a long enough sentence in a very deep page.</p>"
    rows = [(1, None), (2, ""), (3, "<nav>only"), (4, "no markup at all, just a sentence of more than ten plain words."), (5, deep), (6, "<p>" + "many words here. " * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in df.select("page_id", main_text(F.col("html")).alias("text")).collect()}
    assert got[1] == got[2] == got[3] == "" and got[4] and got[5] and len(got[6]) > 600_000


# substring dedup

def test_gear_hash_matches_the_loop():
    data = bytes(np.random.default_rng(8).integers(0, 256, 3000, dtype=np.uint8))
    h, want = 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(substring_dedup.GEAR[b])) & 0xFFFF
        if h >> (16 - substring_dedup.CUT_BITS) == 0:
            want.append(i + 1)
    assert substring_dedup.cut_places(data).tolist() == want
    ends = substring_dedup.chunk_ends(want, len(data))
    assert ends[-1] == len(data) and all(b - a <= substring_dedup.LONGEST + substring_dedup.SHORTEST for a, b in zip([0, *ends], ends))


def test_inserted_text_does_not_hide_a_passage(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), int(rng.integers(3, 9))))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(60) for _ in range(30)]
    rows = [(2 * i, f"{text(80)} {p} {text(50)}") for i, p in enumerate(passage)] + [(2 * i + 101, f"{text(33)} {p} {text(70)}") for i, p in enumerate(passage)] + [(500, text(400))]
    got = {(r["id"], r["first_id"]) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(2 * i + 101, 2 * i) for i in range(30)}
    assert got <= want and len(got) >= 28


def test_substring_edge_cases(odd_docs, no_docs):
    rows = substring_dedup.repeated_passages(odd_docs, min_bytes=20).collect()
    assert {r["id"] for r in rows} >= {2} and not {r["id"] for r in rows} & {1, 3, 4, 5, 6}
    kept = substring_dedup.drop_repeated(odd_docs, min_bytes=20).select("row.doc_id", "kept_text").collect()
    assert len(kept) == 13 and {r["kept_text"] for r in kept if r["doc_id"] == 2} == {""}
    assert substring_dedup.repeated_passages(no_docs).count() == 0 and substring_dedup.drop_repeated(no_docs).count() == 0


# nearest neighbours

def test_hilbert_keys_step_to_neighbours():
    for d, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        path = cells[np.argsort(hilbert_ann.hilbert_keys(cells, bits))]
        assert sorted(hilbert_ann.hilbert_keys(cells, bits).tolist()) == list(range(side**d))
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_recall(spark):
    got = defaultdict(list)
    for r in queries.op10_hilbert_neighbours(spark, SF_SMALL.replace("0.001", "0.1")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    data = duckdb.sql(f"select vec_id, embedding from '{SF_SMALL.replace('0.001', '0.1')}/embeddings.parquet'").fetchall()
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    recall = []
    for q in ids[ids % 20 == 0]:
        near = x @ x[ids == q][0]
        near[ids == q] = -9
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(s == pytest.approx(near[ids == v][0], abs=1e-12) for _, v, s in mine)
        recall.append(len(set(ids[np.argsort(-near)[:20]]) & {v for _, v, _ in mine}) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.5, None], "a"), (4, None, "a"), (5, [0.0, 0.0], "a"),
            (6, [float("nan"), 1.0], "a"), (7, [float("inf"), 1.0], "a"), (None, [1.0, 1.0], "a"), (8, [1.0], "a"), (9, [3.0, 1.0], "a"), (9, [2.0, 1.0], "a"), (10, [], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, curve string")
    got = [tuple(r) for r in hilbert_ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 9, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)]
    assert hilbert_ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("noise", [0.0, 1e-4])
def test_neighbours_recall_in_a_group(spark, noise):
    """A third of the rows are equal vectors, or near copies that share a cell."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 16))
    x[::3] = x[0] + noise * rng.standard_normal((1000, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if not noise:
        x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hilbert_ann.nearest_neighbours(df, F.col("vec_id") % 60 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    recall = []
    for q in range(0, 3000, 60):
        near = np.cumsum(x * x[q], axis=1)[:, -1]
        near[q] = -9
        mine = [v for _, v in sorted(got[q])]
        if not noise:
            assert mine == [i for i in range(0, 66, 3) if i != q][:20]
        assert len(mine) == 20
        recall.append(len(set(np.argsort(-near, kind="stable")[:20].tolist()) & set(mine)) / 20)
    assert len(recall) == 50 and np.mean(recall) >= 0.97


# pipeline

def test_pipeline_stages(spark, small_docs):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, [set(r["doc_id"] for r in docs.collect())]
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, SF_SMALL), "test_stage")
        assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.collect()})
        assert kept[-1] <= kept[-2]
    lines = {r["doc_id"]: r["kept_text"] for r in line_dedup.line_dedup(p.STAGES[0][1](spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"), SF_SMALL)).select("row.doc_id", "kept_text", "n_dropped").where("n_dropped > 0").collect()}
    assert kept[2] == kept[1] - {i for i, t in lines.items() if not t.strip()} and kept[1] != kept[2]  # only what line dedup empties goes
    bench = duckdb.sql(f"select text from '{SF_SMALL}/benchmark.parquet'").fetchall()
    texts = [r["text"] for r in docs.collect()]
    assert not any(b in t for (b,) in bench for t in texts)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for t in texts if (w := re.findall(r"\w+", t.lower()))]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert len(a & b) < 0.8 * len(a | b)
    assert {r["doc_id"] for r in p.STAGES[-1][1](spark, docs, SF_SMALL).collect()} == kept[-1]


def test_pipeline_edge_cases(spark, odd_docs, no_docs):
    import corpus_pipeline as p

    for first in (odd_docs.withColumn("n_chars", F.length("text")), no_docs.withColumn("n_chars", F.length("text"))):
        docs = first
        for name, stage in p.STAGES[:-1]:
            docs = p.written(stage(spark, docs, SF_SMALL), "test_stage")
            assert docs.columns == first.columns
        p.STAGES[-1][1](spark, docs, SF_SMALL).collect()
