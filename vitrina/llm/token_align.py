"""Alignment of two tokenizers' tokens by lockstep merging, and how often pairs
of their tokens are linked in a corpus.

Every document is cut into lanes of bounded length at any byte offset; one NumPy
state vector holds the A and B pointers of all lanes of a block of documents.
Each step compares the ends of the two current tokens of every lane, emits their
link, emits a cut where they end together, advances the side that ends first,
and leaves out the lanes that are done. Cuts divide a document into groups; every
A token of a group is linked to every B token of it.

Pair counts take two shuffles: each block counts its distinct pairs over its
documents, the sums by pair are joined back to the blocks that hold the pair,
and each block looks its own links up.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from vitrina.llm.bpe_index import UNSETTLED, blocks, encoder_at
from vitrina.llm.shared import written

BLOCK_BYTES = 1_500_000  # of text aligned at once; a longer text is a block of its own
ENCODE_BYTES = 6_000_000  # of text encoded at once: a merge rank costs about the same for few words as for many
LANE_BYTES = 1_024

KNOWN_STRETCHES = 200_000  # that a worker remembers between blocks
KNOWN_LENGTH = 64  # characters; longer stretches are encoded again in every block
# From a blank after a visible character to the next such place. White space is
# what Python calls so, which includes what either tokenizer does.
STRETCH = re.compile(r"\s++\S*+(?:[^\S ]\s*+\S*+)*+")


class PieceTokens:
    """Ids and bytes of a sentencepiece BPE model's tokens.

    No piece of the model may hold a space after another character (checked), so
    merges never pass from a word into the blanks behind it.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path}: not a model whose words stand alone")
        self.entry = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.entry_length = np.array([len(e) for e in self.entry], np.int64)
        self.blank = self.model.piece_to_id("▁")

    def encode(self, stretches: list[str]) -> list[list[int]]:
        """Ids of stretches that begin with a blank; the model puts one before every
        text itself, but gives an empty text no ids."""
        ids = self.model.encode([w[1:] for w in stretches], num_threads=1) if stretches else []
        return [[self.blank] if w == " " else i for w, i in zip(stretches, ids)]


@functools.cache
def pieces_at(path: str) -> PieceTokens:
    return PieceTokens(path)


class StretchTokens:
    """A and B ids of texts by their stretches, each encoded once while it is known.

    No token of A or B passes from a visible character into a blank, and A's word
    pattern never looks further than the end of a run of white space. So the ids
    of space + text are, on both sides, those of its stretches in a row.
    """

    def __init__(self, path_a: str, path_b: str):
        self.one, self.two = encoder_at(path_a, False), pieces_at(path_b)
        self.a: dict[str, bytes] = {}
        self.b: dict[str, bytes] = {}
        self.odd: set[str] = set()  # stretches that B does not give back

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A ids and B ids of each text; none on either side where B's bytes are
        not those of space + text (a byte-level vocabulary has all bytes, so A
        gives every text back)."""
        parts = [STRETCH.findall(" " + t) if t else [] for t in texts]
        used = set().union(*parts)
        new = list(used.difference(self.a))
        if len(self.a) + len(new) > KNOWN_STRETCHES:  # what this block uses stays
            self.a, self.b = ({w: ids for w, ids in side.items() if w in used} for side in (self.a, self.b))
            self.odd &= used
        self.a |= self._a_ids(new)
        ids_b = self.two.encode(new)
        self.b |= zip(new, (array("I", ids).tobytes() for ids in ids_b))
        entry = self.two.entry.__getitem__
        if b"".join(map(entry, itertools.chain.from_iterable(ids_b))) != "".join(new).encode():
            self.odd.update(w for w, ids in zip(new, ids_b) if b"".join(map(entry, ids)) != w.encode())
        rows = [[np.frombuffer(b"".join(map(side.__getitem__, row)), "<u4") for row in parts] for side in (self.a, self.b)]
        nothing = np.zeros(0, "<u4")
        for k, row in enumerate(parts):
            if self.odd and not self.odd.isdisjoint(row) and b"".join([self.two.entry[i] for i in rows[1][k].tolist()]) != (" " + texts[k]).encode():
                rows[0][k] = rows[1][k] = nothing
        for w in new:
            if len(w) > KNOWN_LENGTH:
                del self.a[w], self.b[w]
                self.odd.discard(w)
        return rows[0], rows[1]


    def _a_ids(self, new: list[str]) -> dict[str, bytes]:
        """A ids of stretches: as one text where each ends visibly, cut at their lengths in bytes."""
        open_end = [w for w in new if w[-1].isspace() or UNSETTLED.search(w)]
        out = dict(zip(open_end, self.one.encode(open_end)))
        closed = [w for w in new if w not in out]
        for group in ([w for w in closed if w.isascii()], [w for w in closed if not w.isascii()]):
            ids = self.one.encode(["".join(group)])[0]
            ends = np.cumsum(self.one.entry_length[np.frombuffer(ids, "<u4")])
            at = (4 * np.searchsorted(ends, np.cumsum([len(w.encode()) for w in group]), "right")).tolist()
            out |= {w: ids[x:y] for w, x, y in zip(group, [0, *at], at)}
        return out


@functools.cache
def stretches_at(path_a: str, path_b: str) -> StretchTokens:
    """One for all tasks of a worker, so that its stretches stay known."""
    return StretchTokens(path_a, path_b)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, lane_bytes: int = LANE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps (a, b, cut) over two ascending lists of token ends of the same
    bytes: the numbers of the tokens linked at the step, by lane, and where both
    end. All steps together give every overlapping pair once and every common
    end once."""
    size = int(end_a[-1]) if len(end_a) else 0
    lanes = np.arange(0, size, lane_bytes, dtype=np.int64)
    a, b = np.searchsorted(end_a, lanes, "right"), np.searchsorted(end_b, lanes, "right")
    stop = np.minimum(lanes + lane_bytes, size)
    while len(a):
        x, y = end_a[a], end_b[b]
        here = np.minimum(x, y) <= stop  # else the next lane begins with this pair
        if not here.all():
            a, b, stop, x, y = a[here], b[here], stop[here], x[here], y[here]
        yield a, b, x == y
        a, b = a + (x <= y), b + (y <= x)
        more = (a < len(end_a)) & (b < len(end_b))
        if not more.all():
            a, b, stop = a[more], b[more], stop[more]


def token_groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A tokens and which B tokens end a group, as booleans."""
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    for a, b, cut in lockstep(end_a, end_b):
        cut_a[a[cut]] = True
        cut_b[b[cut]] = True
    return cut_a, cut_b


def group_links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, times) of all links, by group: ``key`` is A id * size_b + B id. A group
    with many tokens on both sides is multiplied out over its distinct ids only."""
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    n_a, n_b = last_a - first_a + 1, last_b - first_b + 1
    small = n_a * n_b <= 1_000
    k = np.flatnonzero(small)
    each_a = np.repeat(k, n_a[k])  # group of every A token of a small group
    at_a = np.repeat(first_a[k] - np.cumsum(n_a[k]) + n_a[k], n_a[k]) + np.arange(len(each_a))
    times = n_b[each_a]
    group = np.repeat(each_a, times)
    at_b = np.repeat(first_b[each_a] - np.cumsum(times) + times, times) + np.arange(len(group))
    key = np.repeat(a[at_a], times) * size_b + b[at_b]
    groups, keys, counts = [group], [key], [np.ones(len(key), np.int64)]
    for g in np.flatnonzero(~small):
        ids_a, of_a = np.unique(a[first_a[g] : last_a[g] + 1], return_counts=True)
        ids_b, of_b = np.unique(b[first_b[g] : last_b[g] + 1], return_counts=True)
        keys.append((ids_a[:, None] * size_b + ids_b).ravel())
        counts.append((of_a[:, None] * of_b).ravel())
        groups.append(np.full(len(keys[-1]), g))
    group, key, times = np.concatenate(groups), np.concatenate(keys), np.concatenate(counts)
    if len(groups) > 1:
        order = np.argsort(group, kind="stable")
        group, key, times = group[order], key[order], times[order]
    return group, key, times


def stored_ids(ids: np.ndarray, size: int) -> bytes:
    """Ids of a vocabulary of this size, two or four bytes each, compressed."""
    return zstandard.compress(ids.astype("<u2" if size <= 2**16 else "<u4").tobytes(), 3)


def read_ids(stored: bytes, size: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(stored), "<u2" if size <= 2**16 else "<u4").astype(np.int64)


class Block:
    """Aligned documents of one block, as flat arrays."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], cut_a: np.ndarray, cut_b: np.ndarray, size_b: int):
        self.key_span = (int(max((x.max(initial=0) for x in ids_a), default=0)) + 1) * size_b
        self.n_a = np.array([len(x) for x in ids_a], np.int64)
        self.n_b = np.array([len(x) for x in ids_b], np.int64)
        a = np.concatenate([*ids_a, np.zeros(0, np.int64)]).astype(np.int64)
        b = np.concatenate([*ids_b, np.zeros(0, np.int64)]).astype(np.int64)
        docs = np.arange(len(ids_a))
        of_group = np.repeat(docs, self.n_a)[cut_a]
        self.n_groups = np.bincount(of_group, minlength=len(docs))
        group, self.key, self.times = group_links(a, b, cut_a, cut_b, size_b)
        self.doc = of_group[group]
        self.n_links = self.sums(self.times)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Exact sums of a value per link, by document."""
        total = np.append(0, np.cumsum(values))
        return np.diff(np.append(0, total[np.searchsorted(self.doc, np.arange(len(self.n_a)), "right")]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and how many of the block's documents hold each."""
        held = np.sort(self.doc * self.key_span + self.key)
        held = held[np.diff(held, prepend=-1) > 0]
        return np.unique(held % self.key_span, return_counts=True)


def align_ids(ids_a: list[np.ndarray], ids_b: list[np.ndarray], path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """The booleans of ``token_groups`` for texts given by their A ids and B ids."""
    both = stretches_at(path_a, path_b)
    flat_a, flat_b = (np.concatenate([*ids, np.zeros(0, "<u4")]) for ids in (ids_a, ids_b))
    return token_groups(np.cumsum(both.one.entry_length[flat_a]), np.cumsum(both.two.entry_length[flat_b]))


def _aligned(path_a: str, path_b: str, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = encoder_at(path_a, False).size, pieces_at(path_b).size
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, end in blocks(batch.column("t"), ENCODE_BYTES):
                texts = batch.column("t").slice(start, end - start)
                all_a, all_b = stretches_at(path_a, path_b).encode(texts.to_pylist())
                for lo, hi in blocks(texts, BLOCK_BYTES):
                    ids_a, ids_b = all_a[lo:hi], all_b[lo:hi]
                    cut_a, cut_b = align_ids(ids_a, ids_b, path_a, path_b)
                    kinds, docs = Block(ids_a, ids_b, cut_a, cut_b, size_b).pairs()
                    bits = [[np.packbits(c).tobytes() for c in np.split(cut, np.cumsum([len(x) for x in ids])[:-1])] for cut, ids in ((cut_a, ids_a), (cut_b, ids_b))]
                    rest = [None] * (hi - lo - 1)
                    ids = [[stored_ids(x, size) for x in side] for side, size in ((ids_a, size_a), (ids_b, size_b))]
                    columns = [[number] * (hi - lo), *ids, *bits,
                               [kinds.astype("<i8").tobytes(), *rest], [docs.astype("<u4").tobytes(), *rest]]
                    arrays = [batch.column("id").slice(start + lo, hi - lo), *(pa.array(c, out.field(i + 1).type) for i, c in enumerate(columns))]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)
                    number += 1

    return run


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligned documents: rows (id, block, a, b, a_cut, b_cut, pairs, pair_docs).

    ``a`` and ``b`` are the token ids of space + text by the byte-level BPE file
    and of text by the sentencepiece model, little-endian unsigned 32-bit;
    ``a_cut`` and ``b_cut`` one bit a token (the first in the highest bit): whether
    a group ends with it. ``pairs`` and ``pair_docs`` (64 and 32 bits; on the
    first row of a block only) are the block's distinct linked pairs, A id * B's size + B id, and how
    many of its documents hold each. A block is about 1.5 million bytes of
    neighbouring rows. The rows are written to the shared folder, so block
    numbers stay.

    One row per input row; a NULL or empty text, or one that either tokenizer
    does not give back byte by byte, has no tokens; repeated rows count as
    documents of their own, a NULL id stays NULL, an empty table gives no rows,
    other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    binary = [StructField(n, BinaryType()) for n in ("a", "b", "a_cut", "b_cut", "pairs", "pair_docs")]
    out = StructType([src.schema["id"], StructField("block", LongType()), *binary])
    return written(src.mapInArrow(_aligned(path_a, path_b, to_arrow_schema(out)), out), "aligned", compression="zstd")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, docs in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "pair_docs"))):
            key = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key), pa.array(np.frombuffer(docs, "<u4").astype(np.int64))], ["block", "pair", "docs"])


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """Rows (pair, a, n_docs, best): in how many documents a pair is linked, and
    whether no pair of its A id is linked in more."""
    pairs = aligned.where("pairs is not null").select("block", "pairs", "pair_docs").mapInArrow(_unpacked, "block long, pair long, docs long")
    counts = written(pairs.groupBy("pair").agg(F.sum("docs").alias("n_docs")).withColumn("a", F.expr(f"pair div {size_b}")), "pair_counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # at most one row an A id of the vocabulary
    return counts.join(F.broadcast(most), "a").select("pair", "a", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


@functools.cache
def _marked(size_a: int, size_b: int) -> list[str]:
    """Texts of tokens: A inside a group and at its end, then B."""
    return [f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for mark in marks for i in range(size)]


def group_texts(ids_a: list[np.ndarray], ids_b: list[np.ndarray], cuts_a: list[np.ndarray], cuts_b: list[np.ndarray], size_a: int, size_b: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    table, out = _marked(size_a, size_b).__getitem__, []
    for a, b, cut_a, cut_b in zip(ids_a, ids_b, cuts_a, cuts_b):
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        mixed = np.empty(len(a) + len(b), np.int64)
        # an A token comes after the B tokens of earlier groups, a B token after the A tokens of its own
        mixed[np.arange(len(a)) + np.append(0, last_b + 1)[np.cumsum(cut_a) - cut_a]] = a + size_a * cut_a
        mixed[np.arange(len(b)) + np.append(last_a + 1, 0)[np.cumsum(cut_b) - cut_b]] = b + 2 * size_a + size_b * cut_b
        out.append("".join(map(table, mixed.tolist()))[:-1])
    return out


def _scored(size_a: int, size_b: int, out: pa.Schema):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        ids_a, ids_b = ([read_ids(x, n) for x in docs.column(c).to_pylist()] for c, n in (("a", size_a), ("b", size_b)))
        cuts = [[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(x)).astype(bool) for bits, x in zip(docs.column(c).to_pylist(), ids)] for c, ids in (("a_cut", ids_a), ("b_cut", ids_b))]
        block = Block(ids_a, ids_b, *(np.concatenate([*c, np.zeros(0, bool)]) for c in cuts), size_b)
        key, signed = (counts.column(c).to_numpy() for c in ("pair", "signed"))  # negative: the best of its A id
        n_best = count_sum = np.zeros(len(ids_a), np.int64)
        if len(block.key):
            order = np.argsort(key)
            at = order[np.searchsorted(key, block.key, sorter=order)]
            n_best, count_sum = block.sums((signed[at] < 0) * block.times), block.sums(abs(signed[at]) * block.times)
        groups = group_texts(ids_a, ids_b, *cuts, size_a, size_b)
        values = [block.n_a, block.n_b, block.n_groups, block.n_links, n_best, count_sum, groups]
        return pa.Table.from_arrays([docs.column("id").combine_chunks(), *(pa.array(v, out.field(i + 1).type) for i, v in enumerate(values))], schema=out)

    return run


def link_scores(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of the
    documents of ``align_tokens``: their numbers of tokens, groups and links, the
    links whose pair no other pair of the A id outnumbers in the corpus, the sum of
    the pairs' document counts over the links, and the groups as text
    (``a1,a2|b1;a3|b2,b3``; '' without tokens)."""
    wanted = aligned.where("pairs is not null").select("block", "pairs", "pair_docs").mapInArrow(_unpacked, "block long, pair long, docs long")
    counts = wanted.select("block", "pair").join(pair_counts(aligned, size_b), "pair").select("block", "pair", F.when(F.col("best"), -F.col("n_docs")).otherwise(F.col("n_docs")).alias("signed"))
    longs = [StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    out = StructType([aligned.schema["id"], *longs, StructField("groups", StringType())])
    docs = aligned.select("id", "block", "a", "b", "a_cut", "b_cut")
    return docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_scored(size_a, size_b, to_arrow_schema(out)), out)
