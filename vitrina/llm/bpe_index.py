"""Byte-level BPE by a pair occurrence index.

A block of a partition's texts is cut into words by the vocabulary's own word
pattern. The words not yet known are laid out in one array of symbols, and every
adjacent pair that has a merge rank is entered under its rank with all places
where it stands. Ranks are then taken in ascending order: each merges its places
from left to right and enters the pairs that the merges create under their own,
later ranks. One pass over the active ranks encodes all the words of the block.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

BLOCK_BYTES = 1_500_000  # of text encoded at once; a longer text is a block of its own
KNOWN_WORDS = 200_000  # words a worker remembers between blocks
KNOWN_LENGTH = 64  # characters; longer words are encoded again in every block
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same over characters up to U+024F, for the faster of the two libraries.
LETTERS, DIGITS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
PLAIN_WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
NOT_PLAIN = re.compile("[^\0-\u024f]")
# Outside these ranges Unicode has gained letters and digits lately, so that two
# libraries may class a character differently; such texts are cut into words by
# the tokenizer file's own library.
UNSETTLED = re.compile("[^\u0000-\u0557\u0590-\u088e\u0900-\u0c5b\u0ce0-\u208e\u20a0-\ua7cd\uac00-\ud7a3\uf900-\ufffd\U0001f000-\U0001faff]")
GAP, GONE = -1, -2  # symbols between two words, and of a place merged into its left neighbour


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the others as letters from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """Bytes of every token of a byte-level vocabulary, by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    value = {c: b for b, c in enumerate(byte_letters())}
    entries = {i: bytes(value[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    entries |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


def decode_ids(ids: bytes, entry: list[bytes]) -> str:
    """Text of ids; ids outside the vocabulary stand for nothing, and bytes that
    are no UTF-8 become U+FFFD."""
    n = len(entry)
    return b"".join([entry[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]).decode("utf-8", "replace")


class PairIndexBPE:
    """Encoder for a byte-level BPE file of the ``tokenizers`` library.

    ``specials``: whether the strings of added tokens inside texts become those
    tokens (as the library does by default) or stay ordinary text. Files with a
    normalizer, a prefix space, or added tokens that strip or match whole words
    only are refused, as are files whose merges do not stand in the order in
    which their parts arise (then ascending ranks would not be enough).
    """

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, words = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [t["content"] for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if spec.get("normalizer") or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex") or odd:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        vocab, letters = model["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        rank = {a * self.size + b: r for r, (a, b, _) in reversed([*enumerate(self.merges)])}
        self.pairs = np.array(sorted(rank) or [-2])
        self.pair_ranks = np.array([rank.get(p, -1) for p in self.pairs.tolist()])
        made = {c: r for r, (_, _, c) in reversed([*enumerate(self.merges)])}
        if any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b, _) in enumerate(self.merges)) or len(made) < len(merges):
            raise ValueError(f"{path}: merges are not in the order of their parts")
        self.byte_id = np.array([vocab[c] for c in letters])
        self.byte_pairs = np.array([[rank.get(a * self.size + b, -1) for b in self.byte_id.tolist()] for a in self.byte_id.tolist()])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.entry = token_bytes(path)
        self.entry_length = np.array([len(e) for e in self.entry], np.int64)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if specials and self.added else None
        self.path, self.known = path, {}

    @functools.cached_property
    def library_words(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        letters = {c: b for b, c in enumerate(byte_letters())}
        cut = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        return lambda text: [bytes(letters[c] for c in w).decode() for w, _ in cut(text)]

    def words(self, text: str) -> list[str]:
        if not NOT_PLAIN.search(text):
            return PLAIN_WORD.findall(text)
        if not UNSETTLED.search(text):
            return WORD.findall(text)
        return self.library_words(text)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (native unsigned 32-bit), all words at once."""
        data = b"\0".join([b"", *words, b""])
        value = np.frombuffer(data, np.uint8)
        gaps = np.append(0, np.cumsum(np.array([len(w) for w in words], np.int64) + 1))
        symbol = self.byte_id[value]
        symbol[gaps] = GAP
        ranks = self.byte_pairs[value[:-1], value[1:]]
        ranks[(symbol[:-1] < 0) | (symbol[1:] < 0)] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        firsts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        places = {int(ranks[at[0]]): at.tolist() for at in np.split(order, firsts[1:]) if len(at)}
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.merges[r]
            here = np.array(places.pop(r))
            there = after[here]
            live = (symbol[here] == a) & (symbol[there] == b)  # others went to an earlier merge
            here, there = here[live], there[live]
            if len(here) > 1:
                order = np.argsort(here)
                order = order[np.diff(here[order], prepend=-1) > 0]
                here, there = here[order], there[order]
                if a == b:  # of places in a row every second one is left to its left neighbour
                    row = np.arange(len(here))
                    row -= np.maximum.accumulate(np.where(np.append(True, there[:-1] != here[1:]), row, 0))
                    here, there = here[row % 2 == 0], there[row % 2 == 0]
            symbol[here], symbol[there] = new, GONE
            right = after[there]
            after[here] = right
            before[right] = here
            left = before[here]
            place = np.concatenate([left, here])
            first, second = symbol[place], symbol[np.concatenate([here, right])]
            pair = np.where((first >= 0) & (second >= 0), first * self.size + second, -1)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = self.pairs[at] == pair
            for later, i in zip(self.pair_ranks[at[known]].tolist(), place[known].tolist()):
                if later in places:
                    places[later].append(i)
                else:
                    places[later] = [i]
                    heapq.heappush(active, later)
        bounds = (4 * np.append(0, np.cumsum(symbol >= 0))[gaps]).tolist()
        ids = symbol[symbol >= 0].astype("<u4").tobytes()
        return [ids[x:y] for x, y in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as native (little-endian) unsigned 32-bit numbers."""
        parts: list[list] = []
        for t in texts:
            if self.special is None or not self.special.search(t):
                parts.append(self.words(t))
                continue
            row, at = [], 0
            for m in self.special.finditer(t):
                row += [*self.words(t[at : m.start()]), self.added[m.group()]]
                at = m.end()
            parts.append(row + self.words(t[at:]))
        used = {w for w in set().union(*parts) if isinstance(w, str)}
        new = list(used.difference(self.known))
        if len(self.known) + len(new) > KNOWN_WORDS:  # what this block uses stays
            self.known = {w: ids for w, ids in self.known.items() if w in used}
        self.known |= zip(new, self.merge_words([w.encode() for w in new]))
        self.known |= {i: array("I", [i]).tobytes() for i in self.added.values()}
        of = self.known.__getitem__
        out = [b"".join(map(of, row)) for row in parts]
        for w in new:
            if len(w) > KNOWN_LENGTH:
                del self.known[w]
        return out


@functools.cache
def encoder_at(path: str, specials: bool = True) -> PairIndexBPE:
    """One encoder for all tasks of a worker, so that its words stay known."""
    return PairIndexBPE(path, specials)


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of about ``most`` bytes together."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _encoded(path: str, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(path, specials)
        for batch in batches:
            for lo, hi in blocks(batch.column("t")):
                ids = pa.array(encoder.encode(batch.column("t").slice(lo, hi - lo).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), ids], ["id", "ids"])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """Rows (id, ids): each text's token ids as little-endian unsigned 32-bit
    numbers, as the ``tokenizers`` library gives them without special tokens of
    its own.

    One row per input row in no order; repeated rows and ids stay, a NULL id
    stays NULL, a NULL or empty text has no ids (empty binary), an empty table
    gives no rows, other columns are not read. Words of any length and texts of
    any length are encoded whole, in time about linear in their length.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return src.mapInArrow(_encoded(path, specials), StructType([src.schema["id"], StructField("ids", BinaryType())]))


def bpe_decode(ids: Column, path: str) -> Column:
    """Text of a column of ids as ``bpe_encode`` gives them; NULL stays NULL."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        entry = token_bytes(path)
        return pd.Series([None if v is None else decode_ids(v, entry) for v in column], dtype=object)

    return text(ids)
