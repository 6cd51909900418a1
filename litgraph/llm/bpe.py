"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token starts as one symbol per byte. A tree whose leaves hold ``rank * width + position`` of each adjacent pair
has the leftmost pair of lowest rank at its root; a merge changes at most three leaves, each repaired in a
logarithmic number of steps, until the root is empty. Many short pre-tokens are merged side by side, one tree to a
row of a numpy array; a long one has a tree of its own.

The vocabulary file is that of a public tokenizer: NFC, lower case by character, white space dropped, byte-level
symbols, a suffix on the last symbol of a pre-token; its special tokens are cut out of the raw text first.

Cases: a null text is encoded like an empty one (no ids, decoded to ""). Repeated rows are encoded each. Very long
texts and pre-tokens are encoded whole. Other columns pass through; one that has an output's name is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

EMPTY = np.int64(1 << 62)
CACHE_BYTES = 16_000_000  # of remembered runs and their ids, about 500,000 runs
WIDEST_ROW = 64
# Control characters that Arrow takes for white space and the tokenizer for symbols.
ODD_SPACES = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\s+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    chars = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def unsettled() -> frozenset[str]:
    """Letters and numbers that the regex module knows and this Python's Unicode tables do not: code points assigned
    later, which the tokenizer takes for symbols."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


class PairTable:
    """(left id, right id) -> (rank, merged id): an open-addressed table that whole arrays are looked up in."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, vocab: int):
        self.vocab = vocab
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, EMPTY, np.int64)
        self.merged = np.zeros(size, np.int64)
        todo, keys = np.arange(len(left)), left.astype(np.int64) * vocab + right
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.ranks[slot[won]], self.merged[slot[won]] = rank[todo[won]], merged[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (size - 1)
        self.scalar = dict(zip(keys.tolist(), zip(rank.tolist(), merged.tolist(), strict=True), strict=True))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (EMPTY without a merge) and merged id of each pair; a negative id has no pair."""
        keys = np.where((left < 0) | (right < 0), -2, left * self.vocab + right)
        slot = self._slot(keys)
        rank, merged = np.full(len(keys), EMPTY), np.zeros(len(keys), np.int64)
        at = np.flatnonzero(keys >= 0)
        while len(at):
            held = self.keys[slot[at]]
            hit = held == keys[at]
            rank[at[hit]], merged[at[hit]] = self.ranks[slot[at[hit]]], self.merged[slot[at[hit]]]
            at = at[~hit & (held != -1)]
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
        return rank, merged


def merge_rows(sym: np.ndarray, table: PairTable) -> np.ndarray:
    """Merges every row of ``sym`` (width a power of two, -1 after the end) to its end; -1 where a symbol went."""
    n, width = sym.shape
    levels = width.bit_length() - 1
    place = np.arange(width)
    after = np.where((place + 1 < width) & (np.roll(sym, -1, 1) >= 0), place + 1, -1)
    after[:, -1] = -1
    before = np.broadcast_to(place - 1, (n, width)).copy()
    right = np.where(after >= 0, np.roll(sym, -1, 1), -1)
    rank, merged = table.find(sym.ravel(), right.ravel())
    into = merged.reshape(n, width)
    tree = np.full((n, 2 * width), EMPTY, np.int64)
    tree[:, width:] = np.where(rank == EMPTY, EMPTY, rank * width + np.tile(place, n)).reshape(n, width)
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def put(row: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
        node = leaf + width
        tree[row, node] = key
        for _ in range(levels):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair(row: np.ndarray, leaf: np.ndarray) -> None:
        """The leaf's key anew, from its symbol and the one after it."""
        nxt = after[row, leaf]
        r, m = table.find(sym[row, leaf], np.where(nxt >= 0, sym[row, nxt], -1))
        into[row, leaf] = m
        put(row, leaf, np.where(r == EMPTY, EMPTY, r * width + leaf))

    row = np.flatnonzero(tree[:, 1] != EMPTY)
    while len(row):
        i = tree[row, 1] % width
        j = after[row, i]
        k = after[row, j]
        sym[row, i], sym[row, j] = into[row, i], -1
        after[row, i] = k
        has = k >= 0
        before[row[has], k[has]] = i[has]
        put(row, j, np.full(len(row), EMPTY))
        pair(row, i)
        left = before[row, i]
        has = left >= 0
        pair(row[has], left[has])
        row = row[tree[row, 1] != EMPTY]
    return sym


def merge_one(sym: list[int], table: PairTable) -> list[int]:
    """The same for one long pre-token, with a tree in a list."""
    n, pairs, vocab = len(sym), table.scalar, table.vocab
    width = 1 << max(1, (n - 1).bit_length())
    none = int(EMPTY)
    tree, into = [none] * (2 * width), [0] * n
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]

    def key(i: int) -> int:
        j = after[i]
        got = pairs.get(sym[i] * vocab + sym[j]) if j >= 0 else None
        if got is None:
            return none
        into[i] = got[1]
        return got[0] * width + i

    for i in range(n):
        tree[width + i] = key(i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1] != none:
        i = tree[1] % width
        j = after[i]
        k = after[j]
        sym[i], sym[j] = into[i], -1
        after[i] = k
        if k >= 0:
            before[k] = i
        put(j, none)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    return [s for s in sym if s >= 0]


class Bpe:
    """Encoder and decoder of one vocabulary file; words once encoded are remembered, up to ``CACHE_BYTES``."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = dict(model["vocab"]), model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [""] * self.size
        for text, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = text
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.table = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2], self.size)
        chars = byte_alphabet()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.late = unsettled()
        self.known: dict[str, bytes] = {}  # a run without white space -> its ids
        self.held = 0

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token given as bytes."""
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        width, done = 4, 0
        while done < WIDEST_ROW:
            at = np.flatnonzero((lengths > done) & (lengths <= width))
            if len(at):
                flat = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in at.tolist()]), np.uint8).reshape(-1, width)
                end = lengths[at][:, None] - 1
                place = np.arange(width)
                sym = merge_rows(np.where(place < end, self.first[flat], np.where(place == end, self.last[flat], -1)), self.table)
                kept = sym >= 0
                raw = sym[kept].astype("<u4").tobytes()
                cuts = [0, *(4 * np.cumsum(kept.sum(1))).tolist()]
                for k, i in enumerate(at.tolist()):
                    out[i] = raw[cuts[k]:cuts[k + 1]]
            width, done = width * 2, width
        for i in np.flatnonzero(lengths > WIDEST_ROW).tolist():
            raw = np.frombuffer(pieces[i], np.uint8)
            out[i] = np.array(merge_one([*self.first[raw[:-1]].tolist(), int(self.last[raw[-1]])], self.table), "<u4").tobytes()
        return out

    def pieces(self, run: str) -> list[str]:
        """Pre-tokens of a run without white space."""
        if run.isalpha():
            return [run]
        if run.isascii() or self.late.isdisjoint(run):
            return self.split.findall(run)
        plain = "".join("\u2603" if c in self.late else c for c in run)
        return [run[m.start():m.end()] for m in self.split.finditer(plain)]

    def _learn(self, runs: list[str]) -> None:
        """Encodes runs without white space and remembers them."""
        found = [self.pieces(r) for r in runs]
        pieces = list({p for f in found for p in f})
        ids = dict(zip(pieces, self.merge([p.encode("utf-8", "replace") for p in pieces]), strict=True))
        for r, f in zip(runs, found, strict=True):
            self.known[r] = got = ids[f[0]] if len(f) == 1 else b"".join([ids[p] for p in f])
            self.held += len(r) + len(got)

    @staticmethod
    def _plain(text: str) -> str:
        """Composed and in lower case, character by character: lower() of a whole text turns a capital sigma at a
        word's end into another letter than lower() of it alone."""
        text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def _ids(self, runs: list[str]) -> list[bytes]:
        """Ids of each run without white space, learning those not seen yet."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        ids = list(map(self.known.get, runs))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            self._learn(list({runs[i] for i in gaps}))
            for i in gaps:
                ids[i] = self.known[runs[i]]
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. The distinct runs of all texts are encoded
        once, then their ids are laid out in the texts' order."""
        parts, special, spans = [], [], []
        for text in texts:
            text, begin = text or "", len(parts)
            for p in self.cut.split(text) if self.cut is not None and "<|" in text else [text]:
                own = self.special.get(p)
                plain = self._plain(p) if own is None else ""
                if ODD_SPACES.search(plain):
                    own, plain = b"".join(self._ids(SPACE.split(plain))), ""
                special.append(own)
                parts.append(plain)
            spans.append((begin, len(parts)))
        runs = pc.utf8_split_whitespace(pa.array(parts, pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(length) - length
        which = coded.indices.to_numpy(zero_copy_only=False)
        taken = length[which]
        ends = np.concatenate([[0], np.cumsum(taken)])
        pool = np.frombuffer(b"".join(ids), "<u4")
        laid = pool[np.repeat(begin[which] - ends[:-1], taken) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[runs.offsets.to_numpy() - runs.offsets[0].as_py()]).tolist()
        out = []
        for a, b in spans:
            if b - a == 1 and special[a] is None:
                out.append(laid[cuts[a]:cuts[b]])
            else:
                out.append(b"".join([laid[cuts[i]:cuts[i + 1]] if special[i] is None else special[i] for i in range(a, b)]))
        return out

    def decode(self, ids: bytes) -> str:
        """Token texts with a space between, as the vocabulary has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of ``text`` (binary, little-endian unsigned 32-bit) and, on demand, the text that these
    ids decode to. The work stays in the input's partitions: no shuffle."""
    new = [ids, *([decoded] if decoded else [])]
    keep = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*keep, T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part, texts in slices(batch, text):
                out = bpe.encode(texts)
                cols = [part.column(n) for n in names] + [pa.array(out, pa.binary())]
                if decoded:
                    cols.append(pa.array([bpe.decode(i) for i in out], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*names, *new])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that the binary ``ids`` decode to; null ids are an empty text."""
    keep = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part, values in slices(batch, ids):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([bpe.decode(v or b"") for v in values], pa.string())], [*names, text])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(text, T.StringType())]))
