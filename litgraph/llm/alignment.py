"""Cross-tokenizer alignment over an inverted index of pair bitmaps.

Each text is encoded by two tokenizers: A of a byte-level vocabulary (its rank file and splitting pattern), B of a piece model.
Byte offsets where tokens of both end cut it into groups, and every occurrence
of a token of A is linked with every occurrence of a token of B in its group.

1. The scan deals documents to chunks of bounded size and inverts each: for every linked pair of ids a compressed bitmap
   of the chunk's documents that hold it (sorted 16-bit numbers where that is shorter, else one bit a document), and
   multiplicity planes: plane j holds the documents in which the number of links less one has bit j - 1. The documents
   of a task's later texts are OR-merged into its open chunk, which is closed by its size.
2. Chunks are disjoint, so a pair's documents are the sum of its bitmaps' population counts, and its links that of the
   planes' by their weights: one aggregation with partial sums. The highest count of each A id has at most as many rows
   as A's vocabulary and is broadcast.
3. Postings return scores: each bitmap row meets its pair's count and goes back to its chunk, where counts are added
   to the documents whose bits are set, by the planes' weights. A chunk's rows are bounded by its size.

A large group's links are made from its distinct ids and their numbers, never from pairs of occurrences.

Cases: null and empty texts, and texts whose joined A or B bytes are not a space and the text, have no tokens: every
number is 0 and ``groups`` is ''. Very long texts are aligned whole, in a chunk of their own. Repeated rows are documents
of their own. Ties for an A id's highest count all count as best. An empty table gives no rows. Only the id and text
columns are used, whatever other columns there are.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes, written

CHUNK_CHARS, CHUNK_DOCS = 8_000_000, 1 << 15  # a chunk is closed at either (a text is never cut)
PIECE_CHARS = 400_000  # texts encoded at once
LINKS = 1 << 21  # links expanded at once
WIDE_GROUP = 256  # links of a group that are made from distinct ids


@lru_cache(maxsize=4)
def byte_level(path: str, pattern: str) -> tuple:
    """The tokenizer of a byte-level vocabulary, from its rank file and splitting pattern, and the bytes of each id."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(entry): int(i) for entry, i in map(bytes.split, f)}
    held = [b""] * (max(ranks.values()) + 1)
    for entry, i in ranks.items():
        held[i] = entry
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), held


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple:
    """The tokenizer of a piece model and the bytes of each id."""
    from sentencepiece import SentencePieceProcessor
    t = SentencePieceProcessor(model_file=path)
    held = []
    for i in range(t.get_piece_size()):
        piece = t.id_to_piece(i)
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if t.is_byte(i) else None
        held.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return t, held


def _flat(of_each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in of_each], np.int64)
    return np.fromiter(chain.from_iterable(of_each), np.int32, int(n.sum())), n


class Encoder:
    """Both tokenizers of a task, and the decimal texts of their ids with each separator that may follow."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        (self.a, self.a_bytes), (self.b, self.b_bytes) = byte_level(a_path, pattern), pieces(b_path)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.said = [f"{i}{s}" for s in ",|" for i in range(len(self.a_len))] + [f"{i}{s}" for s in (",", ";", "") for i in range(len(self.b_len))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their number by text, and of B; none for a text without tokens."""
        spaced = [" " + (t or "") for t in texts]
        a, na = _flat([self.a.encode_ordinary(t) for t in spaced])
        b, nb = _flat(self.b.encode([t or "" for t in texts], num_threads=1))
        want = [text_bytes(t) for t in spaced]
        together = b"".join(want)
        size = np.array([len(w) if len(w) > 1 else -1 for w in want])
        ok = np.ones(len(texts), bool)
        for ids, n, held, length in ((a, na, self.a_bytes, self.a_len), (b, nb, self.b_bytes, self.b_len)):
            ends = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(n)])]
            ok &= np.diff(ends) == size
            joined = b"".join(map(held.__getitem__, ids.tolist()))
            if joined != together:
                for i in np.flatnonzero(ok).tolist():
                    ok[i] = joined[ends[i]:ends[i + 1]] == want[i]
        return a[np.repeat(ok, na)], na * ok, b[np.repeat(ok, nb)], nb * ok

    def group(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group number of each token of both; token bytes of both add up alike."""
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)

    def groups(self, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, starts: np.ndarray, na: np.ndarray, nb: np.ndarray) -> list[str]:
        """The groups of each text, as ``a1,a2|b1;a3|b2,b3``; ``starts`` has each text's first group and their number."""
        n, va, vb = int(starts[-1]), len(self.a_len), len(self.b_len)
        before_a, before_b = np.searchsorted(ga, np.arange(n + 1)), np.searchsorted(gb, np.arange(n + 1))
        last_a = np.append(ga[1:] != ga[:-1], True)[:len(a)]
        last_b = np.append(gb[1:] != gb[:-1], True)[:len(b)]
        final = np.zeros(n, bool)
        final[starts[1:][np.diff(starts) > 0] - 1] = True
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + before_b[ga]] = a + va * last_a
        out[np.arange(len(b)) + before_a[gb + 1]] = b + 2 * va + vb * (last_b.astype(np.int64) + (last_b & final[gb]))
        codes = out.tolist()
        at = np.concatenate([[0], np.cumsum(na + nb)]).tolist()
        return ["".join(map(self.said.__getitem__, codes[i:j])) for i, j in zip(at, at[1:])]


def links(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, doc: np.ndarray, vb: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair << 16 | document, number of links), not yet summed; ``doc`` is each group's document."""
    n = len(doc)
    at_a, at_b = np.searchsorted(ga, np.arange(n + 1)), np.searchsorted(gb, np.arange(n + 1))
    wide = np.diff(at_a) * np.diff(at_b) > WIDE_GROUP
    for g in np.flatnonzero(wide).tolist():
        ia, ca = np.unique(a[at_a[g]:at_a[g + 1]], return_counts=True)
        ib, cb = np.unique(b[at_b[g]:at_b[g + 1]], return_counts=True)
        step = max(1, LINKS // len(ib))
        for s in range(0, len(ia), step):
            pair = (ia[s:s + step, None].astype(np.int64) * vb + ib).ravel()
            yield pair << 16 | doc[g], (ca[s:s + step, None] * cb).ravel()
    own = np.flatnonzero(~wide[ga]) if len(ga) else np.empty(0, np.int64)
    each = np.diff(at_b)[ga[own]]
    ends = np.cumsum(each)
    begin = 0
    while begin < len(own):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LINKS, "right")))
        k = each[begin:end]
        g = np.repeat(ga[own[begin:end]], k)
        place = np.arange(len(g)) - np.repeat(np.cumsum(k) - k, k)
        pair = np.repeat(a[own[begin:end]], k).astype(np.int64) * vb + b[at_b[g] + place]
        yield summed(pair << 16 | doc[g], None)
        begin = end


def summed(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their numbers (ones if None)."""
    if n is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def bitmaps(pair: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pair, population count, compressed bitmap) of sorted postings: sorted numbers, or ``docs`` bits where shorter."""
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[:len(pair)])
    n = np.diff(np.append(first, len(pair)))
    wide = -(-docs // 8)
    data = doc.astype("<u2").tobytes()
    dense = np.flatnonzero(2 * n > wide)
    if not len(dense):
        return pair[first], n, pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(2 * first, 2 * len(pair)).astype(np.int32)), pa.py_buffer(data)])
    held = [data[2 * i:2 * (i + k)] for i, k in zip(first.tolist(), n.tolist())]
    for i in dense.tolist():
        bits = np.zeros(8 * wide, bool)
        bits[doc[first[i]:first[i] + n[i]]] = True
        held[i] = np.packbits(bits, bitorder="little").tobytes()
    return pair[first], n, pa.array(held, pa.binary())


def unpacked(n: np.ndarray, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, document) of each set bit; a bitmap is of bits if it is shorter than its sorted numbers."""
    size = np.array([len(h) for h in held], np.int64)
    dense = np.flatnonzero(size < 2 * n)
    listed = np.flatnonzero(size == 2 * n)
    rows, docs = [np.repeat(listed, n[listed])], [np.frombuffer(b"".join(held[i] for i in listed.tolist()), "<u2").astype(np.int64)]
    for i in dense.tolist():
        docs.append(np.flatnonzero(np.unpackbits(np.frombuffer(held[i], np.uint8), bitorder="little")))
        rows.append(np.full(len(docs[-1]), i))
    return np.concatenate(rows), np.concatenate(docs)


ROWS = ("chunk long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "pair long, plane int, n long, docs binary")


class Chunk:
    """The open chunk of a task: document rows, and links not yet inverted."""

    def __init__(self, number: int):
        self.number, self.rows, self.key, self.n, self.chars, self.docs = number, [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0

    def add(self, coder: Encoder, ids: pa.Array, texts: list[str | None], digest: bool) -> None:
        a, na, b, nb = coder.encode(texts)
        ga, gb = coder.group(a, b)
        of_group = np.zeros(int(ga[-1]) + 1 if len(ga) else 0, np.int64)
        of_group[ga] = np.repeat(np.arange(len(texts)), na)
        starts = np.searchsorted(of_group, np.arange(len(texts) + 1))
        said = coder.groups(a, ga, b, gb, starts, na, nb)
        if digest:
            said = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
        per_group = np.bincount(ga, minlength=len(of_group)) * np.bincount(gb, minlength=len(of_group))
        n_links = np.bincount(of_group, per_group, len(texts)).astype(np.int64)
        self.rows.append(pa.RecordBatch.from_arrays([pa.array(np.arange(self.docs, self.docs + len(texts)), pa.int32()), ids, pa.array(na), pa.array(nb),
                                                     pa.array(np.diff(starts)), pa.array(n_links), pa.array(said, pa.string())],
                                                    ["at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]))
        for key, n in links(a, ga, b, gb, of_group + self.docs, len(coder.b_len)):
            self.key.append(key)
            self.n.append(n)
        self.docs += len(texts)
        self.chars += sum(len(t) for t in texts if t)

    def closed(self) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                            ("n_links", pa.int64()), ("groups", pa.string()), ("pair", pa.int64()), ("plane", pa.int32()), ("n", pa.int64()), ("docs", pa.binary())])

        def full(**cols: pa.Array) -> pa.RecordBatch:
            size = len(next(iter(cols.values())))
            cols["chunk"] = pa.array(np.full(size, self.number))
            return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(size, f.type) for f in schema], schema=schema)

        for rows in self.rows:
            yield full(**{name: rows.column(name) for name in rows.schema.names})
        key, n = summed(np.concatenate(self.key), np.concatenate(self.n))
        for plane in range(int(n.max()).bit_length() + 1 if len(n) else 0):
            some = key if plane == 0 else key[(n - 1) >> (plane - 1) & 1 == 1]
            pair, count, held = bitmaps(some >> 16, some & 0xFFFF, self.docs)
            for s in range(0, len(pair), 1 << 16):
                part = slice(s, s + (1 << 16))
                yield full(pair=pa.array(pair[part]), plane=pa.array(np.full(len(pair[part]), plane), pa.int32()), n=pa.array(count[part]), docs=held[part])


@dataclass
class Alignment:
    """``docs``: (chunk, at, doc_id, n_a, n_b, n_groups, n_links, groups); ``postings``: (chunk, pair, plane, n, docs);
    ``pairs``: (pair, a, b, n_docs, n_links) of every linked pair, corpus-wide."""
    docs: DataFrame
    postings: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, digest: bool = False, doc_id: str = "doc_id", text: str = "text") -> Alignment:
    """Alignment of every text; with ``digest``, ``groups`` is the SHA-256 of the groups' text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, number = Encoder(a_path, pattern, b_path), TaskContext.get().partitionId(), 0
        chunk = Chunk(task << 32)
        for batch in batches:
            for part, texts in slices(batch, text, PIECE_CHARS):
                size = sum(len(t) for t in texts if t)
                if chunk.docs and (chunk.chars + size > CHUNK_CHARS or chunk.docs + len(texts) > CHUNK_DOCS):
                    yield from chunk.closed()
                    number += 1
                    chunk = Chunk(task << 32 | number)
                chunk.add(coder, part.column("doc_id"), texts, digest)
        if chunk.docs:
            yield from chunk.closed()

    _, held = pieces(b_path)
    vb = len(held)
    rows = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, ROWS), "alignment-rows")
    postings = rows.where("pair is not null").select("chunk", "pair", "plane", "n", "docs")
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    pairs = postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links"))
    pairs = written(pairs.select("pair", F.expr(f"pair div {vb}").alias("a"), F.pmod("pair", F.lit(vb)).alias("b"), "n_docs", "n_links"), "alignment-pairs")
    return Alignment(rows.where("pair is null").select("chunk", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"), postings, pairs)


def scores(found: Alignment) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every document: its links whose pair has the
    highest document count of its A id, and the sum of its links' counts."""
    highest = found.pairs.groupBy("a").agg(F.max("n_docs").alias("highest"))  # one row an A id at most
    counted = found.pairs.join(F.broadcast(highest), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))
    met = found.postings.join(counted, "pair").select("chunk", "plane", "n", "docs", "n_docs", "best")

    def run(rows: pa.Table) -> pa.Table:
        row, doc = unpacked(rows.column("n").to_numpy(), rows.column("docs").to_pylist())
        weight = np.left_shift(np.int64(1), np.maximum(rows.column("plane").to_numpy().astype(np.int64) - 1, 0))
        n = int(doc.max()) + 1
        sums, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(sums, doc, (weight * rows.column("n_docs").to_numpy())[row])
        np.add.at(best, doc, (weight * rows.column("best").to_numpy(zero_copy_only=False))[row])
        some = np.flatnonzero(sums)
        return pa.table({"chunk": pa.array(np.full(len(some), rows.column("chunk")[0].as_py())), "at": pa.array(some, pa.int32()),
                         "n_best": pa.array(best[some]), "count_sum": pa.array(sums[some])})

    back = met.groupBy("chunk").applyInArrow(run, "chunk long, at int, n_best long, count_sum long")
    return found.docs.join(back, ["chunk", "at"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
