"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are cut into blocks of ``BLOCK_WORDS`` words; each block has a 64-bit digest that also counts its
repetition in the text. Three hashes put a digest into one cell of each third of a sketch; a cell holds a count, the
exclusive or of its digests and of their checks. The fingerprint is the sketch of ``BASE`` cells a third.

Two fingerprints are compared by subtracting their cells and peeling: a cell with one digest left gives that digest
away, which is taken out of its other cells, until none is left. What is recovered is the digests of either text that
the other lacks. If cells remain, both sketches are built anew with four times the cells. Many pairs are subtracted
and peeled side by side.

Neighbours in the order of ids meet without a global sort in one task: sampled splitters cut the ids into ranges, each
range's first document is also sent to the range before, and rows stream through in order.

Cases: null and empty texts have no blocks, an empty sketch, and are wholly alike. Texts of any length are taken
whole. Rows that repeat an id follow each other in the order of their texts; rows without an id come last. A single
row is its own neighbour. An empty table gives no rows. Other columns are not returned.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64
from .shards import LOWEST, range_of, splitters

BLOCK_WORDS = 4
BASE = 8
GROW = 4
CHECK = np.uint64(0xD6E8FEB86659FD93)


def blocks(text: str | None) -> np.ndarray:
    """Distinct 64-bit digests of a text's blocks; the k-th copy of a block has a digest of its own."""
    found = []
    for paragraph in (text or "").split("\n"):
        w = paragraph.split()
        found += [" ".join(w[i:i + BLOCK_WORDS]) for i in range(0, len(w), BLOCK_WORDS)]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    h.sort()
    if len(h) > 1 and (h[1:] == h[:-1]).any():
        first = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        copy = np.arange(len(h)) - start
        h = np.where(copy > 0, mix64(h + copy.astype(np.uint64) * CHECK), h)
    return h


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each of the three thirds."""
    h = mix64(keys)
    return np.stack([(h >> np.uint64(21 * k)) % np.uint64(cells) + np.uint64(k * cells) for k in range(3)]).astype(np.int64)


class Sketches:
    """Sketches of one size side by side: row i belongs to the i-th set."""

    def __init__(self, sets: list[np.ndarray], cells: int):
        self.cells, self.wide = cells, 3 * cells
        n = len(sets) * self.wide
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if sets:
            keys = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            self.put(keys, owner, np.ones(len(keys), np.int64))

    def put(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        check = mix64(keys ^ CHECK)
        for at in places(keys, self.cells) + owner * self.wide:
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def row(self, i: int) -> bytes:
        at = slice(i * self.wide, (i + 1) * self.wide)
        return self.count[at].astype("<i2").tobytes() + self.key[at].astype("<u8").tobytes() + (self.check[at] >> np.uint64(32)).astype("<u4").tobytes()

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches([], self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Taken digests as (owner, key, sign) rounds; which rows are empty at the end. The cells are used up."""
        rounds = []
        look = np.arange(len(self.count))
        while True:
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == mix64(self.key[look] ^ CHECK))]
            if not len(pure):
                break
            owner, key, sign = pure // self.wide, self.key[pure], self.count[pure]
            _, once = np.unique(key ^ mix64(owner.astype(np.uint64) + CHECK), return_index=True)
            owner, key, sign = owner[once], key[once], sign[once]
            rounds.append((owner, key, sign))
            self.put(key, owner, -sign)
            look = np.unique((places(key, self.cells) + owner * self.wide).ravel())
        left = (self.count != 0) | (self.key != 0)
        return rounds, ~left.reshape(-1, self.wide).any(1)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    built = Sketches(sets, BASE)
    return [base64.b64encode(built.row(i)).decode() for i in range(len(sets))]


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests that only the left, and only the right, set of each pair has, recovered by peeling."""
    only = [[None] * len(left), [None] * len(left)]
    todo, cells = np.arange(len(left)), BASE
    while len(todo):
        a, b = [left[i] for i in todo], [right[i] for i in todo]
        rounds, ended = Sketches(a, cells).minus(Sketches(b, cells)).peel()
        owner = np.concatenate([np.empty(0, np.int64), *(r[0] for r in rounds)])
        key = np.concatenate([np.empty(0, np.uint64), *(r[1] for r in rounds)])
        sign = np.concatenate([np.empty(0, np.int64), *(r[2] for r in rounds)])
        for side, want in enumerate((1, -1)):
            mine = sign == want
            order = np.argsort(owner[mine], kind="stable")
            cuts = np.searchsorted(owner[mine][order], np.arange(len(todo) + 1))
            keys = key[mine][order]
            for k in np.flatnonzero(ended).tolist():
                only[side][todo[k]] = keys[cuts[k]:cuts[k + 1]]
        todo, cells = todo[~ended], cells * GROW
    return only[0], only[1]


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    """Twice the common blocks over all blocks; 1 for two empty sets."""
    a, b = differences(left, right)
    return [1.0 - (len(x) + len(y)) / n if (n := len(s) + len(t)) else 1.0 for s, t, x, y in zip(left, right, a, b, strict=True)]


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the start of another."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, halo, doc_id, text), dealt by range and sorted by descending id: each row is followed by its next
    document, the last one of a range by a copy (halo 1) of the first one of the next range."""
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = docs.count()
    ranges = max(1, min(n // 512, 2000), n // 100_000)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = docs.where(chance < F.lit(ranges * 32 / max(1, n) * (1 << 20))).select("doc_id").collect()
    cuts = [(k, LOWEST) for k in dict.fromkeys(k for k, _ in splitters([(r[0], 0, 1.0) for r in sample], ranges))]
    ranged = docs.withColumn("range", range_of(F.col("doc_id"), F.lit(0), cuts))
    firsts = sorted((r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.max("doc_id").alias("first")).collect())
    target = {r: firsts[(i + 1) % len(firsts)][0] for i, (r, _) in enumerate(firsts)}
    none = F.lit(None).cast("bigint")
    of_first = dict(firsts)
    first = F.element_at(F.split(F.lit(",".join(str(of_first.get(r, "")) for r in range(len(cuts) + 1))), ",").cast("array<string>"), F.col("range") + 1)
    to = F.element_at(F.split(F.lit(",".join(str(target.get(r, 0)) for r in range(len(cuts) + 1))), ",").cast("array<int>"), F.col("range") + 1)
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("halo"))
    copied = F.when(F.col("doc_id").cast("string") == first, F.array(own, F.struct(to.alias("range"), F.lit(1).alias("halo")))).otherwise(F.array(own))
    dealt = ranged.withColumn("at", F.explode(copied)).select("at.range", "at.halo", "doc_id", "text")
    del none
    return dealt.repartition("range").sortWithinPartitions("range", "halo", F.desc("doc_id"), "text")


def compare_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_pairs: int = 400, batch_chars: int = 3_000_000) -> DataFrame:
    """The fingerprints of every document and of its edited text, and how alike they and the next document are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
            changed = [edited(t, f) for _, t, f in pairs]
            own, new = [blocks(t) for _, t, _ in pairs], [blocks(t) for t in changed]
            follow = [*own[1:], blocks(pairs[-1][2])]
            follow = [f if i + 1 == len(pairs) or pairs[i + 1][1] is pairs[i][2] else blocks(pairs[i][2]) for i, f in enumerate(follow)]
            return pa.RecordBatch.from_arrays([
                pa.array([None if d == LOWEST else d for d, *_ in pairs], pa.int64()), pa.array([len(t) for _, t, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array(fingerprints(own), pa.string()), pa.array(fingerprints(new), pa.string()),
                pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, follow), pa.float64())],
                [c.split()[0] for c in RESULT.split(", ")])

        held, pairs, chars = None, [], 0
        for batch in batches:
            for r, halo, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == r:
                    pairs.append((held[1], held[2], t))
                    chars += len(held[2])
                held = None if halo else (r, d, t)
                if len(pairs) >= batch_pairs or chars > batch_chars:
                    yield out(pairs)
                    pairs, chars = [], 0
        if pairs:
            yield out(pairs)

    return with_neighbours(docs, doc_id, text).mapInArrow(run, RESULT)
