"""Benchmark decontamination by winnowing.

A word is a 64-bit hash, a fingerprint the hash of ``GRAM`` consecutive words. Of each window of ``SPAN`` words (six
fingerprints) the least is kept, of equal ones the last, so that a span of ``SPAN`` words that a document shares with
an item gives both of them the same fingerprint at the same place: no such span is missed, though only about two of
seven fingerprints are kept. An item of fewer words is one window of its own, whose only fingerprint is the whole.

1. The items give (hash, item, the words around) for each kept fingerprint.
2. Their hashes become a Bloom filter of a bounded size, whatever their number. It goes to the scan of the documents,
   which is the only step that sees all fingerprints and lets few through.
3. What is left is joined with the items' fingerprints on the hash; a hit is extended to both sides word by word, by at
   most ``SPAN - GRAM`` words, since a window further off has a fingerprint of its own. Extensions that reach a whole
   window are spans.
4. Spans and items are gathered by document.

Words count as equal if their 64-bit hashes are; a span needs that of each of its words.

Cases: a null or empty text, or one without words, has no words, spans or items; such an item has no windows. Very long
texts are scanned whole, in blocks of words. Repeated documents are answered each. Items that repeat an id are one item
with the windows of all; a null item id is the empty string. An empty table of documents gives no rows, an empty one of
items no hits. Only the id and text columns are used, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import mix64, slices, written

SPAN, GRAM = 10, 5
SIDE = SPAN - GRAM  # words that a hit is extended by to each side
BLOCK = 1 << 18  # window starts worked on at once
BLOOM_BITS = (1 << 16, 1 << 27)  # the filter's least and greatest size: at most 16 MB

# Fixed: words are runs of bytes outside these, after A-Z were lower-cased.
BLANK = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if (low := b | 0x20 if 0x41 <= b <= 0x5A else b) in BLANK else low for b in range(256))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = whole.take(pa.array(np.arange(len(whole))))  # an array of its own, without the slice's offset
    offsets, data = whole.buffers()[1:]
    folded = pa.py_buffer(data.to_pybytes().translate(FOLD)) if data is not None else pa.py_buffer(b"")
    runs = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(whole), [None, offsets, folded]))
    coded = runs.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    which = coded.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(whole), dtype=np.int32), np.diff(runs.offsets.to_numpy()))
    if b"" in names:
        real = which != names.index(b"")
        which, of = which[real], of[real]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[which], of


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place on."""
    n = max(0, len(h) - size + 1)
    out = mix64(h[:n] + np.uint64(size))
    for j in range(1, size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j:n + j])
    return out


def winnowed(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the least fingerprint of each window of SPAN words of one text."""
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for begin in range(0, max(0, len(h) - SPAN + 1), BLOCK):
        end = min(begin + BLOCK, len(h) - SPAN + 1)
        g = grams(h[begin:end + SPAN - 1], GRAM)
        n = end - begin
        least, at = g[:n].copy(), np.zeros(n, np.int8)
        for s in range(1, SPAN - GRAM + 1):
            lower = g[s:n + s] <= least
            least[lower], at[lower] = g[s:n + s][lower], s
        inside = np.flatnonzero(of[begin:end] == of[begin + SPAN - 1:end + SPAN - 1])
        place = inside + at[inside]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]  # places do not fall from window to window of one text
        places.append(begin + place[first])
        hashes.append(least[inside[first]])
    place, hash_ = np.concatenate(places), np.concatenate(hashes)
    place, one = np.unique(place, return_index=True)
    return place, hash_[one]


def around(h: np.ndarray, of: np.ndarray, place: np.ndarray, edge: int) -> np.ndarray:
    """The SIDE words before (nearest first) and after each fingerprint; ``edge`` beyond the text."""
    at = place[:, None] + np.concatenate([-1 - np.arange(SIDE), GRAM + np.arange(SIDE)])
    real = (at >= 0) & (at < len(h))
    at = np.where(real, at, 0)
    real &= of[at] == of[place][:, None]
    return np.where(real, h[at], np.uint64(edge)).astype(np.int64) if len(place) else np.empty((0, 2 * SIDE), np.int64)


def short(h: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every run of ``size`` words of one text."""
    g = grams(h, size)
    inside = np.flatnonzero(of[:len(g)] == of[size - 1:]) if len(g) else np.empty(0, np.int64)
    return inside, g[inside]


def _arrays(near: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), 2 * SIDE).cast(pa.list_(pa.int64()))


def item_fingerprints(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, hash, k, need, near): a row for each kept fingerprint of k words; need is its window's number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in slices(batch, text):
                h, of = hashed_words(part.column(text))
                n = np.bincount(of, minlength=len(part))
                place, hash_ = winnowed(h, of)
                near, k = around(h, of, place, 2), np.full(len(place), GRAM)
                need = np.full(len(place), SPAN)
                for size in sorted(set(n[(n > 0) & (n < SPAN)].tolist())):
                    at, g = short(h, of, size)
                    at, g = at[n[of[at]] == size], g[n[of[at]] == size]
                    place, hash_ = np.append(place, at), np.append(hash_, g)
                    near = np.vstack([near, np.full((len(at), 2 * SIDE), 2)])
                    k, need = np.append(k, np.full(len(at), size)), np.append(need, np.full(len(at), size))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(of[place])), pa.array(hash_.astype(np.int64)), pa.array(k, pa.int32()),
                                                  pa.array(need, pa.int32()), _arrays(near)], ["item", "hash", "k", "need", "near"])

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias(text))
    return named.mapInArrow(run, "item string, hash long, k int, need int, near array<long>").distinct()


def bloom(prints: DataFrame) -> np.ndarray:
    """The filter as words of 64 bits: built by one aggregation, which returns at most BLOOM_BITS[1] / 64 rows."""
    n = prints.select("hash").distinct().count()
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], 1 << (64 * n).bit_length()))
    set_ = prints.select(F.explode(F.array(F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1)))).alias("bit"))
    got = set_.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("at").to_numpy()] = got.column("mask").to_numpy().astype(np.uint64)
    return out


def maybe(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the filter's."""
    out, mask = np.ones(len(hashes), bool), np.uint64(64 * len(filter_) - 1)
    for bit in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        out &= (filter_[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


SCANNED = "doc_id long, n_words long, prints array<struct<hash: long, at: int, near: array<long>>>"


def scan(docs: DataFrame, filter_, sizes: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, prints) of each document: its fingerprints that pass the filter, and runs of the short items'
    ``sizes``. ``filter_`` is a broadcast variable."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in slices(batch, text):
                h, of = hashed_words(part.column(text))
                n = np.bincount(of, minlength=len(part))
                start = np.concatenate([[0], np.cumsum(n)])
                place, hash_ = winnowed(h, of)
                some = maybe(filter_.value, hash_)
                place, hash_ = place[some], hash_[some]
                near = around(h, of, place, 1)
                for size in sizes:
                    at, g = short(h, of, size)
                    some = maybe(filter_.value, g)
                    place, hash_ = np.append(place, at[some]), np.append(hash_, g[some])
                    near = np.vstack([near, np.ones((int(some.sum()), 2 * SIDE), np.int64)])
                order = np.argsort(place, kind="stable")
                place, hash_, near = place[order], hash_[order], near[order]
                prints = pa.StructArray.from_arrays([pa.array(hash_.astype(np.int64)), pa.array(place - start[of[place]], pa.int32()), _arrays(near)], ["hash", "at", "near"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(np.searchsorted(place, start), pa.int32()), prints)], ["doc_id", "n_words", "prints"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, SCANNED)


def _same(first: int) -> Column:
    """How many words from ``first`` on are the same around both fingerprints, up to SIDE."""
    out = F.lit(0)
    for i in range(first + SIDE - 1, first - 1, -1):
        out = F.when(F.col("print.near")[i] == F.col("near")[i], out + 1).otherwise(F.lit(0))
    return out


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of each document: the words inside windows of items, the spans
    (begin, end) found, sorted and not joined, and the items' ids as sorted strings."""
    spark = docs.sparkSession
    prints = written(item_fingerprints(items, item_id, item_text), "decontaminate-items")
    sizes = sorted(r["k"] for r in prints.where(F.col("k") == F.col("need")).select("k").distinct().collect())  # nine at most
    scanned = written(scan(docs, spark.sparkContext.broadcast(bloom(prints)), sizes, doc_id, text).withColumn("row", F.monotonically_increasing_id()),
                      "decontaminate-scanned")
    met = scanned.select("row", F.explode("prints").alias("print")).join(broadcast_if_small(prints), F.col("print.hash") == F.col("hash"))
    met = met.select("row", "item", "k", "need", F.col("print.at").alias("at"), _same(0).alias("before"), _same(SIDE).alias("after"))
    spans = met.where("k + before + after >= need").select("row", "item", F.struct((F.col("at") - F.col("before")).alias("begin"), (F.col("at") + F.col("k") + F.col("after")).alias("end")).alias("span"))
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    union = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["begin"]))).alias("n")))["n"]
    found = by_row.select("row", "spans", "items", union.alias("n_hit"))
    none = F.array().cast
    return scanned.drop("prints").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none("array<struct<begin: int, end: int>>")).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"))
