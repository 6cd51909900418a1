"""Feature hashing of words and trigrams as columns: sparse rows, dense vectors, or a plugged-in model's vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

DIM = 1024
WORD_WEIGHT, GRAM_WEIGHT = 1.0, 0.5
WORDS = re.compile(f"[a-z0-9]+|[{tx.HAN}]")
ROWS = 1_000  # texts whose vectors are summed at once
KNOWN = 500_000  # features whose places a task keeps


def features(normed: Column, dim: int = DIM) -> Column:
    """Signed hashed features of a normalised text: array of (bucket, value), one for each word and trigram."""
    def placed(prefix: str, weight: float) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            h = F.md5(F.concat(F.lit(prefix), x))
            bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int")
            return F.struct(bucket.alias("bucket"), F.when(F.substring(h, 9, 1) >= "8", weight).otherwise(-weight).alias("value"))
        return one

    return F.concat(F.transform(tx.tokens(normed), placed("w:", WORD_WEIGHT)), F.transform(tx.char_ngrams(normed), placed("c:", GRAM_WEIGHT)))


def hash_features(df: DataFrame, key: str, normed: Column, dim: int = DIM) -> DataFrame:
    """(key, bucket, weight): unit-length sparse vectors. Features are counted per bucket before the
    shuffle, so at most ``dim`` rows per text leave a task."""
    feats = df.select(key, normed.alias("_n")).select(key, F.explode(features(F.col("_n"), dim)).alias("x"))
    sums = feats.groupBy(key, F.col("x.bucket").cast("long").alias("bucket")).agg(F.sum("x.value").alias("v")).filter("v != 0")
    length = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_l"))
    return sums.join(length, key).select(key, "bucket", (F.col("v") / F.col("_l")).alias("weight"))


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A vector column from any model: ``load`` runs once per worker and returns
    ``texts -> (n, dim)`` unit rows."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(list(np.asarray(model(s.fillna("").tolist()), dtype=np.float32)))
    return embed


def _placed(name: str, dim: int) -> tuple[int, float]:
    """Bucket and signed weight of a feature, as ``features`` gives them."""
    digest = hashlib.md5(name.encode("utf-8", "replace")).digest()
    weight = WORD_WEIGHT if name[0] == "w" else GRAM_WEIGHT
    return int.from_bytes(digest[:4], "big") % dim, weight if digest[4] >= 0x80 else -weight


def hash_vectors(texts: list[str], known: dict[str, tuple[int, float]], dim: int = DIM) -> np.ndarray:
    """Unit vectors of a few normalised texts; ``known`` keeps the places of features met before, ``KNOWN`` at most."""
    sizes, placed = [], []
    for text in texts:
        padded = f" {text} "
        names = ["w:" + w for w in WORDS.findall(text)]
        names += ["c:" + padded[i:i + 3] for i in range(max(1, len(padded) - 2))]
        for name in names:
            at = known.get(name)
            if at is None:
                if len(known) >= KNOWN:
                    known.clear()
                at = known[name] = _placed(name, dim)
            placed.append(at)
        sizes.append(len(names))
    both = np.array(placed, np.float64).reshape(-1, 2)
    row = np.repeat(np.arange(len(texts)), sizes)
    m = np.bincount(row * dim + both[:, 0].astype(np.int64), both[:, 1], len(texts) * dim).reshape(-1, dim)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return m.astype(np.float32)


def hash_embedder(dim: int = DIM) -> Callable[[Column], Column]:
    """Dense unit vectors of the same features. Normal forms may need Python, so the features of ``ROWS`` texts at a time
    are listed there; each different one is hashed once, and one sum puts all of them into their buckets."""
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, float]] = {}
        for normed in batches:
            texts = [t or "" for t in normed.to_pylist()]
            flat = [hash_vectors(texts[lo:lo + ROWS], known, dim).ravel() for lo in range(0, len(texts), ROWS)]
            values = np.concatenate(flat) if flat else np.empty(0, np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(values))

    return lambda text: dense(tx.norm(F.coalesce(text, F.lit(""))))
