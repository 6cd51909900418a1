"""What several operators share: whole-table readers, ASCII words, bounded slices of Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed: the white space that separates words in every contract of this package.
SPACES = " \t\n\x0b\f\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path for a written table in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and later readers prune columns."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.folder = path
    return back


def forget(*frames: DataFrame) -> None:
    """Deletes the folders of ``written`` frames that no plan reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Default place of a public tokenizer file; LLM_TOKENIZERS names another folder."""
    folder = os.environ.get("LLM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_pattern() -> str:
    """The pattern that splits a text before the merges of the public rank files."""
    import public_tokenizers
    return public_tokenizers.PATTERN


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes outside U+0020 and U+0009-U+000D."""
    return text.split()


def lowered_words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z only."""
    return text_bytes(text).translate(LOWER).split()


def slices(batch: pa.RecordBatch, column: str, max_chars: int = 3_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Consecutive slices of a batch with at most ``max_chars`` characters of ``column`` (one row at least)."""
    values = batch.column(column).to_pylist()
    start, size = 0, 0
    for i, v in enumerate(values):
        n = len(v) if v is not None else 0
        if i > start and size + n > max_chars:
            yield batch.slice(start, i - start), values[start:i]
            start, size = i, 0
        size += n
    if start < len(values):
        yield batch.slice(start), values[start:]


def crc_bucket(doc_id: Column, buckets: int = 5) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id falls into bucket 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets)), F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
