"""A corpus from raw documents to packed training sequences: quality, toxicity, near-duplicates, packing.

Every stage works on all rows that the one before it kept, and returns them with all their columns, whatever their names
(the last one returns pieces). Cases: null and empty texts fail the base rules and go; very long texts pass whole;
repeated rows are judged each and are one group of near-duplicates, of which one row stays; of rows of several ids that
of the smallest stays, a row without an id only where no other is; ties in labels count as toxic. An empty table gives
no pieces, one without labels loses nothing to toxicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.llm import minhash, packing, quality, toxicity
from litgraph.llm.common import crc_bucket, local_tokenizer, table, written


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its text, so that no column of it can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the rule table keep."""
    return quality.keep(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic, learned from the labelled ones among them outside the held-out fifth."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), crc_bucket(F.col("doc_id")) != 0)
    return toxicity.score(_rows(docs), model).where("predicted = 0").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8."""
    return minhash.keep_first(docs, size=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens, with the digests of their ids."""
    pieces = packing.with_crc(packing.pack(docs, local_tokenizer(), seq_len=2048, end_id=1))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("near-duplicates", near_duplicates), ("packing", packed)]

# A learned stage has no SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each result written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
