"""Durable keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERATED_ORIGINS = ("template", "local_llm")


def sha_hex(c: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def free_key(etype: Column, normed: Column) -> Column:
    hashed = etype.isin("idea", "claim") | (F.length(normed) > 120)
    return F.concat(etype, F.lit(":"), F.when(hashed, sha_hex(normed, 20)).otherwise(normed))


def work_key(metadata_id: Column, doi: Column, title_norm: Column) -> Column:
    return F.coalesce(F.concat(F.lit("work:openalex:"), metadata_id), F.concat(F.lit("work:doi:"), doi),
                      F.concat(F.lit("work:title:"), sha_hex(title_norm, 20)))


def card_id(entity_key: Column, question: Column, origin: Column) -> Column:
    """Generated cards share one slot per entity; written cards are identified by their question."""
    tail = F.when(origin.isin(*GENERATED_ORIGINS), F.lit("generated")).otherwise(question)
    return sha_hex(F.concat(entity_key, F.lit("\n"), tail), 32)


def pair_key(kind: Column, a: Column, b: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.least(a, b), F.lit("|"), F.greatest(a, b))
