"""The batch jobs: a rebuild of every derived table, published by a pointer, and the nightly round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Library
from ..operators import corrections as co
from ..operators import replay
from ..operators import retrieval as rt
from ..operators import rollups as ru
from ..operators.graph import communities
from ..operators.resolution import Thresholds
from ..session import cut
from . import ingest


class PreflightError(ValueError):
    """Stored rows that cannot be read; nothing was written."""


def preflight(unreadable: DataFrame) -> None:
    """unreadable(id, reason), from ``sources.documents.stored``."""
    first = unreadable.orderBy("id").limit(20).collect()
    if first:
        raise PreflightError("; ".join(f"{r['id']}: {r['reason']}" for r in first))


def rebuild(extractions: DataFrame, unreadable: DataFrame, decisions: DataFrame, references: DataFrame | None = None,
            old_ids: DataFrame | None = None, th: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """Every derived table as a function of documents and decisions. extractions(eid, doc, tier, created_at,
    is_current), references(id, referenced_works) with works(metadata_id) in the documents' ids."""
    preflight(unreadable)
    live = co.current(extractions.withColumnRenamed("eid", "id"), decisions).filter("is_current").withColumnRenamed("id", "eid")
    apart = co.distinct_pairs(decisions)
    g = ingest.materialize(live, apart=apart, th=th)
    lib = Library(entity=g.entity, edge=g.edge.drop("attrs", "records").join(live.select(F.col("eid").alias("extraction_id"), "created_at"), "extraction_id", "left"),
                  alias=g.alias, work=g.work)
    lib, skipped = replay.apply_all(lib, decisions)
    entity = cut(ru.promote(lib, th.topic_promote_works))
    old = old_ids if old_ids is not None else entity.limit(0).select("key", F.lit(0).cast("long").alias("id"))
    entity = entity.join(co.stable_ids(entity, old), "key")
    return {"entity": entity, "alias": lib.alias, "work": lib.work, "edge": lib.edge, "cards": g.cards, "queue": g.queue,
            "evidence": g.records, "skipped": skipped, "paper_of": g.paper_of}


def check_unique(tables: dict[str, DataFrame]) -> None:
    """Spark has no unique constraint; a version that breaks one is not published."""
    for name, cols in (("entity", ["key"]), ("edge", ["src", "dst", "type"]), ("alias", ["entity_key", "norm"])):
        if not tables[name].groupBy(*cols).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name} has more than one row per {', '.join(cols)}")


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write the next version beside the current one, check it, then move the one-row pointer."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
    check_unique({n: spark.read.parquet(f"{root}/v={version}/{n}") for n in tables})
    spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").json(f"{root}/current")


def current(spark: SparkSession, root: str) -> dict[str, str]:
    v = spark.read.json(f"{root}/current").first()["version"]
    return {n: f"{root}/v={v}/{n}" for n in ("entity", "alias", "work", "edge", "cards", "queue", "evidence", "skipped", "paper_of")}


def nightly(lib: Library, vectors: DataFrame, known: DataFrame, since: Column, th: Thresholds = Thresholds()) -> dict[str, DataFrame]:
    """Communities, promoted topics, and the pairs worth a look since the last run."""
    comm = cut(communities(lib))
    pairs = rt.synthesis_candidates(lib, vectors, comm, since, known, th.synthesis_sim)
    return {"communities": comm, "promoted": ru.promoted(lib, th.topic_promote_works), "synthesis": pairs}
