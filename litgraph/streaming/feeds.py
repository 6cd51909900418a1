"""Streams: the inbox of documents, the log of views, review history. Each sink is idempotent per batch,
so a restarted query repeats no work and loses none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollups import view_log
from ..sources import documents as docs

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def inbox(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files as rows. Writers rename finished files into the folder."""
    return (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files).load(folder))


TABLES = ("documents", "quarantine", "objects")


def ingest_batch(out: str, watch: Callable[[int, str], None] | None = None):
    """A ``foreachBatch`` step: valid documents, problems and known contents go to three tables, and a row of the ledger
    last. A batch counts from that row on; one that failed before it is repeated and overwrites its own partitions, and
    readers (``ingested``) do not see what it left. ``watch`` is called with batch and table before each write."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = docs.candidates(batch).withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
        if _exists(spark, f"{out}/ledger"):
            known = ingested(spark, out, "objects").filter(F.col("batch") != batch_id).select("sha256")
            fresh = fresh.join(known, "sha256", "left_anti")
        loaded = docs.load(fresh.select("path", "content"))

        def write(df: DataFrame, name: str) -> None:
            if watch:
                watch(batch_id, name)
            df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")

        for name, df in zip(TABLES, (loaded.good, loaded.problems, loaded.parsed.select("sha256", "path")), strict=True):
            write(df, name)
        write(loaded.parsed.agg(F.count("*").alias("files")), "ledger")
    return run


def ingested(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table as far as its batches are complete."""
    done = spark.read.parquet(f"{out}/ledger").select("batch")
    return spark.read.parquet(f"{out}/{name}").join(F.broadcast(done), "batch", "left_semi")  # a row a batch


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, max_files: int = 1000, source: DataFrame | None = None,
                  watch: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """The inbox (or a ``source`` of path and content) drained into the tables of ``out``."""
    rows = inbox(spark, folder, max_files) if source is None else source
    return rows.writeStream.foreachBatch(ingest_batch(out, watch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view_counts(views: DataFrame) -> DataFrame:
    """Running (entity_key, last_seen_at, count); maxima and sums make late rows harmless."""
    return view_log(views)


def view_stream(views: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch writes its own partial counts; ``stored_views`` folds them. Repeating a batch rewrites
    its partition, so nothing is counted twice."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        (view_log(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(out))
    return views.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_views(spark: SparkSession, out: str) -> DataFrame:
    s = spark.read.parquet(out)
    return s.groupBy("entity_key").agg(F.max("last_seen_at").alias("last_seen_at"), F.sum("count").alias("count"))


def windowed(events: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "7 days") -> DataFrame:
    """Sliding counts; rows later than ``late`` no longer change a closed window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("n"))


def review_days(events: DataFrame, hour: int = 4, late: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day", "1 day", f"{hour} hours")).agg(F.count("*").alias("n"))


def card_states(log: DataFrame) -> DataFrame:
    """(card_id, reviews, lapses, last_rating, last_days): each card's state from its whole review log, by
    aggregates that combine on the map side. log(card_id, rating, reviewed_at)."""
    return log.groupBy("card_id").agg(
        F.count("*").alias("reviews"), F.count_if(F.col("rating") == 1).alias("lapses"), F.max_by("rating", "reviewed_at").alias("last_rating"),
        F.max("reviewed_at").alias("last_reviewed_at"))


def since_last_run(rows: DataFrame, params: DataFrame, name: str) -> DataFrame:
    """Rows created after the stored watermark; everything when there is none. params(name, at)."""
    at = params.filter(F.col("name") == name).agg(F.max("at")).scalar()
    return rows.filter(F.col("created_at") >= F.coalesce(at, F.lit("1970-01-01").cast("timestamp")))
