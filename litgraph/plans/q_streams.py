"""Registered streaming queries: a stream over the events table, drained and read back."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import star
from ..streaming import cards as cd
from ..streaming import feeds
from .q_sources import BAD
from .registry import register

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _folder(t) -> str:
    """A new folder under the session's shared checkpoint folder, so every executor sees it."""
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def stream(t):
    return t.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.path)


@register("t04_view_stream", """SELECT 'asset:'||user_id AS entity_key, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_seen, count(*)::BIGINT AS count FROM events GROUP BY 1""")
def _(t):
    f = _folder(t)
    views = stream(t).selectExpr("concat('asset:', user_id) entity_key", "ts")
    feeds.view_stream(views, f"{f}/views", f"{f}/cp").awaitTermination()
    return feeds.stored_views(t.spark, f"{f}/views").select("entity_key", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "count")


@register("t05_incremental_watermark", "SELECT event_id FROM events WHERE ts>=TIMESTAMP '2024-01-20'")
def _(t):
    params = t.spark.range(1).selectExpr("'last_synthesis' name", "timestamp '2024-01-20 00:00:00' at")
    return feeds.since_last_run(t.events.withColumn("created_at", F.col("ts")), params, "last_synthesis").select("event_id")


@register("t08_card_states", """SELECT 'card:'||user_id AS card_id, count(*) AS reviews, count(*) FILTER (1+event_id%4=1) AS lapses, max_by(1+event_id%4, ts) AS last_rating FROM events GROUP BY 1""")
def _(t):
    """The reviews come in three batches that are not in the order of time; the state lives in the stream."""
    f, log = _folder(t), "card_id string, rating int, reviewed_at timestamp"
    t.events.selectExpr("concat('card:', user_id) card_id", "cast(1 + event_id % 4 as int) rating", "cast(ts as timestamp) reviewed_at", "event_id").repartition(
        3, F.col("event_id")).drop("event_id").write.parquet(f"{f}/log")
    cd.drain(t.spark.readStream.schema(log).option("maxFilesPerTrigger", 1).parquet(f"{f}/log"), f)
    return cd.cards(t.spark, f).select("card_id", "reviews", "lapses", "last_rating")


@register("t10_restart_recovery", f"""SELECT 'documents' AS what, count(*) AS rows, count(DISTINCT p_partkey) AS files FROM part WHERE NOT {BAD}
    UNION ALL SELECT 'quarantine', count(*), count(*) FROM part WHERE {BAD} AND p_size%10<>5 UNION ALL SELECT 'objects', count(*), count(*) FROM part
    UNION ALL SELECT 'batches', 2, 2""")
def _(t):
    """The documents in two triggers: the second fails once between its tables, is taken up again after a restart, and
    a later delivery of all files changes nothing."""
    f = _folder(t)
    files = star.documents(t).select("path", "content")
    files.repartition(2, "path").write.parquet(f"{f}/inbox")
    left = ["quarantine"]

    def watch(batch: int, table: str) -> None:
        if batch == 1 and table in left:
            left.remove(table)
            raise RuntimeError("stopped between two tables")

    def run() -> None:
        source = t.spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 1).parquet(f"{f}/inbox")
        feeds.ingest_stream(t.spark, "", f"{f}/out", f"{f}/cp", source=source, watch=watch).awaitTermination()

    try:
        run()
    except StreamingQueryException:
        run()
    read = lambda name: feeds.ingested(t.spark, f"{f}/out", name)
    done = t.spark.read.parquet(f"{f}/out/ledger").agg(F.lit("batches").alias("what"), F.count("*").alias("rows"), F.count_distinct("batch").alias("files"))
    parts = [(n, "path" if n != "objects" else "sha256") for n in feeds.TABLES]
    drift = read("quarantine").filter(~F.col("where").rlike("^assets[.]ideas[.]"))  # a flattened transfer is several problems
    tables = {"documents": read("documents"), "quarantine": drift, "objects": read("objects")}
    for name, key in parts:
        done = done.unionByName(tables[name].agg(F.lit(name).alias("what"), F.count("*").alias("rows"), F.count_distinct(key).alias("files")))
    return done


@register("t09_late_data", """WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT DISTINCT day - to_days(k) AS start FROM d, generate_series(0, 6) g(k)), m AS (SELECT max(ts) AS last FROM events)
    SELECT strftime(start, '%Y-%m-%d') AS start, sum(d.n)::BIGINT AS n FROM s, m, d
    WHERE d.day >= start AND d.day < start + INTERVAL 7 DAY AND start + INTERVAL 7 DAY <= last - INTERVAL 1 DAY GROUP BY 1""")
def _(t):
    """Closed seven-day windows of the event stream, in append mode behind a watermark."""
    f = _folder(t)
    q = (feeds.windowed(stream(t), late="1 day").select("window.start", "n").writeStream.outputMode("append").format("parquet")
         .option("path", f"{f}/out").option("checkpointLocation", f"{f}/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.parquet(f"{f}/out").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")
