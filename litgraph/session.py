"""Session settings and the helpers every job shares: cutting lineage, checked broadcast, numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only below so many rows and bytes, counted at run time (see ``broadcast_if_small``).
BROADCAST_MAX_ROWS = 50_000
BROADCAST_MAX_BYTES = 16_000_000
ESTIMATE_MAX = "256k"  # a side whose size is only estimated is broadcast by Spark up to here (see ``broadcast_by_measure``)


def build_session(app: str = "litgraph", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on. On a cluster the master, the memory and
    ``spark.checkpoint.dir`` come from spark-submit; only semantics are fixed here."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(
            "spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local master (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-litgraph-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so loops keep a short plan and a lost
    executor costs one read instead of the whole history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str = "frame") -> DataFrame:
    """``df`` as a table in the shared folder. Unlike a checkpoint it forgets the size estimates of the plan that made
    it, which a loop of joins would multiply in every round."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint a broadcast after counting at most ``max_rows + 1`` rows and their bytes; above either bound a sort-merge
    join is asked for, so that no side whose size is only estimated is sent around."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and held <= BROADCAST_MAX_BYTES else df.hint("merge")


def broadcast_by_measure(spark: SparkSession) -> None:
    """From here on Spark's own choice of broadcasts goes by sizes it has measured after a shuffle, up to the bound the
    session had for estimates. Estimates count compressed files and nothing that a projection makes longer (60 copies of
    the part table: 2.1 MiB for 1,200,000 rows of key and path), so of them only those below ESTIMATE_MAX count."""
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", bound)
        if not bound.startswith("-"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", ESTIMATE_MAX)


def global_row_number(df: DataFrame, order: list, name: str = "rn", start=None) -> DataFrame:
    """Row numbers over a global order without a single-task window: range-partition, number inside
    each range, add the sizes of the ranges before it. The ranges are materialised first, because
    their sampled boundaries must be the same in both reads."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)).cast("long")
    base = F.lit(0) if start is None else start
    return (ranged.withColumn(name, local).join(offsets, "_pid")
            .withColumn(name, F.col(name) + F.col("_off") + base).drop("_pid", "_off"))
