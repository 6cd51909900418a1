"""Review cards as keyed state over the stream of reviews.

A card's state is folded review by review and never needs the reviews again: numbers add up, and the last rating goes
by the time of review, so that a late review counts without becoming the last one. Each batch writes the states it
changed. Where the state store cannot be read any more, the whole log is replayed into a new generation, whose tables
replace the old ones' as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .feeds import _exists

STATE = "reviews bigint, lapses bigint, last_rating int, last_reviewed_at timestamp"
CARD = f"card_id string, {STATE}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CardFold(StatefulProcessor):
    """(reviews, lapses, last rating and its time) of each card."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("card", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        reviews, lapses, rating, at = self.state.get() if self.state.exists() else (0, 0, None, None)
        for part in rows:  # a card's reviews of a batch come in parts of bounded size
            reviews, lapses = reviews + len(part), lapses + int((part["rating"] == 1).sum())
            last = part.loc[part["reviewed_at"].idxmax()]
            seen = last["reviewed_at"].to_pydatetime()
            if at is None or seen > at:
                rating, at = int(last["rating"]), seen
        self.state.update((int(reviews), int(lapses), rating, at))
        yield pd.DataFrame({"card_id": [key[0]], "reviews": [reviews], "lapses": [lapses], "last_rating": [rating], "last_reviewed_at": [pd.Timestamp(at)]})

    def close(self) -> None:
        pass


def card_stream(reviews: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The stream reviews(card_id, rating, reviewed_at), drained; changed states of a batch are its partition."""
    spark = reviews.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    states = reviews.groupBy("card_id").transformWithStateInPandas(CardFold(), outputStructType=CARD, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _generation(spark: SparkSession, folder: str) -> int:
    n = 0
    while _exists(spark, f"{folder}/checkpoint-{n + 1}"):
        n += 1
    return n


def drain(reviews: DataFrame, folder: str) -> int:
    """Drains the stream into the newest generation of ``folder``; if its state cannot be read, into a new one that
    replays the log from its start. The generation's number."""
    n = _generation(reviews.sparkSession, folder)
    try:
        card_stream(reviews, f"{folder}/states-{n}", f"{folder}/checkpoint-{n}").awaitTermination()
    except StreamingQueryException as e:
        if "STATE_STORE" not in str(e).upper() and "ROCKSDB" not in str(e).upper():
            raise
        n += 1
        card_stream(reviews, f"{folder}/states-{n}", f"{folder}/checkpoint-{n}").awaitTermination()
    return n


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """Each card's latest state in the newest generation."""
    rows = spark.read.parquet(f"{folder}/states-{_generation(spark, folder)}")
    last = F.max_by(F.struct("reviews", "lapses", "last_rating", "last_reviewed_at"), "batch").alias("s")
    return rows.groupBy("card_id").agg(last).select("card_id", "s.*")
