"""Ranked pages, caps and allocations. Per-group caps are row_number filters, which Spark cuts on the
map side first, so a hot group never reaches one task whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TOPIC_COLUMNS, Library
from ..session import cut
from . import rollups as ru
from .filters import not_rejected
from .graph import rank_in, topic_subtree


def top_per(df: DataFrame, partition: list[str], order: list[Column], n: int, offset: int = 0, rank: str = "rn") -> DataFrame:
    return (df.withColumn(rank, rank_in(partition, order)).filter(F.col(rank) <= offset + n).filter(F.col(rank) > offset))


def topic_page(lib: Library, root: str, per_column: int = 150, role: str | None = None, offset: int = 0) -> DataFrame:
    """(type, rn, key, name, roles, works, year, contested): everything under a topic subtree, each
    type in its own order, the first items of each column."""
    sub = topic_subtree(lib, lib.entity.filter(F.col("key") == root).select("key"))
    agg = ru.member_rollup(ru.members(lib, sub), role)
    e = not_rejected(lib.entity).filter(F.col("type").isin(*TOPIC_COLUMNS)).select("key", "type", "canonical_name")
    rows = (e.join(agg, "key").join(ru.contested(lib), "key", "left").fillna(False, ["contested"])
            .join(lib.work.select(F.col("entity_key").alias("key"), "year"), "key", "left"))
    is_claim, is_work = F.col("type") == "claim", F.col("type") == "work"
    order = [F.when(is_claim & F.col("contested"), 0).otherwise(1), F.when(is_work, -F.col("year")).otherwise(-F.col("works")),
             F.col("canonical_name"), F.col("key")]
    page = top_per(rows, ["type"], order, per_column, offset)
    return page.select("type", "rn", "key", F.col("canonical_name").alias("name"), "roles",
                       F.when(is_work & (F.col("works") == 0), 1).otherwise(F.col("works")).cast("long").alias("works"),
                       F.coalesce("year", F.lit(-1)).alias("year"), "contested")


def carried(rows: DataFrame, key: str, value: str, fan: int = 1000) -> DataFrame:
    """(key, before): the value of the row with the next smaller whole number ``key``, by a tree of buckets of ``fan`` keys:
    inside a bucket it is a lag, before its first row the last one of the nearest earlier bucket, found the same way. No
    window has more than ``fan`` rows."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    if lo is None or hi - lo < fan:
        return rows.select(key, F.lag(value).over(Window.orderBy(key)).alias("before"))
    b = rows.select(key, value, F.floor(F.col(key) / fan).alias("_g"))
    lasts = b.groupBy("_g").agg(F.max_by(value, key).alias("_last"))
    outer = carried(cut(lasts), "_g", "_last", fan).withColumnRenamed("before", "_outer")
    first = F.row_number().over(Window.partitionBy("_g").orderBy(key)) == 1
    inner = b.withColumn("_lag", F.lag(value).over(Window.partitionBy("_g").orderBy(key))).withColumn("_first", first)
    return inner.join(outer, "_g", "left").select(key, F.when(F.col("_first"), F.col("_outer")).otherwise(F.col("_lag")).alias("before"))


def without_repeats(log: DataFrame, order: str, values: list[str], bucket: int = 1000) -> DataFrame:
    """The log rows that differ from the row before them in the whole log. The order column is cut into buckets: inside
    one the previous row is a lag, across buckets it is the last row of the nearest earlier one, found in a tree."""
    b = log.withColumn("_b", F.floor(F.col(order) / bucket))
    val = F.struct(*values)
    lasts = cut(b.groupBy("_b").agg(F.max_by(val, order).alias("_last")))
    edge = carried(lasts, "_b", "_last", bucket).withColumnRenamed("before", "_before")
    inside = b.withColumn("_lag", F.lag(val).over(Window.partitionBy("_b").orderBy(order)))
    prev = inside.join(edge, "_b").withColumn("_prev", F.coalesce("_lag", "_before"))
    return prev.filter(F.col("_prev").isNull() | (F.col("_prev") != val)).drop("_b", "_lag", "_before", "_prev")


def capped_pairs(pairs: DataFrame, per_source: int, total: int) -> DataFrame:
    """Best pairs first, at most ``per_source`` per source and ``total`` overall; an unordered pair
    counts once, for the source it scored best with. pairs(src, other, score)."""
    unordered = pairs.withColumn("a", F.least("src", "other")).withColumn("b", F.greatest("src", "other"))
    best = unordered.groupBy("a", "b").agg(F.min(F.struct((-F.col("score")).alias("s"), "src", "other")).alias("m"))
    one = best.select(F.col("m.src").alias("src"), F.col("m.other").alias("other"), (-F.col("m.s")).alias("score"))
    kept = top_per(one, ["src"], [F.desc("score"), F.col("other")], per_source)
    return kept.orderBy(F.desc("score"), "src", "other").limit(total).select("src", "other", "score")


def page_unseen(items: DataFrame, seen: DataFrame, partition: list[str], order: list[Column], cap: int) -> tuple[DataFrame, DataFrame]:
    """(page, remaining): the best ``cap`` unseen items per group, and how many are left per group."""
    fresh = items.join(seen.select("dedupe_key"), "dedupe_key", "left_anti")
    page = top_per(fresh, partition, order, cap)
    n = fresh.groupBy(*partition).agg(F.count("*").alias("n"))
    return page, n.select(*partition, F.greatest(F.col("n") - cap, F.lit(0)).alias("remaining"))


def day_start(ts: Column, hour: int = 4) -> Column:
    """Start of the review day an instant belongs to."""
    shift = F.expr(f"interval {hour} hours")
    return F.date_trunc("day", ts - shift) + shift


def review_counts(log: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """One row: reviews and introductions since the review day began, and the cards waiting."""
    start = day_start(now)
    r = log.agg(F.count_if(F.col("reviewed_at") >= start).alias("n"))
    return cards.agg(F.count_if(F.col("introduced_at") >= start).alias("introduced"),
                     F.count_if(F.col("introduced_at").isNull() | (F.col("due") <= now)).alias("backlog")).select(
        r.scalar().alias("reviewed"), "introduced", "backlog")


def daily_allocation(alive: DataFrame, now: Column, limit: int, daily_max: int, daily_new: int, reviewed: int,
                     introduced: int) -> DataFrame:
    """The cards one session serves: due ones first by priority and date, then new ones as far as the
    caps of the day allow. Both lists are bounded by ``limit`` before they meet."""
    room = max(0, daily_max - reviewed)
    due = (alive.filter(F.col("introduced_at").isNotNull() & (F.col("due") <= now))
           .orderBy(F.desc("priority"), F.asc_nulls_last("due"), "id").limit(min(limit, room)))
    due = cut(due.select("id", "priority", F.lit(False).alias("new")))
    n = due.count()
    new_room = max(0, min(daily_new - introduced, room - n, limit - n))
    new = (alive.filter(F.col("introduced_at").isNull())
           .orderBy(F.desc("priority"), F.desc_nulls_last("created_at"), "id").limit(new_room))
    return due.unionByName(new.select("id", "priority", F.lit(True).alias("new")))


def capped_by_category(rows: DataFrame, category: str, order: list[Column], cap: int, budget: int) -> DataFrame:
    """At most ``cap`` per category and ``budget`` in all, in order."""
    kept = top_per(rows, [category], order, cap)
    return kept.orderBy(*order).limit(budget)


def surviving_cards(cards: DataFrame, logs: DataFrame) -> DataFrame:
    """One card per slot: the one reviewed most keeps its schedule. cards(slot, id, ...), logs(card_id)."""
    n = logs.groupBy(F.col("card_id").alias("id")).agg(F.count("*").alias("history"))
    c = cards.join(n, "id", "left").fillna(0, ["history"])
    return top_per(c, ["slot"], [F.desc("history"), F.col("id")], 1).drop("rn")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the exact total beside it."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total).withColumn(
        "has_more", F.lit(offset + limit) < F.col("total"))


def search_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with one extra, whether a next page exists): no total is counted."""
    more = df.orderBy(*order).offset(offset).limit(limit + 1)
    return more.limit(limit), more.agg((F.count("*") > limit).alias("has_more"))
