"""Sharding by sampled splitters, with DataFrame functions only.

Rows have a key, a tie-breaker and a size. A sample in which a row's chance grows with its size gives quantile
splitters of (key, tie); a binary search over them puts each row into a range. A key that holds more than one quantile
is heavy: its range is subdivided by the tie-breaker, so that no range is much over its share, whatever the key. Exact
byte totals of the ranges, and running sums inside each, then give every row's place in the order of (key, tie); the
byte line is cut into equal shards at these places.

Rows of one key stay together if they are at most ``1 / whole_keys`` of a shard; larger groups are cut where the
shard ends. Shard sizes differ by half such a group and half a row at each end at most.

Only the sample (``OVERSAMPLE`` rows a range) and one row for each range and shard reach the driver: with
``ROWS_PER_RANGE`` both grow with the rows a few hundred thousand times slower than the table.

Cases: a null size counts as 0, null keys and ties come first. Rows equal in key and tie are interchangeable. An
empty table gives no rows. Columns named like an output are replaced.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROWS_PER_RANGE = 250_000
RANGES_PER_SHARD = 8
OVERSAMPLE = 32
LOWEST = -(1 << 63)


def splitters(sample: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Boundaries of ``ranges`` equal weights over a sample of (key, tie, weight): the first of a range each. A key
    that holds one boundary only is not cut: the boundary moves to its start."""
    rows = sorted(sample)
    total, found, acc = sum(w for *_, w in rows), [], 0.0
    for key, tie, weight in rows:
        if rows and acc >= total * (len(found) + 1) / ranges and len(found) < ranges - 1:
            found.append((key, tie))
            while acc >= total * (len(found) + 1) / ranges and len(found) < ranges - 1:
                found.append((key, tie))
        acc += weight
    held: dict[int, int] = {}
    for key, _ in dict.fromkeys(found):
        held[key] = held.get(key, 0) + 1
    out = {(key, tie if held[key] > 1 else LOWEST) for key, tie in found} | {(key, LOWEST) for key, n in held.items() if n > 1}
    return sorted(out)


def _longs(values: list[int]) -> Column:
    """A constant array, folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(key: Column, tie: Column, cuts: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or before (key, tie), by binary search."""
    if not cuts:
        return F.lit(0)
    keys, ties, n = _longs([k for k, _ in cuts]), _longs([t for _, t in cuts]), len(cuts)
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])

    def step(acc: Column, s: Column) -> Column:
        at = F.least(acc + s, F.lit(n))
        k, t = F.element_at(keys, at), F.element_at(ties, at)
        return F.when((acc + s <= n) & ((k < key) | ((k == key) & (t <= tie))), acc + s).otherwise(acc)

    return F.aggregate(steps, F.lit(0), step)


def shard(df: DataFrame, key: str, tie: str, size: str, n_shards: int = 24, whole_keys: int = 100) -> DataFrame:
    """``df`` with shard (0 to n_shards - 1) and slot (0 on, in the order of key and tie inside the shard)."""
    lowest = F.lit(LOWEST)
    keyed = written(df.drop("shard", "slot").withColumns({
        "_key": F.coalesce(F.col(key), lowest), "_tie": F.coalesce(F.col(tie), lowest), "_size": F.coalesce(F.col(size), F.lit(0)).cast("long")}), "shard-keys")
    rows, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    total = max(1, total)
    ranges = max(RANGES_PER_SHARD * n_shards, rows // ROWS_PER_RANGE)
    wanted = ranges * OVERSAMPLE
    chance = F.pmod(F.xxhash64("_tie", "_key", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = keyed.where(chance < F.col("_size") * F.lit(wanted / total)).select(
        "_key", "_tie", F.greatest(F.col("_size").cast("double"), F.lit(total / wanted))).collect()
    cuts = splitters([tuple(r) for r in sample], ranges)
    ranged = keyed.withColumn("_range", range_of(F.col("_key"), F.col("_tie"), cuts))

    sums = {r["_range"]: (r["n"], r["b"]) for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).collect()}
    each = [sums.get(r, (0, 0)) for r in range(len(cuts) + 1)]
    before = _longs(list(accumulate((n for n, _ in each), initial=0))), _longs(list(accumulate((b for _, b in each), initial=0)))
    in_range = Window.partitionBy("_range").orderBy("_key", "_tie")
    of_key = Window.partitionBy("_range", "_key")
    start = F.sum("_size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    placed = (ranged.withColumn("_row", F.element_at(before[0], F.col("_range") + 1) + F.row_number().over(in_range) - 1)
              .withColumn("_start", start)
              .withColumn("_group", F.sum("_size").over(of_key)).withColumn("_group_start", F.min("_start").over(of_key)))
    together = F.col("_group") * (n_shards * whole_keys) <= total
    middle = 2 * F.element_at(before[1], F.col("_range") + 1) + F.when(together, 2 * F.col("_group_start") + F.col("_group")).otherwise(
        2 * F.col("_start") + F.col("_size"))
    done = written(placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(2 * total))).cast("int"))
                   .drop("_key", "_tie", "_size", "_range", "_start", "_group", "_group_start"), "shard-rows")
    counts = {r["shard"]: r["n"] for r in done.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = _longs(list(accumulate((counts.get(s, 0) for s in range(n_shards)), initial=0)))
    return done.withColumn("slot", F.col("_row") - F.element_at(first, F.col("shard") + 1)).drop("_row")
