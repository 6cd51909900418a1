"""Nearest neighbours by inverted lists over k-means centroids.

``build`` fits the centroids on a bounded sample (``SAMPLE_BYTES``) and puts every row into the list of its nearest
centroid. ``nearest`` sends each probe to the few nearest lists, where it meets the rows in cells of bounded size and
keeps its best ones by their exact similarity. Its worst one so far (or the floor) then decides where else it goes:

* by default to so many lists, the most promising first, that all others together are expected to hold no more than the
  share ``MISSED`` of the ``k`` rows asked for, however many lists there are. The expectation comes from the residuals:
  rows lie around ``mean`` times the probe's similarity to the centroid, as far as what the centroid leaves of probe and
  rows allows;
* with ``exact`` to every list that can hold one, by the angle between probe and centroid and the list's radius.

So on clustered vectors a probe sees few lists, and on vectors without any structure as many as it must. Lists travel in
packs of a cell's size: a probe goes to a pack once, whatever the number of its lists there.

Rows of equal vectors are one class: they are compared once, whatever their number, and expanded at the end. So a group
of copies costs its size times ``k``, not its square. With ``cls`` and ``seq`` columns on both sides a probe only sees
earlier rows of its class, and rows are compared each.

Vectors are of unit length, or zero. A row is never its own neighbour. Ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ranking import top_per

LIST_ROWS = 1_000  # rows of a list that the number of lists aims at
SAMPLE_BYTES = 64_000_000  # of vectors that the centroids are fitted on, by one task
ROWS_PER_CENTROID = 8  # sampled rows for each centroid at least, so the number of lists is bounded as well
CELL = 20_000  # rows and probes of a cell at most, on average
CELL_ROWS = 2_000  # and from how many on a cell may be a sixteenth of all rows
CELL_BYTES = 16_000_000  # of vectors on one side of a cell
BLOCK = 2_000_000  # similarities held at once
ROUTED = 4_096  # routed probes that leave a task at once
PROBED = 4  # lists that each probe looks into first
MISSED = 0.1  # share of the rows asked for that may be expected in the lists a probe leaves out
ROUNDS = 12
SLACK = 2e-6  # similarities are rounded to six digits


def matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float32) for v in col]) if len(col) else np.zeros((0, 1), np.float32)


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, none of them null. They travel as Arrow: rows of arrays are slow to write from pandas."""
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(batch), -1)


@dataclass(frozen=True)
class VectorIndex:
    """rows(list, id, vec and cls, seq if given): every row of the corpus; a list's size, the greatest angle between its
    centroid and a row, and the mean similarity of its rows to it; the rows of a cell, and each list's pack."""
    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    mean: np.ndarray
    side: int
    pack: np.ndarray


def packed(sizes: np.ndarray, side: int) -> np.ndarray:
    """The pack of each list: neighbours by number, ``side`` rows or one list."""
    pack, held = np.zeros(len(sizes), np.int32), 0
    for i in range(1, len(sizes)):
        held += sizes[i - 1]
        new = held + sizes[i] > side
        pack[i], held = pack[i - 1] + new, 0 if new else held
    return pack


def centres(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Spherical k-means over the sampled vectors."""
    rng = np.random.default_rng(seed)
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(sample):
        return np.zeros((1, 1), np.float32)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS if len(c) > 1 else 0):
        near = np.concatenate([(sample[s:s + 8192] @ c.T).argmax(1) for s in range(0, len(sample), 8192)])
        order = np.argsort(near, kind="stable")
        first = np.searchsorted(near[order], np.arange(len(c)))
        full = np.flatnonzero(np.diff(np.append(first, len(sample))))
        sums = np.add.reduceat(sample[order], first[full])
        new = c.copy()
        new[full] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.array_equal(new, c):
            break
        c = new
    return c.astype(np.float32)


def build(corpus: DataFrame, sample_bytes: int = SAMPLE_BYTES, list_rows: int = LIST_ROWS) -> VectorIndex:
    """An index of corpus(id, vec) and cls, seq if given. The sample are rows of an id hash below a bound."""
    cols = ["id", "vec", *(c for c in ("cls", "seq") if c in corpus.columns)]
    corpus = corpus.select(*cols).filter("vec is not null")
    n, dim = corpus.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    most = max(1, sample_bytes // (4 * max(1, dim or 1)))
    lists = max(1, min(-(-n // list_rows), most // ROWS_PER_CENTROID))
    every = max(1, n // max(1, min(most, 64 * lists)))
    c = np.zeros((1, 1), np.float32)
    if lists > 1:
        def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The centroids of the whole sample, which one task gets."""
            parts = [vectors(b) for b in batches if len(b)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in centres(np.concatenate(parts), lists)], pa.binary())], ["centroid"])

        some = corpus.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(every)) == 0).select("vec").limit(most)
        found = some.withColumn("at", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("at").select("vec").mapInArrow(fitted, "centroid binary")
        rows = found.toArrow().column("centroid").to_pylist()
        c = np.stack([np.frombuffer(r, np.float32) for r in rows]) if rows else c
    shared = corpus.sparkSession.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            if len(b):
                if len(c) == 1:
                    near, sim = np.zeros(len(b), np.int32), np.full(len(b), -1.0)
                else:
                    sims = vectors(b) @ c.T
                    near = sims.argmax(1).astype(np.int32)
                    sim = sims[np.arange(len(b)), near]
                angle = np.arccos(np.clip(sim.astype(np.float64), -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(angle)], [*b.schema.names, "list", "angle"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in corpus.schema.fields)
    rows = stored(corpus.mapInArrow(assign, f"{fields}, list int, angle double"), "index")
    sizes, radius, mean = np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(len(c))
    for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.avg(F.cos("angle")).alias("mean")).collect():  # a row a list at most
        sizes[r["list"]], radius[r["list"]], mean[r["list"]] = r["n"], r["angle"], r["mean"]
    side = max(1, min(CELL, max(CELL_ROWS, n // 16), CELL_BYTES // (4 * max(1, dim or 1))))
    return VectorIndex(rows.drop("angle"), c, sizes, radius, mean, side, packed(sizes, side))


def slack_of(rows: np.ndarray, longest: float) -> float:
    """By how much a product in single precision can miss the exact one, with vectors of length ``longest`` at most."""
    return 1e-6 + 1.2e-7 * rows.shape[1] * longest * float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


def worth(near: np.ndarray, fit: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, probe) of the pairs that ``fit`` and can be among the best ``k`` of a probe by their exact similarities.
    near(rows, probes) are those in single precision."""
    full = np.flatnonzero(fit.sum(0) > k)
    if len(full):
        some = np.where(fit[:, full], near[:, full], np.float32(-np.inf))
        fit[:, full] &= some >= np.partition(some, len(some) - k, axis=0)[len(some) - k] - np.float32(2 * slack)
    return np.nonzero(fit)


def exact_of(rows: np.ndarray, probes: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The exact similarities, six digits, of pairs of rows and probes."""
    if 8 * len(at) > len(rows) * len(probes):
        return np.round((rows.astype(np.float64) @ probes.astype(np.float64).T)[at, p], 6)
    parts = [np.einsum("ij,ij->i", rows[at[i:i + 4096]].astype(np.float64), probes[p[i:i + 4096]].astype(np.float64)) for i in range(0, len(at), 4096)]
    return np.round(np.concatenate([np.zeros(0), *parts]), 6)


def best_of(p: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each probe by similarity and then id, in no order. Only ids at the last place are compared."""
    by = np.lexsort((-s, p))
    p, ids, s = p[by], ids[by], s[by]
    last = np.searchsorted(p, p) + k - 1
    full = last < len(p)
    last[~full] = 0
    full &= p[last] == p
    above, tied = ~full | (s > s[last]), np.flatnonzero(full & (s == s[last]))
    if len(tied):
        room = k - np.bincount(p[above], minlength=p[-1] + 1)
        here = np.bincount(p[tied], minlength=p[-1] + 1)
        sure = tied[here[p[tied]] <= room[p[tied]]]
        tied = tied[here[p[tied]] > room[p[tied]]]
        tied = tied[np.lexsort((ids[tied], p[tied]))]
        tied = tied[np.arange(len(tied)) - np.searchsorted(p[tied], p[tied]) < room[p[tied]]]
        above[sure] = above[tied] = True
    return p[above], ids[above], s[above]


def best_of_block(probes: pd.DataFrame, rows: pd.DataFrame, k: int, floor: float, own: bool) -> pd.DataFrame:
    """The best ``k`` rows of one block for every probe, by similarity and then id; ``own``: a row may be its own
    neighbour. With ``lists`` a probe only meets rows of those, with ``least`` only rows at least as near. Similarities in
    single precision tell which pairs are worth an exact one."""
    pm, rm = matrix(probes["vec"]), matrix(rows["vec"])
    ids, pids = rows["id"].to_numpy(), probes["id"].to_numpy()
    least = np.maximum(floor, probes["least"].to_numpy()) if "least" in probes.columns else np.full(len(pids), floor)
    seq = (probes["seq"].to_numpy(), rows["seq"].to_numpy()) if "seq" in probes.columns else None
    meets = [(np.arange(len(pids)), np.arange(len(ids)))]
    if "lists" in probes.columns:
        meets = list(_by_list(probes["lists"], rows["list"].to_numpy(), ids))
    longest = float(np.sqrt(np.einsum("ij,ij->i", pm, pm).max(initial=0)))
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for at, of in meets:
        right, step = rm[of], max(1, BLOCK // max(1, len(of)))
        slack = slack_of(right, longest)
        for some in (at[lo:lo + step] for lo in range(0, len(at), step)):
            near = right @ pm[some].T
            fit = near >= (least[some] - slack).astype(np.float32)
            if not own:
                fit &= ids[of, None] != pids[some]
            if seq:
                fit &= seq[1][of, None] < seq[0][some]
            r, p = worth(near, fit, k, slack)
            s = exact_of(right, pm[some], r, p)
            stay = s >= least[some[p]]
            found.append((some[p[stay]], of[r[stay]], s[stay]))
    p, r, s = (np.concatenate(c) for c in zip(*found))
    p, r, s = _by_id(p, r, s, ids, k)
    return pd.DataFrame({"probe": pids[p], "id": ids[r], "sim": s})


def _by_id(p: np.ndarray, r: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_of`` rows, whose ids are put in order once."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    p, place, s = best_of(p, place[r], s, k)
    return p, order[place], s


def _by_list(lists: pd.Series, of: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The probes that look into each list, and its rows by id."""
    asked = np.concatenate([np.asarray(x, np.int64) for x in lists])
    who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    by, order = np.argsort(asked, kind="stable"), np.lexsort((ids, of))
    names, start = np.unique(asked[by], return_index=True)
    for name, at in zip(names, np.split(who[by], start[1:])):
        lo, hi = np.searchsorted(of[order], [name, name + 1])
        if hi > lo:
            yield at, order[lo:hi]


def _tail(x: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above ``x``: a logistic form, right to 0.0002."""
    return 1 / (1 + np.exp(np.clip(1.5976 * x + 0.07056 * x ** 3, -500, 500)))


def _routed(index: VectorIndex, probes: DataFrame, lists: int, k: int, further: str | None = None) -> DataFrame:
    """A row of each probe for every pack with lists it goes to: the ``lists`` nearest ones, or of all others those that
    can hold (``further`` is 'exact') or are expected to hold ('expected') rows of the similarity in the probe's ``least``."""
    shared = probes.sparkSession.sparkContext.broadcast((index.centroids, index.radius, index.mean, index.sizes, index.pack))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, radius, mean, sizes, pack = shared.value
        number = np.flatnonzero(sizes).astype(np.int32)
        step = max(1, BLOCK // max(1, len(number)))
        for b in (b for b in batches if len(b)):
            every = vectors(b)
            for lo in range(0, len(b), step):
                v = every[lo:lo + step]
                sims = (v @ c[number].T if len(c) > 1 else np.ones((len(v), len(number)))).astype(np.float64)
                near = np.argsort(-sims, axis=1, kind="stable")[:, :min(lists, len(number))]
                chosen = np.zeros(sims.shape, bool)
                np.put_along_axis(chosen, near, True, 1)
                if further:
                    least = b.column("least").to_numpy(zero_copy_only=False)[lo:lo + step, None]
                    if further == "exact":
                        angle = np.arccos(np.clip(sims, -1, 1))
                        open_ = np.cos(np.maximum(0.0, angle - radius[number] - 1e-3)) + SLACK >= least
                    else:
                        m = np.clip(mean[number], -1, 1)
                        wide = np.sqrt(np.maximum(1e-9, (1 - np.clip(sims, -1, 1) ** 2) * (1 - m ** 2) / max(1, v.shape[1] - 1)))
                        better = np.where(chosen, 0.0, sizes[number] * _tail((least - sims * m) / wide))
                        order = np.argsort(better, axis=1, kind="stable")
                        open_ = np.zeros(sims.shape, bool)
                        np.put_along_axis(open_, order, np.cumsum(np.take_along_axis(better, order, 1), 1) > MISSED * k, 1)
                    chosen = ~chosen & open_
                p, at = np.nonzero(chosen)
                new = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(pack[number[at]], prepend=-1) != 0))
                ends = np.append(new, len(p))
                for first in range(0, len(new), ROUTED):
                    start, end = ends[first], ends[min(first + ROUTED, len(new))]
                    some = new[first:first + ROUTED]
                    asked = pa.ListArray.from_arrays(pa.array(np.append(some, end).astype(np.int32) - np.int32(start)), pa.array(number[at[start:end]]))
                    rows = b.take(pa.array(lo + p[some]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pack[number[at[some]]]), asked], [*b.schema.names, "pack", "lists"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in probes.schema.fields)
    return probes.mapInArrow(run, f"{fields}, pack int, lists array<int>")


def _met(index: VectorIndex, routed: DataFrame, k: int, floor: float, own: bool) -> DataFrame:
    """Hits of routed probes in cells: a pack's rows are dealt to parts, its probes to turns, each of the index's side."""
    spark = routed.sparkSession
    keys = ["pack", "part", "turn"] + (["cls"] if "cls" in routed.columns else [])
    routed = stored(routed, "routed")
    asked = {r["pack"]: r["n"] for r in routed.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pack at most
    held = np.bincount(index.pack, index.sizes)
    plan = spark.createDataFrame([(i, int(-(-held[i] // index.side)), -(-n // index.side)) for i, n in asked.items()], "pack int, parts int, turns int")
    of = spark.createDataFrame([(i, int(p)) for i, p in enumerate(index.pack)], "list int, pack int")
    rows = (index.rows.join(F.broadcast(of.join(plan, "pack")), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
            .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("parts", "turns"))
    probes = (routed.join(F.broadcast(plan), "pack").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(2)), F.col("turns")).cast("int"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "turns"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"probe": left["id"], "id": right["id"], "sim": pd.Series(dtype=float)}).iloc[:0]
        return best_of_block(left, right, k, floor, own)

    types = (routed.schema["id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString())
    return probes.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(cell, "probe {0}, id {1}, sim double".format(*types))


def search(index: VectorIndex, probes: DataFrame, k: int, floor: float = -2.0, lists: int = PROBED, exact: bool = False, own: bool = False) -> DataFrame:
    """(probe, id, sim, rank): the best ``k`` rows of the index for each of probes(id, vec) and cls, seq if given."""
    cols = ["id", "vec", *(c for c in ("cls", "seq") if c in probes.columns)]
    probes = probes.select(*cols).filter("vec is not null")
    best = [F.desc("sim"), F.col("id")]
    hits = top_per(_met(index, _routed(index, probes, lists, k), k, floor, own), ["probe"], best, k, rank="rank")
    if int((index.sizes > 0).sum()) <= lists:
        return hits
    hits = stored(hits, "hits")
    worst = hits.groupBy(F.col("probe").alias("id")).agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("found"))
    open_ = probes.join(worst, "id", "left").withColumn("least", F.when(F.col("found") >= k, F.col("worst")).otherwise(F.lit(floor)))
    more = _met(index, _routed(index, open_.drop("worst", "found"), lists, k, "exact" if exact else "expected"), k, floor, own)
    return top_per(hits.drop("rank").unionByName(more), ["probe"], best, k, rank="rank")


def asked_once(probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, vec, h1, h2) of every probe, (h1, h2, id, vec) of each different vector, by the smallest id of its probes)."""
    every = stored(probes.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2")).filter("vec is not null"), "vectors")
    return every, stored(every.groupBy("h1", "h2").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("id")), "asked")


def of_classes(every: DataFrame, classes: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(probe, id, sim, rank) of every probe from the ``found`` (probe, id, sim) of its class: the best k + 1 of a class
    hold the best k of each of its probes, who leave out themselves only."""
    of = every.select(F.col("id").alias("probe"), "h1", "h2").join(classes.select("h1", "h2", F.col("id").alias("class")), ["h1", "h2"]).select("probe", "class")
    hits = of.join(found.select(F.col("probe").alias("class"), "id", "sim"), "class").filter(F.col("probe") != F.col("id")).select("probe", "id", "sim")
    return top_per(hits, ["probe"], [F.desc("sim"), F.col("id")], k, rank="rank")


def nearest(corpus: DataFrame, probes: DataFrame, k: int, floor: float = -2.0, lists: int = PROBED, exact: bool = False, list_rows: int = LIST_ROWS,
            asked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(probe, id, sim, rank): ``search`` over an index of corpus(id, vec), equal vectors compared once. With cls and seq
    columns on both sides only earlier rows of a probe's class are its neighbours. ``asked`` is what ``asked_once`` gives for
    the probes, if it is known."""
    if "seq" in probes.columns:
        return search(build(corpus, list_rows=list_rows), probes, k, floor, lists, exact)
    rows = stored(corpus.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2")).filter("vec is not null"), "vectors")
    # the ids of a class that can be among the best k besides the probe itself, and the class named by the smallest
    ids = top_per(rows.select("h1", "h2", "id"), ["h1", "h2"], [F.col("id")], k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    named = stored(ids.join(rows.groupBy("h1", "h2").agg(F.min_by("vec", "id").alias("vec")), ["h1", "h2"]).select(F.element_at("ids", 1).alias("id"), "ids", "vec"), "classes")
    every, classes = asked or asked_once(probes)
    found = search(build(named.select("id", "vec"), list_rows=list_rows), classes.select("id", "vec"), k + 1, floor, lists, exact, own=True)
    found = found.join(named.select("id", "ids"), "id").select("probe", "sim", F.explode("ids").alias("id"))
    return of_classes(every, classes, top_per(found, ["probe"], [F.desc("sim"), F.col("id")], k + 1), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(probes, wanted, found, recall): the share of the true neighbours (probe, id) that were found."""
    met = truth.select("probe", "id").join(found.select("probe", "id", F.lit(1).alias("hit")), ["probe", "id"], "left")
    return met.agg(F.count_distinct("probe").alias("probes"), F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"),
                   F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("recall"))
