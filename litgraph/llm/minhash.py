"""Near-duplicate groups: universal hash minima, bands, exact confirmation, and components by alternating stars.

1. Each text becomes the set of its distinct word shingles; ``hashes`` universal hash functions give its minima.
2. Texts of equal sets form a class, and only its smallest id goes on; copies are never paired with each other.
3. Bands of ``rows`` minima put classes into buckets. With 40 bands of 5 rows a pair of similarity 0.8 shares none
   with a probability of 1.2e-7.
4. Bands are gone through in a few groups. In each bucket every class is compared with the bucket's smallest one, on
   full sets, unless the links so far have joined both: a large group of near copies costs about one text a member.
5. Buckets that are not of one component after that are searched for the links between their components: blocks of
   minima are compared inside tasks, and only pairs whose minima agree as a similar pair's do (five standard
   deviations), whose sketches and sizes allow the similarity, and that meet in this band first are confirmed on full sets. The best
   agreeing ones of each class and component go first; buckets in which any pair had to wait are searched again with
   more of them, until none had.
6. Components of the confirmed links by alternating large-star and small-star, until nothing changes.

No bucket, class or block has a cap; a bucket larger than a block is split over several, and joins by bucket deal the
rows of hot buckets over many keys. Nothing but counts reaches the driver. Tables that later steps share are written to
the checkpoint folder, those no longer read are deleted.

Cases: null and empty texts, and texts without a word, have an empty set and link with nothing. A text with fewer
words than a shingle has one shingle, its whole sequence. Rows that repeat an id are one node and are returned each;
equal ones cost one class, and a repeated id of several texts is linked by any of them. Rows without an id belong to the
group of a row of an equal set, else they have a null component and are kept. Ties do not arise: a group's id is its smallest. An empty table gives no rows. Other
columns are not returned. ``keep_first`` returns all columns as they are; there each row is a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small
from .common import forget, lowered_words, mix64, slices, written

BANDS, ROWS = 40, 5
GROUPS = ((0, 2), (2, BANDS))  # bands whose buckets are compared with their smallest class at once
BLOCK = 512  # classes of a bucket that meet another block in one task
HOT = 2048  # classes of a bucket, from which on joins by bucket deal its rows over several keys
FIRST_BEST = 64  # partners of a class in another component and block that go first
PAIRS = 40_000  # pairs whose minima are compared at once
BINS = 1024  # of the sketch that pairs must agree in as well
SMALL = 256  # shingles of a set that its sketch holds whole
HUB_ROWS = 32  # texts that share one copy of their hub's text
SIGMAS = 5.0


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = lowered_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(size, n)
    out = h[:n - size + 1]
    for j in range(1, size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j:n - size + 1 + j])
    return np.unique(out)


def families(hashes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the hash functions x -> a x + b modulo 2^32."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, hashes, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, hashes, np.uint32)


def minima(shingle: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, as 16 bits."""
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at:at + 1024, None] * a + b).min(0), out=least)
    return least.astype("<u2")


def sketch(shingle: np.ndarray) -> bytes:
    """Of a set of up to SMALL shingles all of them, 32 bits each (the first and last 16 of the hash, in its order); of
    a larger one its ``binned`` sketch."""
    if len(shingle) <= SMALL:
        return (shingle >> np.uint64(48) << np.uint64(16) | shingle & np.uint64(0xFFFF)).astype("<u4").tobytes()
    return binned(shingle >> np.uint64(64 - BINS.bit_length() + 1), shingle & np.uint64(0xFFFF)).tobytes()


def binned(bins: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One byte for each of BINS ranges of the hashes: of the least one in it, 255 where there is none."""
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1])[:len(bins)])
    out = np.full(BINS, 255, np.uint8)
    out[bins[first].astype(np.int64)] = low[first] % 255
    return out


def bins_of(held: bytes, n: int) -> np.ndarray:
    """The binned sketch of a set of ``n`` shingles."""
    if n > SMALL:
        return np.frombuffer(held, np.uint8)
    short = np.frombuffer(held, "<u4")
    return binned(short >> np.uint32(33 - BINS.bit_length()), short & np.uint32(0xFFFF))


def alike(one: np.ndarray, two: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches (rows) can be of sets of the similarity; ``n`` is the sum of the sets' sizes. Of sets that similar
    the bins are a sample of the union, drawn without putting back; it may be off by ``SIGMAS``."""
    held = (one != 255) | (two != 255)
    size = np.maximum(held.sum(1), 1)
    share = percent / 100
    drawn = np.minimum(1.0, size * (1 + share) / np.maximum(n, 1))
    off = SIGMAS * np.sqrt(share * (1 - share) / size * (1 - drawn)) + 1.5 / size
    return ((one == two) & held).sum(1) / size >= share - off


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
                       T.StructField("set_key", T.StringType()), T.StructField("sig", T.BinaryType()),
                       T.StructField("sketch", T.BinaryType())])


def signatures(docs: DataFrame, size: int, hashes: int = BANDS * ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, sketch): key, minima and sketch are null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = families(hashes)
        for batch in batches:
            for part, texts in slices(batch, text):
                sets = [shingles(t, size) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    part.column(doc_id), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                    pa.array([minima(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], SIGNED.names)

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, SIGNED)


def banded(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """``signed`` with a row for each band and the bucket that the class is in there."""
    wide = 2 * rows
    return (signed.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
            .withColumn("bucket", F.xxhash64("band", F.expr(f"substring(sig, band * {wide} + 1, {wide})"))))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. A hub's text goes once to every ``HUB_ROWS`` of its partners,
    which then stream past it."""
    fan = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / HUB_ROWS)).alias("part"))
    need = (dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("role"))
            .unionByName(dealt.select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("role")).distinct()))
    rows = (need.join(texts, "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", "role")
            .select("a", "part", "role", "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in batches:
            out = []
            for a, part, role, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, part) != at:
                    at, hubs = (a, part), []
                own = shingles(text, size)
                if role == 0:
                    hubs.append(own)
                    continue
                for hub in hubs:
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    if 100 * both >= percent * (len(hub) + len(own) - both):
                        out.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root being its component's smallest node, by alternating stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "minhash-edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    last = mark(edges)
    while last[0]:
        old = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "minhash-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, "minhash-small")
        now = mark(edges)
        forget(old, large)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))


def dealt(df: DataFrame, hot: DataFrame) -> DataFrame:
    """``df`` with a salt that spreads the rows of hot buckets (bucket, keys)."""
    return df.join(hot, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("keys", F.lit(1))).cast("int")).drop("keys")


def per_bucket(df: DataFrame, hot: DataFrame) -> DataFrame:
    """A row of each bucket, for every salt that ``dealt`` gives it."""
    keys = F.sequence(F.lit(0), F.coalesce("keys", F.lit(1)) - 1)
    return df.join(hot, "bucket", "left").withColumn("salt", F.explode(keys)).drop("keys")


def open_buckets(members: DataFrame) -> DataFrame:
    """(bucket, major, wide, tall) of the buckets of more than one component: the largest one, its blocks and those of
    the other classes."""
    sizes = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all")).where("all > most.n")
    return sizes.select("bucket", F.col("most.root").alias("major"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("wide"),
                        F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int").alias("tall"))


def cells(members: DataFrame) -> DataFrame:
    """Members (bucket, major, wide, tall, band, node, root, n_shingles, sig) in the cells of their bucket. The classes
    outside its largest component meet the blocks of that component, and each other; those inside it do not meet, so a
    large group of near copies with a few strays travels once."""
    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int")

    def every(n: str, cell) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), cell)

    def cell(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    # kind 0: the major component's block i (side 1) against block j of the others (side 0); kind 1: others among themselves
    inside = every("tall", lambda j: cell(0, block("wide"), j, F.lit(1)))
    own = block("tall")
    outside = F.concat(every("wide", lambda i: cell(0, i, own, F.lit(0))),
                       every("tall", lambda j: cell(1, F.least(own, j), F.greatest(own, j), F.when(own == j, F.lit(2)).otherwise((own > j).cast("int")))))
    return (members.withColumn("at", F.explode(F.when(F.col("root") == F.col("major"), inside).otherwise(outside)))
            .select("bucket", "at.kind", "at.i", "at.j", "at.side", "band", "node", "root", "n_shingles", "sig", "sketch"))


def meet(rows: pa.Table, least: float, per_band: int, percent: int, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left row, right row, waits) of the pairs of whole cells, whose rows stand together: those of side 0 or 2 with
    those of side 1 or 2. ``waits`` marks pairs beyond the ``best`` of a left row and a component."""
    key = [rows.column(c).to_numpy() for c in ("bucket", "kind", "i", "j")]
    node, root, band, n, side = (rows.column(c).to_numpy() for c in ("node", "root", "band", "n_shingles", "side"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(len(node), -1)
    held = rows.column("sketch").to_pylist()
    bins = np.stack([bins_of(h, k) for h, k in zip(held, n.tolist(), strict=True)])
    new = np.zeros(len(node), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    cell = np.cumsum(new) - 1
    rights = np.flatnonzero(side > 0)
    lo, hi = np.searchsorted(cell[rights], cell), np.searchsorted(cell[rights], cell, "right")
    lefts = np.flatnonzero((side != 1) & (hi > lo))
    ends = np.cumsum(hi[lefts] - lo[lefts])
    out, begin = [], 0
    while begin < len(lefts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        x, k = lefts[begin:end], (hi - lo)[lefts[begin:end]]
        begin = end
        place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        y, x = rights[np.repeat(lo[x], k) + place], np.repeat(x, k)
        ok = (root[x] != root[y]) & ((side[x] != 2) | (node[x] < node[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        same = sig[x] == sig[y]
        near = same.sum(1)
        ok = near >= least
        x, y, near, same = x[ok], y[ok], near[ok], same[ok]
        ok = same.reshape(len(x), -1, per_band).all(2).argmax(1) == band[x] if len(x) else ok[:0]
        x, y, near = x[ok], y[ok], near[ok]
        for at in range(0, len(x), PAIRS // 4):
            part = slice(at, at + PAIRS // 4)
            ok[:len(x)][part] = alike(bins[x[part]], bins[y[part]], n[x[part]] + n[y[part]], percent)
        for at in np.flatnonzero(ok[:len(x)] & (n[x] <= SMALL) & (n[y] <= SMALL)).tolist():  # at least as many are common as in fact
            both = int(np.isin(np.frombuffer(held[x[at]], "<u4"), np.frombuffer(held[y[at]], "<u4")).sum())
            ok[at] = 100 * both >= percent * (n[x[at]] + n[y[at]] - both)
        x, y, near = (c[ok[:len(x)]] for c in (x, y, near))
        order = np.lexsort((node[y], -near, root[y], x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (root[y][1:] != root[y][:-1]))[:len(x)])
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        out.append((x, y, rank >= best))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, bool if i == 2 else np.int64) for i in range(3))


def across(members: DataFrame, hashes: int, rows: int, percent: int, best: int) -> DataFrame:
    """(bucket, a, b): candidate pairs between different components of a bucket, the ``best`` ones of a class and a
    component; a null pair marks a bucket in which others wait."""
    least = (percent / 100 - SIGMAS * np.sqrt(percent / 100 * (1 - percent / 100) / hashes)) * hashes

    def found(whole: pa.Table) -> pa.RecordBatch:
        x, y, waits = meet(whole, least, rows, percent, best)
        node, bucket = whole.column("node").to_numpy(), whole.column("bucket").to_numpy()
        x, y, late = x[~waits], y[~waits], np.unique(bucket[x[waits]])
        pad = pa.nulls(len(late), pa.int64())
        pair = [pa.concat_arrays([pa.array(f(node[x], node[y])), pad]) for f in (np.minimum, np.maximum)]
        return pa.RecordBatch.from_arrays([pa.array(np.append(bucket[x], late)), *pair], ["bucket", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = [held.column(c).to_numpy() for c in ("bucket", "kind", "i", "j")]
            last = np.ones(len(held), bool)
            for k in key:
                last &= k == k[-1]
            whole = int(last.argmax())
            if whole:
                yield found(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield found(held)

    order = ["bucket", "kind", "i", "j"]
    return cells(members).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "bucket long, a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept marks the smallest id of each group."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(signatures(docs, size, bands * rows), "minhash-signed")
    # one class a set; its node is the smallest id that has it. Copies are folded before the only shuffle of minima and sketches
    classes = written(signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
                      .agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("n_shingles", "sig", "sketch"), "doc_id").alias("held")), "minhash-classes")
    copied = classes.where("n > 1").select("set_key", F.col("node").alias("first"))
    tagged = written(signed.select("doc_id", "n_shingles", "set_key").join(copied, "set_key", "left")
                     .select("doc_id", "n_shingles", "set_key", F.coalesce("first", "doc_id").alias("node")), "minhash-tagged")
    forget(signed)
    alone = classes.select("node", "held.n_shingles", "held.sig", "held.sketch")

    every = banded(alone, bands, rows).select("bucket", "band", "node")
    shared = written(every.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n"))
                     .where("lead < most").drop("most"), "minhash-buckets")
    hot = broadcast_if_small(written(shared.where(F.col("n") > HOT).select("bucket", F.ceil(F.col("n") / HOT).cast("int").alias("keys")), "minhash-hot"))
    members = written(dealt(every, hot).join(per_bucket(shared.drop("n"), hot), ["bucket", "salt"]).select("bucket", "band", "node", "lead"), "minhash-members")
    nodes = written(members.select("node").distinct(), "minhash-nodes")
    texts = written(docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "minhash-texts")
    # what the rounds below read of a class; several sets of one node are a row each
    alone = written(alone.join(nodes, "node", "left_semi"), "minhash-alone")
    forget(classes, nodes)

    # ids with several sets are one node of all of them
    several = tagged.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").drop("b")
    links = written(tagged.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a < b").distinct(), "minhash-links")
    checked, roots = links, written(components(links), "minhash-roots")

    def confirm(found: DataFrame) -> None:
        """Confirms what was not looked at before; links and components with what holds."""
        nonlocal links, checked, roots
        new = written(found.join(checked, ["a", "b"], "left_anti"), "minhash-pairs")
        if new.isEmpty():
            return
        checked = checked.unionByName(new)
        more = written(confirmed(new, texts, size, percent), "minhash-more")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = written(components(links), "minhash-roots")

    def rooted(part: DataFrame) -> DataFrame:
        return part.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    for begin, end in GROUPS:
        part = members.where((F.col("band") >= begin) & (F.col("band") < min(end, bands)) & (F.col("node") > F.col("lead")))
        far = rooted(part).join(roots.select(F.col("node").alias("lead"), F.col("root").alias("lead_root")), "lead", "left")
        confirm(far.where(F.col("root") != F.coalesce("lead_root", "lead")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())

    todo, best = None, FIRST_BEST
    while True:
        part = members.drop("lead") if todo is None else dealt(members.drop("lead"), hot).join(per_bucket(todo, hot), ["bucket", "salt"]).drop("salt")
        part = written(rooted(part), "minhash-rooted")
        open_ = written(open_buckets(part), "minhash-open")
        if open_.isEmpty():
            break
        mixed = dealt(part, hot).join(per_bucket(open_, hot), ["bucket", "salt"]).drop("salt").join(alone, "node")
        found = written(across(mixed, bands * rows, rows, percent, best), "minhash-found")
        confirm(found.where("a is not null").select("a", "b").distinct())
        forget(part, open_)
        todo, best = found.where("a is null").select("bucket").distinct(), 64 * best
        if todo.isEmpty():
            break
    forget(members, texts, alone, shared)
    return (tagged.select("doc_id", "n_shingles", "node").join(roots, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull())))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id, of several the first; a row without
    an id only where no other is."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = written(docs.select(row, F.col(doc_id).cast("long").alias("id")).withColumn("number", F.monotonically_increasing_id()), "minhash-rows")
    groups = near_duplicates(rows.select(F.col("number").alias("doc_id"), F.col("row").getField(text).alias("text")), size, percent)
    named = groups.select(F.col("doc_id").alias("number"), "component_id").join(rows.select("number", "id"), "number")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number")).alias("first"))
    return rows.join(first.select(F.col("first.number").alias("number")), "number", "left_semi").select("row.*")
