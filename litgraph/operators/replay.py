"""The log of corrections replayed in time order, as joins.

Every decision means the keys as they were when it was made. Merges give each key a path of the keys it became, with
the id of the decision from which on each holds; ``as_of`` looks a key up on that path, so that nothing is replayed one
by one. An edge is a lineage: the pieces of time in which it stood under one pair of keys, which merges and splits end.
A status decision holds for the lineages that stand under its keys at that time; the last one of each lineage counts,
and lineages that end on one edge fold as merging folds them (the highest status). So a status decided before a merge
is judged on the edge of that time.

Loops run over the length of merge chains in doublings, and over the number of splits of one edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import free_key
from ..functions.text import norm
from ..model import STATUS_RANK, Library
from ..session import cut, stored
from . import lookups as lk
from .corrections import active, field, merge_entities
from .graph import components

FOREVER = (1 << 63) - 1
BEFORE = -1
LOG_KEYS = 2_000_000  # different keys of a log whose hashes may travel to the edges


# ---- merges as paths ---------------------------------------------------------------------

def born(decisions: DataFrame) -> DataFrame:
    """(key, type, name, id, created_at, origin): what create_topic and create_idea may create; the first of each key."""
    c = active(decisions).filter("op in ('create_topic','create_idea')").withColumn("type", F.when(F.col("op") == "create_topic", "topic").otherwise("idea"))
    c = c.withColumn("name", F.coalesce(field("name"), field("text")))
    c = c.withColumn("key", F.coalesce(F.when(F.col("type") == "topic", field("key")), free_key(F.col("type"), norm(F.col("name")))))
    return c.select("key", "type", "name", "id", "created_at", F.when(F.col("type") == "idea", "user").alias("origin"))


def usable_merges(known: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges(id, key, into), skipped): both ends known by then, of one type, and different. known(key, type, since)."""
    m = active(decisions).filter("op = 'merge'").select("id", field("from").alias("key"), field("into").alias("into"))
    end = known.groupBy("key").agg(F.min(F.struct("since", "type")).alias("e")).select("key", "e.since", "e.type")
    m = m.join(end.select("key", F.col("since").alias("fs"), F.col("type").alias("ft")), "key", "left").join(
        end.select(F.col("key").alias("into"), F.col("since").alias("its"), F.col("type").alias("it")), "into", "left")
    why = (F.when(F.col("ft").isNull() | F.col("it").isNull() | (F.col("fs") >= F.col("id")) | (F.col("its") >= F.col("id")), "not found")
           .when(F.col("key") == F.col("into"), "same entity").when(F.col("ft") != F.col("it"), "different types"))
    m = cut(m.withColumn("reason", why))
    return m.filter("reason is null").select("id", "key", "into"), m.filter("reason is not null").select("id", F.lit("merge").alias("op"), "reason")


def _closing(links: DataFrame) -> DataFrame:
    """(id): the latest link of each cycle, which would merge an entity into itself. links(key, into, id)."""
    step = cut(links.select("key", F.col("into").alias("at")))
    reach, total = 1, step.count()
    while True:
        hop = step.select(F.col("key").alias("at"), F.col("at").alias("next"))
        step = cut(step.join(hop, "at").select("key", F.col("next").alias("at")))  # who reaches an end is out
        if step.isEmpty():
            return links.limit(0).select("id")
        reach *= 2
        if reach > total:
            break
    round_ = step.select(F.col("at").alias("key")).distinct()
    cyclic = links.join(round_, "key", "left_semi")
    part = components(round_, cyclic.select(F.col("key").alias("a"), F.col("into").alias("b")))
    return cyclic.join(part, "key").groupBy("component").agg(F.max("id").alias("id")).select("id")


def forest(merges: DataFrame) -> DataFrame:
    """(key, into, id): the merge that took each key away, the first that did not close a cycle."""
    while True:
        first = cut(merges.groupBy("key").agg(F.min(F.struct("id", "into")).alias("m")).select("key", "m.into", "m.id"))
        closing = cut(_closing(first))
        if closing.isEmpty():
            return first
        merges = cut(merges.join(closing, "id", "left_anti"))


def paths(links: DataFrame) -> DataFrame:
    """(key, at, start, stop): each merged key's keys over time; a decision sees the one with start < id <= stop."""
    reach = 1
    known = cut(links.select("key", F.col("into").alias("at"), F.lit(1).alias("hops"), F.col("id").alias("start")))
    while True:
        far = known.filter(F.col("hops") == reach).select("key", F.col("at").alias("mid"), F.col("start").alias("first"))
        on = known.select(F.col("key").alias("mid"), "at", "hops", "start")
        more = cut(far.join(on, "mid").select("key", "at", (F.col("hops") + reach).alias("hops"), F.greatest("first", "start").alias("start")))
        if more.isEmpty():
            break
        known, reach = cut(known.unionByName(more)), 2 * reach
    own = links.select("key", F.col("key").alias("at"), F.lit(0).alias("hops"), F.lit(BEFORE).cast("long").alias("start"))
    stop = F.lead("start").over(Window.partitionBy("key").orderBy("hops"))
    return own.unionByName(known).select("key", "at", "start", F.coalesce(stop, F.lit(FOREVER)).alias("stop"))


def as_of(df: DataFrame, column: str, path: DataFrame, time: str = "id") -> DataFrame:
    """``df`` with the key in ``column`` replaced by what it was at the decision ``time``."""
    p = path.select(F.col("key").alias(column), F.col("at").alias("_at"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    met = (df[column] == p[column]) & (F.col("_start") < F.col(time)) & (F.col(time) <= F.col("_stop"))
    out = df.join(p, met, "left").drop(p[column])
    return out.withColumn(column, F.coalesce("_at", F.col(column))).drop("_at", "_start", "_stop")


def targets(path: DataFrame) -> DataFrame:
    """(key, target): where each merged key ended."""
    return path.filter(F.col("stop") == FOREVER).filter("key != at").select("key", F.col("at").alias("target"))


# ---- edges as lineages -------------------------------------------------------------------

def _pieces(segments: DataFrame, path: DataFrame) -> DataFrame:
    """(lid, src, dst, type, start, stop): the times in which an edge stands under one pair of keys. segments(lid, src,
    dst, type, since). An edge that becomes a loop ends there."""
    out = segments.withColumn("start", F.col("since")).withColumn("stop", F.lit(FOREVER))
    for end in ("src", "dst"):
        p = path.select(F.col("key").alias(end), F.col("at").alias("_at"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
        out = out.join(p, end, "left").withColumn(end, F.coalesce("_at", F.col(end)))
        out = out.withColumn("start", F.greatest("start", F.coalesce("_start", "start"))).withColumn("stop", F.least("stop", F.coalesce("_stop", "stop"))).drop("_at", "_start", "_stop")
    out = out.filter("start < stop")
    loop = out.filter("src = dst").groupBy("lid").agg(F.min("start").alias("ends"))
    out = out.join(loop, "lid", "left").filter("ends is null or start < ends")
    return out.withColumn("stop", F.least("stop", F.coalesce("ends", F.lit(FOREVER)))).select("lid", "src", "dst", "type", "start", "stop")


def lineages(leaves: DataFrame, path: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, hits): the pieces of every edge under merges and splits, and (id, key, new_key) of the splits that
    found an edge. leaves(lid, src, dst, type, since), splits(id, key, new_key, src, dst, type), keys as of their time."""
    segments, pieces, hits = leaves.select("lid", "src", "dst", "type", "since"), None, None
    while True:
        new = stored(_pieces(segments, path), "pieces")
        on = splits.select(F.col("id").alias("at"), "key", "new_key", "src", "dst", "type")
        met = new.join(on, ["src", "dst", "type"]).filter("start < at and at <= stop and (key = src or key = dst)")
        first = cut(met.groupBy("lid").agg(F.min(F.struct("at", "key", "new_key", "src", "dst", "type")).alias("m")).select("lid", "m.*"))
        ended = first.select("lid", "at")
        kept = new.join(ended, "lid", "left").filter("at is null or start < at").withColumn("stop", F.least("stop", F.coalesce("at", F.lit(FOREVER)))).drop("at")
        pieces = kept if pieces is None else pieces.unionByName(kept)
        found = met.select(F.col("at").alias("id"), "key", "new_key").distinct()
        hits = found if hits is None else hits.unionByName(found).distinct()
        if first.isEmpty():
            return pieces, hits
        swap = lambda end: F.when(F.col(end) == F.col("key"), F.col("new_key")).otherwise(F.col(end)).alias(end)
        segments = first.select("lid", swap("src"), swap("dst"), "type", F.col("at").alias("since"))


def last_words(pieces: DataFrame, said: DataFrame) -> DataFrame:
    """(lid, said): the status last decided while the edge stood under the decision's keys. said(id, src, dst, type,
    status). Decisions and the ends of pieces meet in the order of time, once for each different end."""
    edge = ["src", "dst", "type"]
    ends = pieces.select(*edge, F.col("stop").alias("t"), F.lit(None).cast("struct<id:bigint,status:string>").alias("word")).distinct()
    told = said.select(*edge, F.col("id").alias("t"), F.struct(F.col("id").cast("long").alias("id"), "status").alias("word"))
    told = told.join(pieces.select(*edge).distinct(), edge, "left_semi")
    w = Window.partitionBy(*edge).orderBy("t", F.col("word").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    at = ends.unionByName(told).withColumn("last", F.last("word", ignorenulls=True).over(w)).filter("word is null and last is not null").select(*edge, F.col("t").alias("stop"), "last")
    held = pieces.join(at, [*edge, "stop"]).filter("last.id > start")
    return held.groupBy("lid").agg(F.max("last").alias("m")).select("lid", F.col("m.status").alias("said"))


def concerned(edge: DataFrame, decided: DataFrame, path: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges the log may touch, all others), or the statements of such edges. An edge keeps its keys and its status if no
    merge or split took or made one of its ends and no decision names its source: then no other edge ends on its keys
    either. The keys of the log are few beside the edges; where they are counted to be, the edges are not shuffled for it.
    Keys are compared by their hashes: an edge taken for another passes the log unchanged."""
    ends = path.select("key").unionByName(path.select(F.col("at").alias("key"))).unionByName(splits.select("key")).unionByName(splits.select(F.col("new_key").alias("key")))
    sources = decided.select(F.col("src").alias("key")).unionByName(splits.select(F.col("src").alias("key")))
    out = edge
    for end, keys in (("src", ends.unionByName(sources)), ("dst", ends)):
        keys = stored(keys.filter("key is not null").select(F.xxhash64("key").alias(f"_{end}h")).distinct(), "ends")
        keys = F.broadcast(keys) if keys.count() <= LOG_KEYS else keys.hint("merge")
        out = out.withColumn(f"_{end}h", F.xxhash64(end)).join(keys.withColumn(f"_{end}", F.lit(True)), f"_{end}h", "left")
    near = F.coalesce("_src", "_dst").isNotNull()
    return out.filter(near).select(*edge.columns), out.filter(~near).select(*edge.columns)


def replayed_edges(lib: Library, decided: DataFrame, path: DataFrame, splits: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, split hits). decided(id, src, dst, type, status, evidence, created_at): statuses with keys of their time;
    a confirmation of an edge that is not there adds it. there(key, since): the entities."""
    rank = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    names = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(v), F.lit(k))])
    edge = ["src", "dst", "type"]
    apart = lambda e: concerned(e.filter("src != dst"), decided, path, splits)
    touched, rest_of = lib.edge_parts(apart) if hasattr(lib, "edge_parts") else apart(lib.edge)
    columns = touched.columns
    base = touched.withColumn("lid", F.concat_ws("\x1f", F.lit("e"), *edge)).withColumn("since", F.lit(BEFORE).cast("long"))
    known = there.groupBy("key").agg(F.min("since").alias("since"))
    adds = decided.filter("status = 'confirmed' and src != dst")
    for end in edge[:2]:
        adds = adds.join(known.select(F.col("key").alias(end), F.col("since").alias("_s")), end).filter("_s <= id").drop("_s")
    adds = adds.select(F.concat_ws("\x1f", F.lit("d"), F.col("id").cast("string"), *edge).alias("lid"), *edge, F.col("id").cast("long").alias("since"), "status", "evidence", "created_at")
    added = [c for c in ("evidence", "created_at") if c in columns]
    leaves = base.unionByName(adds.select("lid", *edge, "since", "status", *added, F.lit(1.0).alias("confidence")), allowMissingColumns=True)
    leaves = stored(leaves.dropDuplicates(["lid"]), "leaves")
    pieces, hits = lineages(leaves, path, splits)
    pieces = stored(pieces, "lineages")
    final = pieces.filter(F.col("stop") == FOREVER).select("lid", *(F.col(c).alias(f"_{c}") for c in edge[:2]))
    out = leaves.join(final, "lid").join(last_words(pieces, decided), "lid", "left")
    out = out.withColumn("src", F.col("_src")).withColumn("dst", F.col("_dst")).withColumn("status", F.coalesce("said", "status")).drop("_src", "_dst", "said")
    # an added edge stands only where no other one ended; its status counts in any case
    own = F.col("since") == BEFORE
    rest = [c for c in columns if c not in (*edge, "status", "confidence", "evidence", "created_at")]
    order = F.struct((~own).alias("late"), "created_at", "evidence", "lid")
    some = F.max(own.cast("int")) == 1
    folded = out.groupBy(*edge).agg(
        names[F.max(rank[F.col("status")])].alias("status"),
        F.when(some, F.max(F.when(own, F.col("confidence")))).otherwise(F.max("confidence")).alias("confidence"),
        F.min_by("evidence", F.when(F.col("evidence").isNotNull(), order)).alias("evidence"),
        F.when(some, F.min(F.when(own, F.col("created_at")))).otherwise(F.min("created_at")).alias("created_at"),
        *[F.min_by(c, order).alias(c) for c in rest])
    return folded.select(*columns).unionByName(rest_of), hits


# ---- the whole log -------------------------------------------------------------------------

def _statuses(d: DataFrame, path: DataFrame, types: DataFrame, made: DataFrame) -> DataFrame:
    """(id, src, dst, type, status, evidence, created_at): what the log says of edges, keys as of their time. Links of a
    created idea and the parent of a created topic are edges, too. made(id, key): what create decisions stand for."""
    cols = ["id", "src", "dst", "type", "status", "evidence", "created_at"]
    said = d.filter("op in ('edge_status','add_edge')").select(
        "id", field("src").alias("src"), field("dst").alias("dst"), field("type").alias("type"),
        F.when(F.col("op") == "add_edge", "confirmed").otherwise(field("status")).alias("status"), field("evidence").alias("evidence"), "created_at")
    said = as_of(as_of(said, "src", path), "dst", path)
    none = F.lit(None).cast("string").alias("evidence")
    links = d.filter("op = 'create_idea'").select("id", "created_at", F.explode(F.from_json(field("links"), "array<string>")).alias("dst"))
    links = as_of(links, "dst", path).join(types.select(F.col("key").alias("dst"), F.col("type").alias("dt")), "dst").join(made.select("id", F.col("key").alias("src")), "id")
    links = links.select("id", "src", "dst", F.when(F.col("dt") == "topic", "applicable_to").otherwise("relates_to").alias("type"), F.lit("confirmed").alias("status"), none, "created_at")
    up = d.filter("op = 'create_topic'").select("id", "created_at", field("parent").alias("dst")).filter("dst is not null")
    up = as_of(up, "dst", path).join(made.select("id", F.col("key").alias("src")), "id")
    up = up.select("id", "src", "dst", F.lit("is_a").alias("type"), F.lit("confirmed").alias("status"), none, "created_at")
    return said.select(*cols).unionByName(links).unionByName(up)


def apply_all(lib: Library, decisions: DataFrame) -> tuple[Library, DataFrame]:
    """(library, skipped): every active decision replayed in the order of ids; stale ones are listed with the reason."""
    d = cut(active(decisions))
    # what create decisions stand for: an entity of that key, one of that name, or a new one
    new = cut(born(d).filter("key is not null"))
    there = lib.entity.select("key", "type")
    named = lib.alias.select("norm", F.col("entity_key").alias("key")).join(there, "key").groupBy("norm", "type").agg(F.min("key").alias("named"))
    meant = new.withColumn("norm", norm(F.col("name"))).join(there.select("key", F.lit(True).alias("has")), "key", "left").join(named, ["norm", "type"], "left")
    meant = cut(meant.withColumn("own", F.when(F.col("has"), F.col("key")).otherwise(F.coalesce("named", "key"))))
    fresh = meant.filter("has is null and named is null").groupBy("key").agg(F.min(F.struct("id", "type", "name", "created_at", "origin")).alias("m")).select("key", "m.*")
    parts = d.filter("op = 'split'").select("id", field("key").alias("key"), field("new_name").alias("new_name"), field("new_key").alias("new_key"),
                                            F.explode(F.from_json(field("edges"), "array<struct<src:string,dst:string,type:string>>")).alias("e")).select("id", "key", "new_name", "new_key", "e.*")
    known = there.withColumn("since", F.lit(BEFORE).cast("long")).unionByName(fresh.select("key", "type", F.col("id").cast("long").alias("since")))
    halves = parts.join(known.select("key", F.col("type").alias("etype")).distinct(), "key").withColumn("new_key", F.coalesce("new_key", free_key(F.col("etype"), norm(F.col("new_name")))))
    halves = cut(halves)
    known = stored(known.unionByName(halves.select(F.col("new_key").alias("key"), F.col("etype").alias("type"), F.col("id").cast("long").alias("since")).distinct()), "known")
    merges, skipped = usable_merges(known, d)
    path = stored(paths(forest(merges)), "paths")
    red = cut(targets(path))

    splits = halves.drop("new_name", "etype")
    for column in ("key", "src", "dst"):
        splits = as_of(splits, column, path)
    made = as_of(meant.select("id", F.col("own").alias("key")), "key", path)
    edge, hits = replayed_edges(lib, cut(_statuses(d, path, known.select("key", "type").distinct(), made)), path, cut(splits), known)
    hits = cut(hits)

    # entities that decisions make, on the keys of their time
    halved = halves.join(hits.select("id"), "id", "left_semi").groupBy("new_key").agg(F.min(F.struct("id", "etype", "new_name")).alias("m"))
    halved = halved.select(F.col("new_key").alias("key"), F.col("m.etype").alias("type"), F.col("m.new_name").alias("canonical_name"), F.col("m.id").alias("id"))
    when = d.select("id", F.col("created_at"))
    halved = halved.join(when, "id").join(there.select("key"), "key", "left_anti").join(fresh.select("key"), "key", "left_anti")
    add = fresh.select("key", "type", F.col("name").alias("canonical_name"), "created_at", "origin").withColumn("status", F.lit("active")).unionByName(
        halved.select("key", "type", "canonical_name", "created_at").withColumn("status", F.lit("active")), allowMissingColumns=True)
    entity = stored(lib.entity.unionByName(add, allowMissingColumns=True), "entities")
    alias = _moved_names(lib, halves, hits, path).unionByName(add.select(F.col("key").alias("entity_key"), F.col("canonical_name").alias("alias"))
                                                              .withColumn("norm", norm(F.col("alias"))).withColumn("source", F.lit("user")), allowMissingColumns=True)

    # what the log says of entities: on keys that went on to merge before it, on the rest after it
    keyed = d.filter("op in ('confirm_topic','rename','add_alias','edit_text','reject_entity')").withColumn("key", field("key"))
    ups = d.filter("op = 'create_topic'").join(made, "id").withColumn("op", F.lit("confirm_topic"))
    keyed = as_of(keyed, "key", path).unionByName(ups.select(*keyed.columns))
    exist = known.join(entity.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("since", "type")).alias("m")).select("key", F.col("m.since").alias("since"), "m.type")
    keyed = cut(keyed.join(exist, "key", "left").withColumn("lost", F.col("since").isNull() | (F.col("since") > F.col("id"))))
    lost = keyed.filter("lost").select("id", "op", F.lit("not found").alias("reason"))
    keyed = cut(keyed.filter("not lost").join(red.select("key", F.lit(True).alias("gone")), "key", "left"))
    papers = keyed.filter("op = 'reject_entity' and type = 'work'").select("id", "op", F.lit("a paper is retracted, not rejected").alias("reason"))
    out = lib.with_(entity=entity, alias=alias)
    out = _said_of_entities(out, keyed.filter("gone"))
    whole = merge_entities(out.with_(edge=edge.limit(0)), red)
    whole = _said_of_entities(whole.with_(entity=stored(whole.entity, "entities")), keyed.filter("gone is null"))
    return whole.with_(edge=edge), skipped.unionByName(lost).unionByName(papers)


def _said_of_entities(lib: Library, keyed: DataFrame) -> Library:
    """Statuses, names and texts: the last word of each; every wording stays a name. keyed(id, op, key, type, payload)."""
    state = keyed.filter("op = 'confirm_topic' or (op = 'reject_entity' and type != 'work')").groupBy("key").agg(
        F.max_by(F.when(F.col("op") == "reject_entity", "rejected").otherwise("active"), "id").alias("_st"))
    text = F.coalesce(field("name"), field("text"))
    wording = keyed.filter("op in ('rename','edit_text')").groupBy("key").agg(F.max_by(text, "id").alias("_nm"))
    renamed = keyed.filter("op = 'rename'").select("key").distinct()
    names = (keyed.filter("op in ('rename','edit_text','add_alias')").select(F.col("key").alias("entity_key"), F.coalesce(field("alias"), text).alias("alias"))
             .unionByName(renamed.join(lib.entity, "key").select(F.col("key").alias("entity_key"), F.col("canonical_name").alias("alias"))))
    fresh = names.withColumn("norm", norm(F.col("alias"))).filter(F.length("norm").between(1, 500)).join(lib.alias.select("entity_key", "norm"), ["entity_key", "norm"], "left_anti")
    fresh = fresh.groupBy("entity_key", "norm").agg(F.min("alias").alias("alias")).withColumn("source", F.lit("user"))
    entity = (lib.entity.join(state, "key", "left").join(wording, "key", "left").withColumn("status", F.coalesce("_st", "status"))
              .withColumn("canonical_name", F.coalesce("_nm", "canonical_name")).drop("_st", "_nm"))
    return lib.with_(entity=entity, alias=lib.alias.unionByName(fresh, allowMissingColumns=True))


def _moved_names(lib: Library, halves: DataFrame, hits: DataFrame, path: DataFrame) -> DataFrame:
    """The names with those of a split's new entity moved to it; an entity's own name stays."""
    go = halves.select("id", "key", "new_name", "new_key").distinct().join(hits.select("id"), "id", "left_semi")
    go = as_of(go, "key", path).withColumn("norm", norm(F.col("new_name"))).groupBy(F.col("key").alias("entity_key"), "norm").agg(F.min_by("new_key", "id").alias("_to"))
    own = lib.entity.select(F.col("key").alias("entity_key"), norm(F.col("canonical_name")).alias("_own"))
    out = lib.alias.join(go, ["entity_key", "norm"], "left").join(own, "entity_key", "left")
    moves: Column = F.col("_to").isNotNull() & ((F.col("norm") != F.col("_own")) | F.col("_own").isNull())
    return out.withColumn("entity_key", F.when(moves, F.col("_to")).otherwise(F.col("entity_key"))).drop("_to", "_own")
