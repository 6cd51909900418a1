"""Corrections: a log of human decisions, its checks, and what single decisions do; ``replay`` runs the whole log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import card_id
from ..functions.text import norm
from ..model import EDGE_TYPES, STATUS_RANK, Library
from ..session import cut, global_row_number
from . import lookups as lk

# The operations and the fields each needs.
REQUIRED = {
    "merge": ("from", "into"), "distinct": ("a", "b"), "split": ("key", "new_name", "edges"), "edge_status": ("src", "dst", "type", "status"),
    "add_edge": ("src", "dst", "type"), "create_topic": ("name",), "confirm_topic": ("key",), "rename": ("key", "name"), "add_alias": ("key", "alias"),
    "edit_text": ("key", "text"), "create_idea": ("text",), "retract": ("work",), "reject_entity": ("key",)}
EDGE_STATUSES = ("confirmed", "rejected", "auto")


def field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def active(decisions: DataFrame) -> DataFrame:
    return decisions.filter("revoked_at is null")


def validated(lib: Library, decisions: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """decisions with ``problem`` (null when it can be stored) and ``hint``: the key meant, when the entity
    named is unknown but its name part is someone's name."""
    known = F.col("op").isin(*REQUIRED)
    missing, blank = F.lit(None).cast("string"), F.lit(None).cast("string")
    for op, names in REQUIRED.items():
        mine = F.col("op") == op
        missing = F.coalesce(missing, F.when(mine, F.array_join(F.filter(F.array(*[F.when(field(n).isNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull()), ", ")))
        blank = F.coalesce(blank, F.when(mine, F.array_join(F.filter(F.array(*[F.when(F.trim(field(n)) == "", F.lit(n)) for n in names]), lambda x: x.isNotNull()), ", ")))
    edge_op = F.col("op").isin("edge_status", "add_edge")
    d = decisions.withColumn("_m", missing).withColumn("_b", blank)
    shape = (F.when(~known, "unknown op").when(F.col("_m") != "", F.concat(F.lit("missing "), "_m")).when(F.col("_b") != "", F.concat(F.lit("empty "), "_b"))
             .when(edge_op & ~field("type").isin(*EDGE_TYPES), "unknown edge type").when((F.col("op") == "edge_status") & ~field("status").isin(*EDGE_STATUSES), "unknown status"))
    d = d.withColumn("shape", shape).drop("_m", "_b")
    asked = d.filter("shape is null").select("id", F.explode(F.filter(F.array(*[field(n) for n in ("key", "from", "into", "a", "b", "src", "dst")]), lambda x: x.isNotNull())).alias("ref"))
    asked = asked.withColumn("k", F.col("ref"))
    if redirects is not None:
        asked = lk.follow(asked, redirects, "k")
    have = lib.entity.select(F.col("key").alias("k"), F.lit(True).alias("there"))
    lost = asked.join(have, "k", "left").filter("there is null").select("id", "ref")
    named = lost.select("id", "ref", F.split_part("ref", F.lit(":"), F.lit(1)).alias("type"), norm(F.expr("substring(ref, instr(ref, ':') + 1)")).alias("norm"))
    tip = lk.by_alias(lib, named).groupBy("id").agg(F.min("ref").alias("lost"), F.min("key").alias("hint"))
    return d.join(tip, "id", "left").withColumn(
        "problem", F.coalesce("shape", F.when(F.col("lost").isNotNull(), F.concat(F.lit("not found: "), "lost")))).drop("shape", "lost")


def merges_of(lib: Library, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable merges, skipped): both ends known, of one type, and different."""
    m = active(decisions).filter("op = 'merge'").select("id", field("from").alias("from_key"), field("into").alias("into_key"))
    types = lib.entity.select("key", "type")
    m = (m.join(types.select(F.col("key").alias("from_key"), F.col("type").alias("ft")), "from_key", "left")
         .join(types.select(F.col("key").alias("into_key"), F.col("type").alias("it")), "into_key", "left"))
    why = (F.when(F.col("ft").isNull() | F.col("it").isNull(), "not found").when(F.col("from_key") == F.col("into_key"), "same entity")
           .when(F.col("ft") != F.col("it"), "different types"))
    m = cut(m.withColumn("reason", why))
    return m.filter("reason is null").select("id", "from_key", "into_key"), m.filter("reason is not null").select("id", F.lit("merge").alias("op"), "reason")


def fold_edges(edge: DataFrame) -> DataFrame:
    """One row per (src, dst, type): highest status and confidence, first evidence and time; other columns
    come from the row that was there first. Self-loops go."""
    rank = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    names = {v: k for k, v in STATUS_RANK.items()}
    top = F.max(rank[F.col("status")])
    rest = [c for c in edge.columns if c not in ("src", "dst", "type", "status", "confidence", "evidence", "created_at")]
    first = [F.min_by(c, F.struct("created_at", "evidence")).alias(c) for c in rest]
    return edge.filter("src != dst").groupBy("src", "dst", "type").agg(
        F.when(top == 2, names[2]).when(top == 1, names[1]).otherwise(names[0]).alias("status"), F.max("confidence").alias("confidence"),
        F.min_by("evidence", F.when(F.col("evidence").isNotNull(), F.struct("created_at", "evidence"))).alias("evidence"), F.min("created_at").alias("created_at"), *first)


def merge_entities(lib: Library, redirects: DataFrame) -> Library:
    """Edges, names and works of merged entities move to the survivor and fold; a user's wording
    survives, an active status too."""
    edge = fold_edges(lk.follow(lk.follow(lib.edge, redirects, "src"), redirects, "dst"))
    alias = lk.follow(lib.alias, redirects, "entity_key")
    keep = [c for c in alias.columns if c not in ("entity_key", "norm")]
    alias = alias.groupBy("entity_key", "norm").agg(*[F.min_by(c, F.struct("source", "alias")).alias(c) for c in keep])
    moved = lib.entity.join(redirects, "key").groupBy("target").agg(
        F.min_by("canonical_name", F.when(F.col("origin") == "user", F.col("key"))).alias("user_name"), F.max((F.col("status") == "active").cast("int")).alias("was_active"))
    e = lib.entity.join(redirects.select("key"), "key", "left_anti").join(moved.withColumnRenamed("target", "key"), "key", "left")
    takes = F.col("user_name").isNotNull() & (F.coalesce("origin", F.lit("")) != "user")
    e = (e.withColumn("canonical_name", F.when(takes, F.col("user_name")).otherwise(F.col("canonical_name"))).withColumn("origin", F.when(takes, "user").otherwise(F.col("origin")))
         .withColumn("status", F.when((F.col("was_active") == 1) & (F.col("status") == "candidate"), "active").otherwise(F.col("status"))).drop("user_name", "was_active"))
    work = lk.follow(lib.work, redirects, "entity_key").groupBy("entity_key").agg(F.min("year").alias("year"), F.max("tier").alias("tier"))
    return Library(entity=e, edge=edge, alias=alias, work=work)


def edge_decisions(decisions: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(src, dst, type, status, adds, at, evidence): the last word on each edge; an explicit add confirms."""
    d = active(decisions).filter("op in ('edge_status','add_edge')").select(
        "id", "created_at", field("src").alias("src"), field("dst").alias("dst"), field("type").alias("type"),
        F.when(F.col("op") == "add_edge", "confirmed").otherwise(field("status")).alias("status"), field("evidence").alias("evidence"))
    if redirects is not None:
        d = lk.follow(lk.follow(d, redirects, "src"), redirects, "dst")
    last = d.groupBy("src", "dst", "type").agg(F.max_by(F.struct("status", "evidence"), "id").alias("m"), F.max((F.col("status") == "confirmed").cast("int")).alias("c"), F.min("created_at").alias("at"))
    return last.select("src", "dst", "type", "m.status", (F.col("c") == 1).alias("adds"), "at", "m.evidence").filter("src != dst")


def effective_edges(lib: Library, decided: DataFrame) -> DataFrame:
    """The edge table under the decisions: status replaced, confirmed edges that were missing added."""
    d = decided.select("src", "dst", "type", F.col("status").alias("_s"))
    out = lib.edge.join(d, ["src", "dst", "type"], "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    keys = lib.entity.select("key")
    new = (decided.filter("adds").join(lib.edge.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
           .join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
           .select("src", "dst", "type", "status", F.lit(1.0).alias("confidence"), "evidence", F.col("at").alias("created_at")))
    return out.unionByName(new, allowMissingColumns=True)


def distinct_pairs(decisions: DataFrame) -> DataFrame:
    """(a, b) a <= b: pairs a person declared different; every split declares one."""
    d = active(decisions).filter("op in ('distinct','split')").select(F.coalesce(field("a"), field("key")).alias("x"), F.coalesce(field("b"), field("new_key")).alias("y"))
    return d.filter("x is not null and y is not null").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def pinned(lib: Library, decisions: DataFrame) -> DataFrame:
    """Keys of a merge whose other side does not exist yet; they must not be merged away meanwhile."""
    m = active(decisions).filter("op = 'merge'").select("id", field("from").alias("from_key"), field("into").alias("into_key"))
    red = lk.redirect_map(m)
    have = lib.entity.select(F.col("key").alias("target"))
    waiting = red.join(have, "target", "left_anti").select("key")
    return waiting.unionByName(m.select(F.col("into_key").alias("key"))).distinct()


def current(extractions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Extractions with is_current: false while an active retract lists them; revoking it restores them."""
    out = active(decisions).filter("op = 'retract'").select(F.explode(F.from_json(field("extraction_ids"), "array<bigint>")).alias("id")).distinct()
    return extractions.join(out.withColumn("_r", F.lit(True)), "id", "left").withColumn("is_current", F.col("_r").isNull()).drop("_r")


def stable_ids(new: DataFrame, old: DataFrame) -> DataFrame:
    """(key, id): known keys keep their id, new ones get ids above every id ever used, in hash order. The order is cut
    into ranges that are numbered each, so no task sees all keys. old(key, id)."""
    kept = new.select("key").join(old.select("key", "id"), "key")
    fresh = new.select("key").join(old.select("key"), "key", "left_anti").withColumn("_h", F.md5("key"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return kept.unionByName(global_row_number(fresh, [F.col("_h"), F.col("key")], "id", start=top).select("key", "id"))


def restamped(extractions: DataFrame, paper_of: DataFrame) -> DataFrame:
    """Extractions under the paper they belong to now; paper_of(eid, key)."""
    p = paper_of.select(F.col("eid").alias("id"), F.col("key").alias("_k"))
    return extractions.join(p, "id", "left").withColumn("work_key", F.coalesce("_k", "work_key")).drop("_k")


def reconcile_cards(cards: DataFrame, logs: DataFrame, entity: DataFrame, redirects: DataFrame) -> DataFrame:
    """Cards after a rebuild: they follow merges, one card per slot keeps the longest history, and a card
    without a living entity joins a living one with its question or is suspended."""
    c = lk.follow(cards, redirects, "entity_key")
    n = logs.groupBy(F.col("card_id").alias("id")).agg(F.count("*").alias("history"))
    c = c.join(n, "id", "left").fillna(0, ["history"]).join(entity.select(F.col("key").alias("entity_key"), F.lit(True).alias("lives")), "entity_key", "left")
    sibling = c.filter("lives").groupBy("q").agg(F.min("entity_key").alias("sk"))
    c = c.join(sibling, "q", "left").withColumn("entity_key", F.when(F.col("lives").isNull(), F.coalesce("sk", "entity_key")).otherwise(F.col("entity_key")))
    c = c.withColumn("suspended", F.col("suspended") | (F.col("lives").isNull() & F.col("sk").isNull()))
    c = c.withColumn("slot", card_id(F.col("entity_key"), F.col("q"), F.col("origin")))
    best = F.max_by(F.struct("id", "entity_key", "q", "a", "origin", "due"), F.struct("history", "id"))
    return c.groupBy("slot").agg(best.alias("m"), F.max("priority").alias("priority"), F.min("introduced_at").alias("introduced_at"), F.min("suspended").alias("suspended"),
                                 F.sum("history").alias("history")).select(F.col("slot").alias("id"), F.col("m.id").alias("kept"), "m.entity_key", "m.q", "m.a", "m.origin", "m.due", "priority", "introduced_at", "suspended", "history")


def answers_to_decisions(items: DataFrame, answers: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, obsolete items): answers(id, action) to pending questions as decision rows. Keys follow
    redirects; a question about what is one entity by now is obsolete."""
    q = items.filter("status = 'pending'").join(answers, "id")
    for k in ("a", "b", "key", "topic", "work", "claim"):
        q = lk.follow(q.withColumn(k, F.get_json_object("payload", f"$.{k}")), redirects, k)
    pair = F.col("kind").isin("merge", "topic_relation")
    q = cut(q.withColumn("gone", pair & (F.col("a") == F.col("b"))))
    act, kind = F.col("action"), F.col("kind")

    def edge(src: str, dst: str, etype: Column) -> Column:
        return F.struct(F.lit("add_edge").alias("op"), F.to_json(F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), etype.alias("type"))).alias("payload"))

    merge = F.struct(F.lit("merge").alias("op"), F.to_json(F.struct(F.col("a").alias("from"), F.col("b").alias("into"))).alias("payload"))
    apart = F.struct(F.lit("distinct").alias("op"), F.to_json(F.struct("a", "b")).alias("payload"))
    idea = F.struct(F.lit("create_idea").alias("op"), F.to_json(F.struct(F.concat_ws(" ↔ ", "a", "b").alias("text"), F.array("a", "b").alias("links"))).alias("payload"))
    stance = F.when(F.get_json_object("payload", "$.stance") == "contradicts", "supports").otherwise("contradicts")
    retro = F.when(F.get_json_object("payload", "$.type") == "work", act).otherwise("applicable_to")
    made = (F.when(pair & (act == "merge"), merge).when(pair & (act == "distinct"), apart)
            .when((kind == "topic_relation") & (act == "a_is_a_b"), edge("a", "b", F.lit("is_a"))).when((kind == "topic_relation") & (act == "b_is_a_a"), edge("b", "a", F.lit("is_a")))
            .when((kind == "contradiction") & (act == "accept"), edge("work", "claim", stance))
            .when((kind == "retro_tag") & act.isin("about", "applicable_to"), edge("key", "topic", retro)).when((kind == "synthesis") & (act == "useful"), idea))
    return q.filter("not gone").select("id", made.alias("d")).filter("d is not null").select("id", "d.op", "d.payload"), q.filter("gone").select("id")


def suspend_cards(cards: DataFrame, card_ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Cards with these ids, and all cards of these entities, out of rotation."""
    a = card_ids.select("id", F.lit(True).alias("_a"))
    b = entities.select(F.col("key").alias("entity_key"), F.lit(True).alias("_b"))
    return cards.join(a, "id", "left").join(b, "entity_key", "left").withColumn(
        "suspended", F.col("suspended") | F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).drop("_a", "_b")


def delete_entities(lib: Library, keys: DataFrame) -> Library:
    """The library without these entities and everything that hangs on them."""
    gone = keys.select("key")

    def drop(df: DataFrame | None, *columns: str) -> DataFrame | None:
        for c in columns if df is not None else ():
            df = df.join(gone.select(F.col("key").alias(c)), c, "left_anti")
        return df

    return Library(entity=drop(lib.entity, "key"), edge=drop(lib.edge, "src", "dst"), alias=drop(lib.alias, "entity_key"), work=drop(lib.work, "entity_key"))
