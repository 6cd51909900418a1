"""Browse filters as semi-joins over whole tables; every filter reaches the scans it reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text
from ..model import HUB_TYPES, SEARCH_TYPES, SOURCE_EDGES, TOPIC_EDGES, Library
from .graph import live, topic_subtree


@dataclass(frozen=True)
class Filters:
    types: tuple[str, ...] = SEARCH_TYPES
    edge_type: str | None = None
    organism: str | None = None
    modality: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    tier: int | None = None
    topic: str | None = None  # key of the root topic
    include_candidates: bool = True


def of_types(entity: DataFrame, types: tuple[str, ...] = SEARCH_TYPES) -> DataFrame:
    return entity.filter(F.col("type").isin(*types))


def not_rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") != "rejected")


def without_candidates(entity: DataFrame) -> DataFrame:
    return entity.filter(F.col("status") != "candidate")


def source_edges(lib: Library) -> DataFrame:
    return live(lib.edge).filter(F.col("type").isin(*SOURCE_EDGES))


def with_role(lib: Library, entity: DataFrame, edge_type: str) -> DataFrame:
    """Entities some paper is a source of in this role; other edge types give nothing."""
    works = lib.entity.filter("type = 'work'").select(F.col("key").alias("src"))
    e = source_edges(lib).filter(F.col("type") == edge_type).join(works, "src", "left_semi").select(F.col("dst").alias("key"))
    return entity.join(e, "key", "left_semi")


def linked_to(lib: Library, targets: DataFrame, edge_types: tuple[str, ...]) -> DataFrame:
    """Keys with a live edge of these types into ``targets`` (key)."""
    e = live(lib.edge).filter(F.col("type").isin(*edge_types))
    return e.join(targets.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"))


def via_work(lib: Library, keys: DataFrame) -> DataFrame:
    """``keys`` and everything whose source paper is among them."""
    e = source_edges(lib).join(keys.select(F.col("key").alias("src")), "src", "left_semi")
    return keys.select("key").unionByName(e.select(F.col("dst").alias("key")))


def named(lib: Library, etype: str, name: str) -> DataFrame:
    """Keys of the entities of a type that carry this name."""
    hit = lib.alias.filter(F.col("norm") == norm_text(name)).select(F.col("entity_key").alias("key"))
    return lib.entity.filter(F.col("type") == etype).join(hit, "key", "left_semi").select("key")


def on_hub(lib: Library, entity: DataFrame, etype: str, name: str) -> DataFrame:
    hits = linked_to(lib, named(lib, etype, name), (f"of_{etype}",))
    return entity.join(via_work(lib, hits), "key", "left_semi")


def work_condition(year_min: int | None = None, year_max: int | None = None, tier: int | None = None) -> Column:
    cond = F.lit(True)
    if year_min:
        cond &= F.col("year") >= year_min
    if year_max:
        cond &= F.col("year") <= year_max
    if tier:
        cond &= F.col("tier") >= tier
    return cond


def on_works(lib: Library, entity: DataFrame, cond: Column) -> DataFrame:
    """The entity is, or comes from, a paper that satisfies the whole condition."""
    good = lib.work.filter(cond).select(F.col("entity_key").alias("key"))
    return entity.join(via_work(lib, good), "key", "left_semi")


def on_topic(lib: Library, entity: DataFrame, topic: str) -> DataFrame:
    root = lib.entity.filter(F.col("key") == topic).select("key")
    sub = topic_subtree(lib, root).select("key")
    keys = sub.unionByName(via_work(lib, linked_to(lib, sub, TOPIC_EDGES)))
    return entity.join(keys, "key", "left_semi")


def apply_filters(lib: Library, entity: DataFrame, f: Filters) -> DataFrame:
    out = not_rejected(of_types(entity, f.types))
    if not f.include_candidates:
        out = without_candidates(out)
    if f.edge_type:
        out = with_role(lib, out, f.edge_type)
    for etype, name in (("organism", f.organism), ("modality", f.modality)):
        if name:
            out = on_hub(lib, out, etype, name)
    if f.year_min or f.year_max or f.tier:
        out = on_works(lib, out, work_condition(f.year_min, f.year_max, f.tier))
    if f.topic:
        out = on_topic(lib, out, f.topic)
    return out


def live_cards(lib: Library, cards: DataFrame) -> DataFrame:
    """Not suspended, entity not rejected, and not orphaned: an asset that came from papers needs one
    live source edge left. Both checks read one aggregate over the source edges."""
    src = lib.edge.filter(F.col("type").isin(*SOURCE_EDGES)).groupBy(F.col("dst").alias("key")).agg(
        F.max((F.col("status") != "rejected").cast("int")).alias("any_live"))
    orphan = src.filter("any_live = 0").join(lib.entity.filter("type != 'work'").select("key"), "key", "left_semi")
    dead = lib.entity.filter("status = 'rejected'").select("key").unionByName(orphan.select("key"))
    return cards.filter(~F.col("suspended")).join(dead.withColumnRenamed("key", "entity_key"), "entity_key", "left_anti")


def band(score: Column, auto: float, review: float) -> Column:
    return F.when(score >= auto, "merge").when(score >= review, "review").otherwise("new")


def without_hubs(lib: Library, nodes: DataFrame, key: str = "key") -> DataFrame:
    hubs = lib.entity.filter(F.col("type").isin(*HUB_TYPES)).select(F.col("key").alias(key))
    return nodes.join(hubs, key, "left_anti")


def edge_view(lib: Library, edge_types: list[str] | None = None, include_rejected: bool = False) -> DataFrame:
    e = lib.edge if include_rejected else live(lib.edge)
    return e.filter(F.col("type").isin(*edge_types)) if edge_types else e


def pending(queue: DataFrame, kind: str | None = None, topic: str | None = None) -> DataFrame:
    out = queue.filter(F.col("status") == "pending")
    if kind:
        out = out.filter(F.col("kind") == kind)
    if topic:
        out = out.filter(F.get_json_object("payload", "$.topic") == topic)
    return out


def eligible(queue: DataFrame) -> DataFrame:
    """Topic relations always; merges only between two topics."""
    topics = F.get_json_object("payload", "$.a").startswith("topic:") & F.get_json_object("payload", "$.b").startswith("topic:")
    return queue.filter((F.col("kind") == "topic_relation") | ((F.col("kind") == "merge") & topics))


# The answers each kind of question allows.
ACTIONS = {
    "merge": ("merge", "distinct", "skip"),
    "topic_relation": ("merge", "a_is_a_b", "b_is_a_a", "distinct", "skip"),
    "contradiction": ("accept", "reject", "skip"),
    "retro_tag": ("about", "applicable_to", "none", "skip"),
    "synthesis": ("useful", "useless", "skip"),
    "suggestion": ("apply", "skip"),
}


def allowed(kind: Column, action: Column) -> Column:
    cond = F.lit(False)
    for k, actions in ACTIONS.items():
        cond = cond | ((kind == k) & action.isin(*actions))
    return cond


def applicable(queue: DataFrame, min_confidence: float) -> DataFrame:
    """Pending items whose verdict is an allowed action with enough confidence."""
    action = F.get_json_object("payload", "$.agent.action")
    conf = F.coalesce(F.get_json_object("payload", "$.agent.confidence").cast("double"), F.lit(0.0))
    return queue.filter(action.isNotNull() & (action != "skip") & allowed(F.col("kind"), action) & (conf >= min_confidence))


def summarize(entity: DataFrame, score: Column | None = None) -> DataFrame:
    s = F.round(score, 4) if score is not None else F.lit(None).cast("double")
    return entity.select("id", "key", "type", F.col("canonical_name").alias("name"), "status", "external_id",
                         s.alias("score"), "origin")


def proposal_checks(lib: Library, aliases: DataFrame, relations: DataFrame, definitions: DataFrame, misfiled: DataFrame,
                    groups: DataFrame, distinct: DataFrame) -> DataFrame:
    """(kind, id, ok): which proposals of a topic organiser may be queued.

    aliases(id, key, alias_norm), relations(id, child, parent), definitions(id, key, text, has),
    misfiled(id, src, dst, type), groups(id, child), distinct(a, b)."""
    edge = live(lib.edge)
    is_a = edge.filter("type = 'is_a'").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    either = is_a.unionByName(is_a.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    apart = distinct.select(F.col("a").alias("child"), F.col("b").alias("parent"))
    apart = apart.unionByName(apart.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    known = lib.alias.select(F.col("norm").alias("alias_norm")).distinct()
    ok_alias = aliases.filter(F.length("alias_norm").between(1, 80)).join(known, "alias_norm", "left_anti").select("id")
    topics = lib.entity.filter("type = 'topic' and status != 'rejected'").select("key")
    ok_rel = (relations.filter("child != parent").join(topics.withColumnRenamed("key", "parent"), "parent", "left_semi")
              .join(apart, ["child", "parent"], "left_anti").join(either, ["child", "parent"], "left_anti").select("id"))
    ok_def = definitions.filter(~F.col("has") & F.length("text").between(10, 400)).select("id")
    ok_mis = misfiled.join(edge.select("src", "dst", "type"), ["src", "dst", "type"], "left_semi").select("id")
    ok_grp = groups.groupBy("id").agg(F.countDistinct("child").alias("n")).filter("n >= 2").select("id")
    parts = (("alias", aliases, ok_alias), ("relation", relations, ok_rel), ("definition", definitions, ok_def),
             ("misfiled", misfiled, ok_mis), ("group", groups.select("id").distinct(), ok_grp))
    out = None
    for kind, asked, ok in parts:
        one = asked.select("id").join(ok.distinct().withColumn("ok", F.lit(True)), "id", "left").select(
            F.lit(kind).alias("kind"), "id", F.coalesce("ok", F.lit(False)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out
