"""Registered filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..sources import star
from .registry import register

SRC = "('proposes','uses','produces','evaluates','supports','contradicts')"
SIX = "('work','dataset','method','idea','claim','topic')"


@register("f01_type_filter", f"SELECT key, type FROM ent WHERE type IN {SIX}")
def _(t):
    return fl.of_types(t.library.entity).select("key", "type")


@register("f02_hide_rejected", f"""
    SELECT 'entity' AS what, key AS a, '' AS b, type FROM ent WHERE status<>'rejected'
    UNION ALL SELECT 'edge', e.src, e.dst, e.type FROM edg e JOIN ent s ON s.key=e.src JOIN ent d ON d.key=e.dst
      WHERE e.status<>'rejected' AND s.status<>'rejected' AND d.status<>'rejected' AND e.type IN {SRC}""")
def _(t):
    lib = t.library
    keep = fl.not_rejected(lib.entity)
    e = (fl.source_edges(lib).join(keep.select(F.col("key").alias("src")), "src", "left_semi")
         .join(keep.select(F.col("key").alias("dst")), "dst", "left_semi"))
    return (keep.select(F.lit("entity").alias("what"), F.col("key").alias("a"), F.lit("").alias("b"), "type")
            .unionByName(e.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), "type")))


@register("f03_candidate_toggle", f"SELECT key, status FROM ent WHERE type IN {SIX} AND status NOT IN ('candidate','rejected')")
def _(t):
    return fl.without_candidates(fl.not_rejected(fl.of_types(t.library.entity))).select("key", "status")


@register("f04_role_filter", """SELECT key FROM ent n WHERE EXISTS
    (SELECT 1 FROM edg e WHERE e.dst=n.key AND e.type='contradicts' AND e.status<>'rejected')""")
def _(t):
    lib = t.library
    return fl.with_role(lib, lib.entity, "contradicts").select("key")


@register("f05_organism_modality_filter", f"""
    WITH org AS (SELECT e.src FROM edg e JOIN als a ON a.entity_key=e.dst JOIN ent n ON n.key=e.dst AND n.type='organism'
                 WHERE a.norm='nation 3' AND e.type='of_organism' AND e.status<>'rejected'),
    mod AS (SELECT e.src FROM edg e JOIN als a ON a.entity_key=e.dst JOIN ent n ON n.key=e.dst AND n.type='modality'
            WHERE a.norm='building' AND e.type='of_modality' AND e.status<>'rejected'),
    se AS (SELECT * FROM edg WHERE status<>'rejected' AND type IN {SRC})
    SELECT key, type FROM ent n WHERE type IN {SIX} AND status<>'rejected'
      AND (key IN (SELECT src FROM org) OR key IN (SELECT dst FROM se WHERE src IN (SELECT src FROM org)))
      AND (key IN (SELECT src FROM mod) OR key IN (SELECT dst FROM se WHERE src IN (SELECT src FROM mod)))""")
def _(t):
    lib = t.library
    return fl.apply_filters(lib, lib.entity, fl.Filters(organism="Nation-3", modality="BUILDING")).select("key", "type")


@register("f06_year_tier_filter", f"""
    WITH good AS (SELECT entity_key FROM wrk WHERE year>=1996 AND year<=1996 AND tier>=5)
    SELECT key, type FROM ent WHERE type IN {SIX} AND status<>'rejected' AND (key IN (SELECT entity_key FROM good)
      OR key IN (SELECT dst FROM edg WHERE status<>'rejected' AND type IN {SRC} AND src IN (SELECT entity_key FROM good)))""")
def _(t):
    lib = t.library
    return fl.apply_filters(lib, lib.entity, fl.Filters(year_min=1996, year_max=1996, tier=5)).select("key", "type")


@register("f07_topic_subtree_filter", f"""
    WITH lk AS (SELECT e.src FROM edg e WHERE e.type IN ('about','applicable_to') AND e.status<>'rejected' AND e.dst IN (SELECT key FROM sub))
    SELECT key, type FROM ent WHERE type IN {SIX} AND status<>'rejected' AND (key IN (SELECT key FROM sub) OR key IN (SELECT src FROM lk)
      OR key IN (SELECT dst FROM edg WHERE status<>'rejected' AND type IN {SRC} AND src IN (SELECT src FROM lk)))""")
def _(t):
    lib = t.library
    return fl.apply_filters(lib, lib.entity, fl.Filters(topic="topic:r1")).select("key", "type")


@register("f08_live_cards", f"""
    SELECT c.id FROM crd c WHERE NOT c.suspended AND NOT EXISTS (SELECT 1 FROM ent n WHERE n.key=c.entity_key AND n.status='rejected')
      AND NOT EXISTS (SELECT 1 FROM ent n WHERE n.key=c.entity_key AND n.type<>'work'
        AND EXISTS (SELECT 1 FROM edg e WHERE e.dst=n.key AND e.type IN {SRC})
        AND NOT EXISTS (SELECT 1 FROM edg e WHERE e.dst=n.key AND e.type IN {SRC} AND e.status<>'rejected'))""")
def _(t):
    return fl.live_cards(t.library, star.cards(t)).select("id")


@register("f09_score_bands", """SELECT id, CASE WHEN score>=0.4 THEN 'merge' WHEN score>=0.2 THEN 'review' ELSE 'new' END AS band FROM que""")
def _(t):
    return star.queue(t).select("id", fl.band(F.col("score"), 0.4, 0.2).alias("band"))


@register("f10_relevance_floor", "SELECT id, score FROM que WHERE score>=0.35")
def _(t):
    return star.queue(t).filter(F.col("score") >= 0.35).select("id", "score")


@register("f11_hub_exclusion", """SELECT e.src, e.dst, e.type FROM edg e WHERE e.status<>'rejected' AND e.src LIKE 'work:%'
    AND NOT EXISTS (SELECT 1 FROM ent n WHERE n.key=e.dst AND n.type IN ('organism','modality'))""")
def _(t):
    lib = t.library
    e = fl.not_rejected(lib.edge).filter(F.col("src").startswith("work:"))
    return fl.without_hubs(lib, e, "dst").select("src", "dst", "type")


@register("f12_edge_view_switches", """
    SELECT 'types' AS view, src, dst, type, status FROM edg WHERE status<>'rejected' AND type IN ('is_a','contradicts')
    UNION ALL SELECT 'rejected', src, dst, type, status FROM edg WHERE type IN ('is_a','contradicts')""")
def _(t):
    lib = t.library
    cols = ["src", "dst", "type", "status"]
    a = fl.edge_view(lib, ["is_a", "contradicts"]).select(F.lit("types").alias("view"), *cols)
    return a.unionByName(fl.edge_view(lib, ["is_a", "contradicts"], True).select(F.lit("rejected").alias("view"), *cols))


@register("f13_queue_filter", """SELECT id, score FROM que WHERE status='pending' AND kind='retro_tag'
    AND json_extract_string(payload,'$.topic')='topic:n7'""")
def _(t):
    return fl.pending(star.queue(t), "retro_tag", "topic:n7").select("id", "score")


@register("f14_eligible_questions", """SELECT id, kind FROM que WHERE status='pending' AND (kind='topic_relation' OR (kind='merge'
    AND json_extract_string(payload,'$.a') LIKE 'topic:%' AND json_extract_string(payload,'$.b') LIKE 'topic:%'))""")
def _(t):
    return fl.eligible(fl.pending(star.queue(t))).select("id", "kind")


@register("f15_applicable_suggestions", """
    WITH v AS (SELECT id, kind, json_extract_string(payload,'$.agent.action') AS act,
      coalesce(json_extract_string(payload,'$.agent.confidence')::DOUBLE,0) AS conf FROM que WHERE status='pending')
    SELECT id, act AS action FROM v WHERE act IS NOT NULL AND act<>'skip' AND conf>=5 AND (
      (kind='merge' AND act IN ('merge','distinct')) OR (kind='topic_relation' AND act IN ('merge','a_is_a_b','b_is_a_a','distinct'))
      OR (kind='contradiction' AND act IN ('accept','reject')) OR (kind='retro_tag' AND act IN ('about','applicable_to','none'))
      OR (kind='synthesis' AND act IN ('useful','useless')))""")
def _(t):
    q = fl.applicable(fl.pending(star.queue(t)), 5)
    return q.select("id", F.get_json_object("payload", "$.agent.action").alias("action"))


@register("f17_proposal_checks", f"""
    WITH al AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey%3=0 THEN lower(s_name) ELSE 'other name '||s_suppkey END AS an FROM supplier),
    rel AS (SELECT c_custkey AS id, 'topic:s'||(c_custkey%100) AS child, 'topic:n'||c_nationkey AS parent FROM customer),
    def AS (SELECT p_partkey AS id, p_name||' '||p_type AS txt, p_size<10 AS has FROM part),
    mis AS (SELECT o_orderkey AS id, 'work:'||o_orderkey AS src, 'topic:s'||(o_custkey%100) AS dst FROM orders),
    grp AS (SELECT c_nationkey AS id, c_mktsegment AS child FROM customer WHERE c_acctbal>9500),
    dis AS (SELECT 'topic:s'||s_suppkey AS a, 'topic:n'||(s_suppkey%25) AS b FROM supplier WHERE s_suppkey%7=0),
    isa AS (SELECT src, dst FROM edg WHERE type='is_a' AND status<>'rejected'),
    norms AS (SELECT {"trim(regexp_replace(an,'[#\\s]+',' ','g'))"} AS x, id FROM al)
    SELECT 'alias' AS kind, id, NOT EXISTS (SELECT 1 FROM als WHERE als.norm=al.an) AS ok FROM al
    UNION ALL SELECT 'relation', r.id, parent IN (SELECT key FROM ent WHERE type='topic' AND status<>'rejected')
      AND NOT EXISTS (SELECT 1 FROM dis WHERE a=child AND b=parent)
      AND NOT EXISTS (SELECT 1 FROM isa WHERE (src=child AND dst=parent) OR (src=parent AND dst=child)) FROM rel r
    UNION ALL SELECT 'definition', id, NOT has AND length(txt) BETWEEN 10 AND 400 FROM def
    UNION ALL SELECT 'misfiled', m.id, EXISTS (SELECT 1 FROM edg e WHERE e.src=m.src AND e.dst=m.dst AND e.type='about' AND e.status<>'rejected') FROM mis m
    UNION ALL SELECT 'group', id, count(DISTINCT child)>=2 FROM grp GROUP BY id""")
def _(t):
    al = t.supplier.selectExpr("s_suppkey id", "'' key", "if(s_suppkey % 3 = 0, lower(s_name), concat('other name ', s_suppkey)) alias_norm")
    rel = t.customer.selectExpr("c_custkey id", "concat('topic:s', c_custkey % 100) child", "concat('topic:n', c_nationkey) parent")
    de = t.part.selectExpr("p_partkey id", "'' key", "concat(p_name, ' ', p_type) text", "p_size < 10 has")
    mis = t.orders.selectExpr("o_orderkey id", "concat('work:', o_orderkey) src", "concat('topic:s', o_custkey % 100) dst", "'about' type")
    grp = t.customer.filter("c_acctbal > 9500").selectExpr("cast(c_nationkey as bigint) id", "c_mktsegment child")
    dis = t.supplier.filter("s_suppkey % 7 = 0").selectExpr("concat('topic:s', s_suppkey) a", "concat('topic:n', s_suppkey % 25) b")
    return fl.proposal_checks(t.library, al, rel, de, mis, grp, dis)


@register("f18_result_projection", """SELECT id, key, type, canonical_name AS name, status, external_id, round(id/7.0,4) AS score, origin
    FROM ent WHERE type='dataset'""")
def _(t):
    e = t.library.entity.filter("type = 'dataset'")
    return fl.summarize(e, F.col("id") / 7.0)
