"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import lookups as lk
from ..operators import rollups as ru
from ..session import cut
from ..sources import star
from .q_joins import CITES
from .registry import register

ISA = "isa AS (SELECT src, dst FROM edg WHERE type='is_a' AND status<>'rejected')"


@register("g01_topic_subtree", f"""
    WITH RECURSIVE {ISA}, w(root, key, depth) AS (SELECT key, key, 0 FROM ent WHERE type='topic'
      UNION SELECT w.root, isa.src, w.depth+1 FROM w JOIN isa ON isa.dst=w.key) SELECT root, key, depth FROM w""")
def _(t):
    lib = t.library.with_(edge=t.library.edge_of("is_a"))
    return gr.topic_subtree(lib, lib.entity.filter("type = 'topic'").select("key"))


@register("g02_neighbors", """
    WITH le AS (SELECT src, dst FROM edg WHERE status<>'rejected'), adj AS (SELECT src AS node, dst AS other FROM le UNION ALL SELECT dst, src FROM le),
    h1 AS (SELECT DISTINCT other AS key FROM adj WHERE node='asset:5'),
    op AS (SELECT key FROM h1 JOIN ent USING (key) WHERE type NOT IN ('organism','modality') AND key<>'asset:5'),
    re AS (SELECT key FROM h1 UNION SELECT other FROM adj WHERE node IN (SELECT key FROM op))
    SELECT 'asset:5' AS center, re.key FROM re JOIN ent USING (key) WHERE status<>'rejected' AND re.key<>'asset:5'""")
def _(t):
    lib = t.library
    return gr.neighbors(lib, lib.entity.filter("key = 'asset:5'").select("key"), hops=2).select("center", "key")


@register("g02_neighbor_page", """
    WITH le AS (SELECT src, dst, type FROM edg WHERE status<>'rejected'), adj AS (SELECT src AS node, dst AS other FROM le UNION ALL SELECT dst, src FROM le),
    re AS (SELECT DISTINCT other AS key FROM adj JOIN ent ON ent.key=other WHERE node='asset:7' AND ent.status<>'rejected' AND other<>'asset:7'),
    pg AS (SELECT 'asset:7' AS key UNION ALL SELECT * FROM (SELECT key FROM re ORDER BY key LIMIT 19))
    SELECT src, dst, type, (SELECT count(*)+1 FROM re) AS total FROM le WHERE src IN (SELECT key FROM pg) AND dst IN (SELECT key FROM pg)""")
def _(t):
    lib = t.library
    center = lib.entity.filter("key = 'asset:7'").select("key")
    reach = gr.neighbors(lib, center, hops=1).select("key")
    nodes = center.unionByName(reach.orderBy("key").limit(19))
    e = gr.live(lib.edge).join(nodes.withColumnRenamed("key", "src"), "src", "left_semi").join(nodes.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return e.select("src", "dst", "type", (reach.agg(F.count("*")).scalar() + 1).alias("total"))


@register("g03_within_two_hops", """
    WITH le AS (SELECT src, dst FROM edg WHERE status<>'rejected'), adj AS (SELECT src AS node, dst AS other FROM le UNION SELECT dst, src FROM le),
    pr AS (SELECT DISTINCT json_extract_string(payload,'$.a') AS a, json_extract_string(payload,'$.b') AS b FROM que WHERE kind='merge'),
    opn AS (SELECT key FROM ent WHERE type NOT IN ('organism','modality'))
    SELECT a, b FROM pr WHERE EXISTS (SELECT 1 FROM adj WHERE node=a AND other=b)
      OR EXISTS (SELECT 1 FROM adj x JOIN adj y ON x.other=y.other WHERE x.node=a AND y.node=b AND x.other IN (SELECT key FROM opn))""")
def _(t):
    p = star.queue(t).filter("kind = 'merge'").select(F.get_json_object("payload", "$.a").alias("a"), F.get_json_object("payload", "$.b").alias("b"))
    return gr.within_two_hops(t.library, p)


@register("g04_topic_families", f"""
    WITH RECURSIVE {ISA}, nd AS (SELECT key FROM ent WHERE type='topic' AND status='active'),
    inn AS (SELECT src, dst FROM isa WHERE src IN (SELECT key FROM nd) AND dst IN (SELECT key FROM nd)),
    adj AS (SELECT src AS node, dst AS other FROM inn UNION SELECT dst, src FROM inn),
    w(key, o) AS (SELECT key, key FROM nd UNION SELECT w.key, adj.other FROM w JOIN adj ON adj.node=w.o),
    c AS (SELECT key, min(o) AS comp FROM w GROUP BY key),
    z AS (SELECT comp, row_number() OVER (ORDER BY count(*) DESC, comp)-1 AS family FROM c GROUP BY comp HAVING count(*)>=2)
    SELECT key, coalesce(family,-1) AS family FROM c LEFT JOIN z USING (comp)""")
def _(t):
    lib = t.library
    is_a = gr.live(lib.edge_of("is_a"))
    fam = gr.families(lib.entity.filter("type = 'topic' and status = 'active'").select("key"), is_a.select("src", "dst"))
    return fam.select("key", F.coalesce("family", F.lit(-1)).cast("long").alias("family"))


def cited_library(t):
    """Papers linked by citations, and the topic tree."""
    lib = t.library
    tree = lib.edge_of("is_a")
    cites = lk.citations(t.events.selectExpr("cast(user_id as string) id", "array(get_json_object(props, '$.k')) referenced_works"),
                         t.events.selectExpr("cast(user_id as string) metadata_id", "concat('work:', user_id) key").distinct())
    return lib.with_(edge=tree.select("src", "dst", "status").unionByName(cites.withColumn("status", F.lit("auto"))))


CITED = f"""{CITES}, nd AS (SELECT key FROM ent WHERE type NOT IN ('organism','modality')),
    ce AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edg WHERE type='is_a' AND status<>'rejected' UNION ALL SELECT 'work:'||a, 'work:'||b FROM cit)
      WHERE src<>dst AND src IN (SELECT key FROM nd) AND dst IN (SELECT key FROM nd))"""


@register("g05_communities", f"""WITH {CITED}, an AS (SELECT src AS key FROM ce UNION SELECT dst FROM ce)
    SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM an) AS linked, (SELECT count(*) FROM an) AS settled, (SELECT count(*) FROM nd WHERE key NOT IN (SELECT key FROM an)) AS alone""")
def _(t):
    """The certificate of the communities: every linked node is in one that most of its neighbours are in, and every
    other node is in one of its own."""
    lib = cited_library(t)
    links = gr.community_links(lib)
    found, adj = cut(gr.communities(lib, links)), links[1]
    inside = adj.join(found.select(F.col("key").alias("other"), "community"), "other").groupBy(F.col("node").alias("key"), "community").agg(F.count("*").alias("v"))
    most = inside.groupBy("key").agg(F.max("v").alias("most"))
    size = found.groupBy("community").agg(F.count("*").alias("n"))
    checked = found.join(most, "key", "left").join(inside, ["key", "community"], "left").join(size, "community")
    return checked.agg(F.count("*").alias("nodes"), F.count("most").alias("linked"), F.count_if(F.col("v") == F.col("most")).alias("settled"),
                       F.count_if(F.col("most").isNull() & (F.col("n") == 1)).alias("alone"))


@register("g06_components", f"""
    WITH RECURSIVE {CITES}, pr AS (SELECT a, b FROM cit WHERE (a+b)%17=0), adj AS (SELECT a AS node, b AS other FROM pr UNION SELECT b, a FROM pr),
    nd AS (SELECT DISTINCT user_id AS key FROM events), w(key, o) AS (SELECT key, key FROM nd UNION SELECT w.key, other FROM w JOIN adj ON node=w.o)
    SELECT key, min(o) AS component FROM w GROUP BY key""")
def _(t):
    nodes = t.events.selectExpr("user_id key").distinct()
    k = F.get_json_object("props", "$.k").cast("long")
    pairs = t.events.select(F.col("user_id").alias("a"), k.alias("b")).filter("a != b and (a + b) % 17 = 0")
    return gr.components(nodes, pairs.join(nodes.withColumnRenamed("key", "b"), "b", "left_semi"))


@register("g09_delete_cascade", """
    WITH gone AS (SELECT key FROM ent WHERE type='method' AND status='rejected')
    SELECT 'entity' AS what, count(*) AS n FROM ent WHERE key NOT IN (SELECT key FROM gone)
    UNION ALL SELECT 'alias', count(*) FROM als WHERE entity_key NOT IN (SELECT key FROM gone)
    UNION ALL SELECT 'work', count(*) FROM wrk WHERE entity_key NOT IN (SELECT key FROM gone)
    UNION ALL SELECT 'edge', count(*) FROM edg WHERE src NOT IN (SELECT key FROM gone) AND dst NOT IN (SELECT key FROM gone)""")
def _(t):
    from ..operators.corrections import delete_entities
    lib = t.library
    out = delete_entities(lib, lib.entity.filter("type = 'method' and status = 'rejected'").select("key"))
    return (out.entity.agg(F.count("*").alias("n")).select(F.lit("entity").alias("what"), "n")
            .unionByName(out.alias.agg(F.count("*").alias("n")).select(F.lit("alias").alias("what"), "n"))
            .unionByName(out.work.agg(F.count("*").alias("n")).select(F.lit("work").alias("what"), "n"))
            .unionByName(out.edge.agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "n")))


@register("g10_parents_children", """SELECT 'parent' AS what, src AS key, dst AS other FROM edg WHERE type='is_a' AND status<>'rejected'
    UNION ALL SELECT 'child', dst, src FROM edg WHERE type='is_a' AND status<>'rejected'""")
def _(t):
    lib = t.library.with_(edge=t.library.edge_of("is_a"))
    return (gr.one_hop(lib, "is_a", True).select(F.lit("parent").alias("what"), "key", "other")
            .unionByName(gr.one_hop(lib, "is_a", False).select(F.lit("child").alias("what"), "key", "other")))


@register("g11_topic_map", f"""
    WITH RECURSIVE {ISA}, sz AS (SELECT n.key, count(e.src) AS size FROM ent n LEFT JOIN edg e ON e.dst=n.key AND e.type IN ('about','applicable_to') AND e.status<>'rejected'
       WHERE n.type='topic' AND n.status='active' GROUP BY 1),
    nd AS (SELECT key, size FROM sz ORDER BY size DESC, key LIMIT 90),
    inn AS (SELECT src, dst FROM isa WHERE src IN (SELECT key FROM nd) AND dst IN (SELECT key FROM nd)),
    adj AS (SELECT src AS node, dst AS other FROM inn UNION SELECT dst, src FROM inn),
    w(key, o) AS (SELECT key, key FROM nd UNION SELECT w.key, adj.other FROM w JOIN adj ON adj.node=w.o),
    c AS (SELECT key, min(o) AS comp FROM w GROUP BY key),
    z AS (SELECT comp, row_number() OVER (ORDER BY count(*) DESC, comp)-1 AS family FROM c GROUP BY comp HAVING count(*)>=2)
    SELECT 'node' AS what, nd.key AS a, '' AS b, size AS n, coalesce(family,-1) AS family FROM nd JOIN c USING (key) LEFT JOIN z USING (comp)
    UNION ALL SELECT 'edge', src, dst, 0, -1 FROM inn""")
def _(t):
    nodes, edges = topic_map(t.library, 90)
    return (nodes.select(F.lit("node").alias("what"), F.col("key").alias("a"), F.lit("").alias("b"), F.col("size").alias("n"),
                         F.coalesce("family", F.lit(-1)).cast("long").alias("family"))
            .unionByName(edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"),
                                      F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("family"))))


def topic_map(lib, budget: int = 250, include_candidates: bool = False):
    """(nodes, edges): the largest topics, their families and the is_a links among them."""
    keep = ("active", "candidate") if include_candidates else ("active",)
    n = ru.tagged(lib).groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("size"))
    topics = lib.entity.filter((F.col("type") == "topic") & F.col("status").isin(*keep)).select("key").join(n, "key", "left").fillna(0, ["size"])
    nodes = gr.cut(topics.orderBy(F.desc("size"), "key").limit(budget))
    is_a = fl.not_rejected(lib.edge).filter("type = 'is_a'").select("src", "dst")
    inside = (is_a.join(nodes.select(F.col("key").alias("src")), "src", "left_semi")
              .join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi"))
    return nodes.join(gr.families(nodes.select("key"), inside), "key"), inside
