"""Registered aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_ascii
from ..model import SOURCE_EDGES, TOPIC_EDGES
from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import lookups as lk
from ..operators import rollups as ru
from ..sources import star
from .q_joins import PROBED, probe_works
from .registry import NORM, register

SRC = "('proposes','uses','produces','evaluates','supports','contradicts')"
TAGGED = "type IN ('about','applicable_to') AND status<>'rejected'"


def region_members(t):
    lib = t.library
    sub = gr.topic_subtree(lib, lib.entity.filter("key = 'topic:r1'").select("key"))
    return ru.members(lib, sub)


@register("a01_topic_size_by_type", f"""
    SELECT e.dst AS key, count(*) FILTER (n.type='work')::BIGINT AS work, count(*) FILTER (n.type='dataset')::BIGINT AS dataset,
      count(*) FILTER (n.type='method')::BIGINT AS method, count(*) FILTER (n.type='idea')::BIGINT AS idea,
      count(*) FILTER (n.type='claim')::BIGINT AS claim
    FROM edg e JOIN ent n ON n.key=e.src WHERE e.type IN ('about','applicable_to') AND e.status<>'rejected' GROUP BY 1""")
def _(t):
    types = ["work", "dataset", "method", "idea", "claim"]
    return ru.topic_sizes(t.library).groupBy("key").pivot("type", types).agg(F.sum("n")).fillna(0, types)


@register("a02_topic_members", """SELECT key, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT via) AS works FROM mem GROUP BY key""")
def _(t):
    return ru.member_rollup(region_members(t))


@register("a03_role_having", """SELECT key, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT via) AS works FROM mem
    GROUP BY key HAVING sum(CASE WHEN role='contradicts' THEN 1 ELSE 0 END)>0""")
def _(t):
    return ru.member_rollup(region_members(t), "contradicts")


@register("a04_contested", """SELECT key, EXISTS (SELECT 1 FROM edg e WHERE e.dst=n.key AND e.type='contradicts' AND e.status<>'rejected') AS contested
    FROM ent n WHERE type='claim'""")
def _(t):
    lib = t.library
    return lib.entity.filter("type = 'claim'").select("key").join(ru.contested(lib), "key", "left").fillna(False, ["contested"])


@register("a05_column_totals", """SELECT n.type, count(*) AS n FROM (SELECT DISTINCT key FROM mem) m JOIN ent n ON n.key=m.key
    WHERE n.status<>'rejected' AND n.type IN ('dataset','method','idea','claim','work') GROUP BY 1""")
def _(t):
    lib = t.library
    m = region_members(t).select("key").distinct()
    e = fl.not_rejected(lib.entity).filter("type in ('dataset','method','idea','claim','work')")
    return e.join(m, "key", "left_semi").groupBy("type").agg(F.count("*").alias("n"))


@register("a06_promote_topics", f"""
    WITH up AS (SELECT e.dst FROM edg e JOIN ent n ON n.key=e.dst AND n.type='topic' AND n.status='candidate' JOIN ent w ON w.key=e.src AND w.type='work'
      WHERE e.type IN ('about','applicable_to') AND e.status<>'rejected' GROUP BY 1 HAVING count(DISTINCT e.src)>=560)
    SELECT key, CASE WHEN key IN (SELECT dst FROM up) THEN 'active' ELSE status END AS status FROM ent WHERE type='topic'""")
def _(t):
    return ru.promote(t.library, 560).filter("type = 'topic'").select("key", "status")


@register("a07_edge_counts", """SELECT key, type, count(*) AS n FROM (SELECT src AS key, type FROM edg UNION ALL SELECT dst, type FROM edg) GROUP BY 1,2""")
def _(t):
    return lk.edge_counts(t.library)


@register("a08_home_stats", """
    SELECT 'entities' AS what, type AS name, count(*) AS n FROM ent GROUP BY type
    UNION ALL SELECT 'week', type, count(*) FROM ent WHERE created_at>=TIMESTAMP '2000-03-08' AND status<>'rejected' GROUP BY type
    UNION ALL SELECT 'queue', coalesce(kind,'total'), count(*) FROM que WHERE status='pending' GROUP BY ROLLUP (kind)
    UNION ALL SELECT 'edges', 'total', count(*) FROM edg""")
def _(t):
    return ru.home_stats(t.library, star.queue(t), F.expr("timestamp '2000-03-15 00:00:00'"))


@register("a09_recent_works", f"""
    WITH top AS (SELECT key, id FROM ent WHERE type='work' AND status<>'rejected' ORDER BY id DESC LIMIT 5),
    br AS (SELECT e.src AS key, n.type, count(*) AS n FROM edg e JOIN ent n ON n.key=e.dst WHERE e.type IN {SRC} AND e.status<>'rejected'
      AND e.src IN (SELECT key FROM top) GROUP BY 1,2),
    ex AS (SELECT 'work:'||l_orderkey AS key, max_by(l_returnflag, l_partkey) AS depth FROM lineitem GROUP BY 1)
    SELECT top.key, coalesce(type,'') AS type, coalesce(n,0) AS n, coalesce(depth,'') AS depth FROM top LEFT JOIN br USING (key) LEFT JOIN ex USING (key)""")
def _(t):
    exports = t.lineitem.selectExpr("l_partkey id", "concat('work:', l_orderkey) work_key", "l_returnflag depth")
    return ru.recent_works(t.library, exports).select("key", F.coalesce("type", F.lit("")).alias("type"),
                                                      F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("depth", F.lit("")).alias("depth"))


SHARED = f"""mine AS (SELECT DISTINCT e.src AS probe, e.dst FROM edg e JOIN ent n ON n.key=e.dst WHERE e.status<>'rejected'
       AND n.type IN ('topic','dataset','method') AND e.src IN {PROBED}),
    sh AS (SELECT probe, mine.dst, e.src AS other, e.type FROM mine JOIN edg e ON e.dst=mine.dst AND e.status<>'rejected' AND e.src<>probe)"""


@register("a10_degree_damping", f"""WITH {SHARED}, deg AS (SELECT probe, dst, count(*) AS d FROM sh GROUP BY 1,2),
    one AS (SELECT DISTINCT probe, dst, other FROM sh)
    SELECT probe, other, round(sum(0.5/ln(2+d)),4) AS score FROM one JOIN deg USING (probe, dst) GROUP BY 1,2""")
def _(t):
    lib = t.library
    return ru.damped_sharing(lib, probe_works(lib)).select("probe", "other", F.round("score", 4).alias("score"))


@register("a11_best_per_dimension", """
    WITH h AS (SELECT l_suppkey AS probe, l_orderkey AS other, p_type AS dimension, l_extendedprice/71234.567 AS rel
      FROM lineitem JOIN part ON p_partkey=l_partkey),
    b AS (SELECT probe, other, dimension, max(rel) AS rel FROM h GROUP BY 1,2,3)
    SELECT probe, other, round(sum(rel),4) AS score, count(*) AS dims FROM b GROUP BY 1,2""")
def _(t):
    h = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).selectExpr(
        "l_suppkey probe", "l_orderkey other", "p_type dimension", "l_extendedprice / 71234.567D rel", "p_name mine", "p_brand theirs")
    return ru.best_per_dimension(h).groupBy("probe", "other").agg(F.round(F.sum("rel"), 4).alias("score"), F.count("*").alias("dims"))


@register("a13_term_hits", """SELECT entity_key AS key, sum(CASE WHEN contains(norm,'re') THEN 1 ELSE 0 END+CASE WHEN contains(norm,'bo') THEN 1 ELSE 0 END
    +CASE WHEN contains(norm,'na') THEN 1 ELSE 0 END)::BIGINT AS hits FROM als GROUP BY 1 HAVING hits>0""")
def _(t):
    return ru.term_hits(t.library, ["re", "bo", "na"])


FOLD = """st AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type, (l_orderkey%4)::BIGINT AS extraction_id, round(1-l_discount,2) AS confidence,
      CASE WHEN l_tax<0.05 THEN NULL ELSE 'q'||l_quantity::INT END AS evidence, l_orderkey*8+l_linenumber AS seq,
      CASE WHEN l_discount=0 THEN 2 WHEN l_linestatus='F' THEN 1 ELSE 0 END AS rank FROM lineitem),
    pe AS (SELECT src, dst, type, extraction_id, max(confidence) AS confidence, min(rank) AS lo, max(rank) AS rank,
      min_by(evidence, CASE WHEN evidence IS NOT NULL THEN (seq, evidence) END) AS evidence FROM st GROUP BY 1,2,3,4)"""


def line_statements(t):
    return t.lineitem.selectExpr(
        "l_partkey src", "l_suppkey dst", "l_returnflag type", "l_orderkey % 4 extraction_id", "round(1 - l_discount, 2) confidence",
        "if(l_tax < 0.05, null, concat('q', cast(l_quantity as int))) evidence",
        "struct(l_orderkey * 8 + l_linenumber as a, cast(l_quantity as int) as b) seq",
        "case when l_discount = 0 then 2 when l_linestatus = 'F' then 1 else 0 end rank")


@register("a14_edge_fold", f"""WITH {FOLD}
    SELECT src, dst, type, max(extraction_id) AS extraction_id, max_by(confidence, extraction_id) AS confidence,
      coalesce(arg_max_null(evidence, extraction_id),'') AS evidence, max(rank)::INT AS rank, count(*)-1 AS records FROM pe GROUP BY 1,2,3""")
def _(t):
    return ru.fold_statements(line_statements(t)).withColumn("evidence", F.coalesce("evidence", F.lit("")))


@register("a14_evidence_records", f"""WITH {FOLD}
    SELECT src, dst, type, extraction_id, confidence, coalesce(evidence,'') AS evidence FROM pe
    WHERE extraction_id < (SELECT max(extraction_id) FROM pe q WHERE q.src=pe.src AND q.dst=pe.dst AND q.type=pe.type)""")
def _(t):
    return ru.evidence_records(line_statements(t)).withColumn("evidence", F.coalesce("evidence", F.lit("")))


@register("a15_first_value_fill", """
    WITH v AS (SELECT p_brand AS key, a.attr, CASE a.attr WHEN 'tissue' THEN CASE WHEN p_size%3=0 THEN '' ELSE p_name END WHEN 'scale' THEN p_type
      ELSE p_brand END AS value, p_partkey AS seq FROM part, (VALUES ('tissue'),('scale'),('origin')) a(attr))
    SELECT key, attr, min_by(value, seq) AS value FROM v WHERE trim(value)<>'' AND attr NOT IN ('origin','weight') GROUP BY 1,2""")
def _(t):
    v = t.part.selectExpr("p_brand key", "p_partkey seq", "stack(3, 'tissue', if(p_size % 3 = 0, '', p_name), 'scale', p_type, 'origin', p_brand) as (attr, value)")
    return ru.filled(v)


REP = f"""v AS (SELECT p_brand AS key, 'tissue' AS attr, CASE WHEN p_size%2=0 THEN upper(p_type) ELSE p_type||' ' END AS value, p_type='PROMO' AS producer, p_partkey AS seq FROM part
      UNION ALL SELECT p_type, 'scale', p_name, p_size>45, p_partkey FROM part),
    w AS (SELECT *, {NORM.format('value')} AS nv FROM v),
    f AS (SELECT key, attr, min_by(value, seq) AS fv, min_by(nv, seq) AS fn FROM w GROUP BY 1,2)"""


def report_rows(t):
    rows = (t.part.selectExpr("p_brand key", "'tissue' attr", "if(p_size % 2 = 0, upper(p_type), concat(p_type, ' ')) value", "p_type = 'PROMO' producer", "p_partkey seq")
            .unionByName(t.part.selectExpr("p_type key", "'scale' attr", "p_name value", "p_size > 45 producer", "p_partkey seq")))
    return rows.withColumn("normed", norm_ascii(F.col("value")))


@register("a16_reported_values", f"""WITH {REP}
    SELECT w.key, w.attr, coalesce(min_by(value, seq) FILTER (producer AND nv<>fn), any_value(fv)) AS value,
      coalesce(min_by(value, seq) FILTER (producer AND nv<>fn),'') AS producer, count(DISTINCT nv) AS "distinct" FROM w JOIN f USING (key, attr) GROUP BY 1,2""")
def _(t):
    return ru.reported(report_rows(t)).withColumn("producer", F.coalesce("producer", F.lit("")))


@register("a16_reported_lists", f"""WITH {REP}, d AS (SELECT key, attr, nv, min_by(value, seq) AS value, min(seq) AS seq FROM w GROUP BY 1,2,3)
    SELECT key, attr, value, seq FROM d WHERE (key, attr) IN (SELECT (key, attr) FROM d GROUP BY key, attr HAVING count(*)>1)""")
def _(t):
    return ru.reported_values(report_rows(t))


@register("a17_work_merge", """
    SELECT o_custkey AS key, max(substr(o_orderpriority,1,1)::INT) AS tier,
      coalesce(min_by(year(o_orderdate), o_orderkey) FILTER (o_orderstatus<>'P'),-1)::BIGINT AS year,
      coalesce(min_by('m'||o_orderkey, o_orderkey) FILTER (o_orderstatus='F'),'') AS metadata_id,
      count(DISTINCT round(o_totalprice/50000)::INT) AS dois FROM orders GROUP BY 1""")
def _(t):
    rows = t.orders.selectExpr("o_custkey key", "cast(cast(round(o_totalprice / 50000) as int) as string) doi", "cast(substring(o_orderpriority, 1, 1) as int) tier",
                               "if(o_orderstatus = 'P', null, year(o_orderdate)) year", "if(o_orderstatus = 'F', concat('m', o_orderkey), null) metadata_id", "o_orderkey seq")
    return ru.merged_works(rows).select("key", "tier", F.coalesce("year", F.lit(-1)).cast("long").alias("year"), F.coalesce("metadata_id", F.lit("")).alias("metadata_id"), "dois")


@register("a19_queue_counts", "SELECT coalesce(kind,'total') AS kind, count(*) AS n FROM que WHERE status='pending' GROUP BY ROLLUP (kind)")
def _(t):
    return ru.queue_counts(star.queue(t))


@register("a20_agent_counts", """
    WITH v AS (SELECT id, kind, json_extract_string(payload,'$.agent.action') AS act, coalesce(json_extract_string(payload,'$.agent.confidence')::DOUBLE,0) AS conf
      FROM que WHERE status='pending' AND (kind='topic_relation' OR (kind='merge' AND json_extract_string(payload,'$.a') LIKE 'topic:%'
        AND json_extract_string(payload,'$.b') LIKE 'topic:%')))
    SELECT 'unjudged' AS what, 'all' AS name, count(*) AS n FROM v WHERE act IS NULL
    UNION ALL SELECT 'apply', act, count(*) FROM v WHERE act<>'skip' AND conf>=3 AND ((kind='merge' AND act IN ('merge','distinct'))
      OR (kind='topic_relation' AND act IN ('merge','a_is_a_b','b_is_a_a','distinct'))) GROUP BY act""")
def _(t):
    return ru.agent_counts(star.queue(t), 3)


@register("a23_topics_by_size", """
    WITH n AS (SELECT dst, count(*) AS n FROM edg WHERE type IN ('about','applicable_to') AND status<>'rejected' GROUP BY 1),
    p AS (SELECT e.src, count(*) AS parents, min(canonical_name) AS first_parent FROM edg e JOIN ent d ON d.key=e.dst WHERE e.type='is_a' AND e.status<>'rejected' GROUP BY 1)
    SELECT key, status, coalesce(n,0) AS n, coalesce(parents,0) AS parents, coalesce(first_parent,'') AS first_parent FROM ent
    LEFT JOIN n ON n.dst=key LEFT JOIN p ON p.src=key WHERE ent.type='topic' AND status<>'rejected'""")
def _(t):
    return ru.topics_with_size(t.library.with_(edge=t.library.edge_of("about", "applicable_to", "is_a")))


@register("a24_papers_per_topic", """SELECT e.dst AS key, count(DISTINCT e.src) AS papers FROM edg e JOIN ent w ON w.key=e.src AND w.type='work'
    WHERE e.type IN ('about','applicable_to') AND e.status<>'rejected' GROUP BY 1""")
def _(t):
    return ru.papers_per_topic(t.library)


@register("a25_topic_changes", f"""
    WITH oo AS (SELECT e.src, e.created_at>=TIMESTAMP '2001-01-01' AS isnew, w.key IS NOT NULL AS is_work FROM edg e JOIN sub s ON s.key=e.dst
      LEFT JOIN ent w ON w.key=e.src AND w.type='work' WHERE e.status<>'rejected'),
    br AS (SELECT type FROM edg WHERE status<>'rejected' AND type IN {SRC} AND src IN (SELECT src FROM oo WHERE isnew AND is_work))
    SELECT count(*) FILTER (isnew AND is_work) AS new_work_rows, count(*) FILTER (isnew AND NOT is_work) AS new_direct,
      count(DISTINCT CASE WHEN is_work THEN src END) AS works_total, (SELECT count(*) FROM br) AS new_assets,
      (SELECT count(*) FROM br WHERE type='contradicts') AS contradictions FROM oo""")
def _(t):
    lib = t.library
    sub = gr.topic_subtree(lib.with_(edge=lib.edge_of("is_a")), lib.entity.filter("key = 'topic:r1'").select("key")).select("key")
    return ru.topic_changes(lib, sub, lib.edge_to(sub, "is_a", *TOPIC_EDGES), F.expr("timestamp '2001-01-01 00:00:00'"), lambda works: lib.edge_from(works, *SOURCE_EDGES))


@register("a26_topic_info", """
    WITH oo AS (SELECT n.key, n.type FROM ent n WHERE n.status<>'rejected' AND n.key IN (SELECT src FROM edg WHERE type IN ('about','applicable_to')
      AND status<>'rejected' AND dst='topic:s7'))
    SELECT 'n:'||type AS what, count(*)::VARCHAR AS name FROM oo GROUP BY type
    UNION ALL SELECT * FROM (SELECT 'paper', key FROM oo WHERE type='work' ORDER BY key LIMIT 6)
    UNION ALL SELECT * FROM (SELECT 'asset', key FROM oo WHERE type<>'work' ORDER BY key LIMIT 10)
    UNION ALL SELECT 'parent', dst FROM edg WHERE type='is_a' AND status<>'rejected' AND src='topic:s7'
    UNION ALL SELECT 'child', src FROM edg WHERE type='is_a' AND status<>'rejected' AND dst='topic:s7'""")
def _(t):
    return ru.topic_info(t.library, "topic:s7")


@register("a27_view_log", """
    WITH st AS (SELECT entity_key, max(ts) AS m, count(*) AS n FROM vlg WHERE ts<TIMESTAMP '2024-01-15' GROUP BY 1),
    nw AS (SELECT entity_key, max(ts) AS m, count(*) AS n FROM vlg WHERE ts>=TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT entity_key, strftime(max(m),'%Y-%m-%d %H:%M:%S') AS last_seen, sum(n)::BIGINT AS count FROM (SELECT * FROM st UNION ALL SELECT * FROM nw) GROUP BY 1""")
def _(t):
    v = star.views_log(t)
    at = F.expr("timestamp '2024-01-15 00:00:00'")
    stored = ru.view_log(v.filter(F.col("ts") < at))
    return ru.view_log(v.filter(F.col("ts") >= at), stored).select("entity_key", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "count")


@register("a28_status_distribution", "SELECT status, count(*) AS n FROM ent WHERE type='topic' GROUP BY 1")
def _(t):
    return t.library.entity.filter("type = 'topic'").groupBy("status").agg(F.count("*").alias("n"))


@register("a29_degree_and_merge_direction", """
    WITH d AS (SELECT key, count(*) AS degree FROM (SELECT src AS key FROM edg WHERE status<>'rejected' UNION ALL SELECT dst FROM edg WHERE status<>'rejected') GROUP BY 1),
    p AS (SELECT DISTINCT json_extract_string(payload,'$.a') AS a, json_extract_string(payload,'$.b') AS b FROM que WHERE kind='merge'),
    s AS (SELECT p.a, p.b, coalesce(x.degree,0) AS da, coalesce(y.degree,0) AS db FROM p LEFT JOIN d x ON x.key=p.a LEFT JOIN d y ON y.key=p.b)
    SELECT a, b, CASE WHEN db>da OR (db=da AND b<a) THEN a ELSE b END AS from_key, CASE WHEN db>da OR (db=da AND b<a) THEN b ELSE a END AS into_key FROM s""")
def _(t):
    pairs = star.queue(t).filter("kind = 'merge'").select(F.get_json_object("payload", "$.a").alias("a"), F.get_json_object("payload", "$.b").alias("b")).distinct()
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    return ru.merge_direction(t.library.with_(edge=t.library.edge_at(keys)), pairs)


@register("a30_index_models", """SELECT count(DISTINCT 'd'||len(embedding)) AS models, CASE count(DISTINCT 'd'||len(embedding)) WHEN 0 THEN 'empty' WHEN 1 THEN 'one'
    ELSE 'mixed' END AS state, min('d'||len(embedding)) AS name FROM embeddings""")
def _(t):
    return ru.index_models(t.embeddings.select(F.concat(F.lit("d"), F.size("embedding")).alias("model")))


@register("a31_suspect_ids", """SELECT DISTINCT l_orderkey AS key, 'x'||l_suppkey AS suspect FROM lineitem WHERE l_tax=0.08""")
def _(t):
    return t.lineitem.filter("l_tax = 0.08").selectExpr("l_orderkey key", "explode(array(concat('x', l_suppkey))) suspect").distinct()


@register("a32_insight_links", """SELECT DISTINCT 'idea:'||e.user_id AS key, n.key AS link, n.canonical_name AS name, false AS unresolved FROM events e
      JOIN ent n ON n.key='topic:s'||json_extract_string(props,'$.k') WHERE e.event_type='purchase'
    UNION ALL SELECT DISTINCT 'idea:'||user_id, 'topic:s'||json_extract_string(props,'$.k'), '', true FROM events
      WHERE event_type='purchase' AND 'topic:s'||json_extract_string(props,'$.k') NOT IN (SELECT key FROM ent)""")
def _(t):
    links = t.events.filter("event_type = 'purchase'").selectExpr("concat('idea:', user_id) key", "concat('topic:s', get_json_object(props, '$.k')) link").distinct()
    names = t.library.entity.select(F.col("key").alias("link"), F.col("canonical_name").alias("name"))
    return links.join(names, "link", "left").select("key", "link", F.coalesce("name", F.lit("")).alias("name"), F.col("name").isNull().alias("unresolved"))


@register("a33_batch_counts", """SELECT source AS batch, count(*) FILTER (quality=1) AS ok, count(*) FILTER (quality=0) AS failed,
    count(*) FILTER (quality IS NULL) AS remaining FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy(F.col("source").alias("batch")).agg(
        F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") == 0).alias("failed"),
        F.count_if(F.col("quality").isNull()).alias("remaining"))
