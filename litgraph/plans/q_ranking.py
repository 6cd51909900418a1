"""Registered window, paging and set queries, and the topic page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import graph as gr
from ..operators import lookups as lk
from ..operators import ranking as rk
from ..operators import rollups as ru
from ..sources import star
from .q_joins import merges
from .registry import register

SRC = "('proposes','uses','produces','evaluates','supports','contradicts')"

PAGE = """
    WITH con AS (SELECT DISTINCT dst FROM edg WHERE type='contradicts' AND status<>'rejected'),
    agg AS (SELECT key, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT via) AS works FROM mem GROUP BY key),
    r AS (SELECT n.type, n.key, n.canonical_name AS name, roles, works, year, n.key IN (SELECT dst FROM con) AS contested FROM ent n JOIN agg ON agg.key=n.key
      LEFT JOIN wrk w ON w.entity_key=n.key WHERE n.status<>'rejected' AND n.type IN ('dataset','method','idea','claim','work')),
    k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN type='claim' AND contested THEN 0 ELSE 1 END,
      CASE WHEN type='work' THEN -year ELSE -works END, name, key) AS rn FROM r)
    SELECT type, rn, key, name, roles, CASE WHEN type='work' AND works=0 THEN 1 ELSE works END AS works, coalesce(year,-1) AS year, contested FROM k WHERE rn<=150"""


@register("topic_page", PAGE)
def _(t):
    return rk.topic_page(t.library, "topic:r1")


@register("w01_first_edges_per_type", """
    WITH ends AS (SELECT src AS node, dst AS other, 'out' AS direction, type, status, created_at FROM edg
      UNION ALL SELECT dst, src, 'in', type, status, created_at FROM edg)
    SELECT node, direction, type, rn, other, status FROM (SELECT *, row_number() OVER (PARTITION BY node, direction, type ORDER BY
      CASE status WHEN 'confirmed' THEN 0 WHEN 'auto' THEN 1 ELSE 2 END, created_at, node, other) AS rn FROM ends) WHERE rn>5 AND rn<=55""")
def _(t):
    return lk.edge_pages(t.library, limit=50, offset=5).select("node", "direction", "type", "rn", "other", "status")


@register("w02_best_candidate", """SELECT p_partkey, l_suppkey, score FROM (SELECT l_partkey AS p_partkey, l_suppkey, max(l_extendedprice) AS score,
    row_number() OVER (PARTITION BY l_partkey ORDER BY max(l_extendedprice) DESC, l_suppkey) AS rn FROM lineitem GROUP BY 1,2) WHERE rn=1""")
def _(t):
    c = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
    return rk.top_per(c, ["p_partkey"], [F.desc("score"), F.col("l_suppkey")], 1).drop("rn")


@register("w03_list_rank", """SELECT kind AS q, id, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank FROM que""")
def _(t):
    return star.queue(t).select(F.col("kind").alias("q"), "id", gr.rank_in(["kind"], [F.desc("score"), F.col("id")]).alias("rank"))


PAIRS = """pr AS (SELECT l_suppkey AS src, l_partkey%1000 AS other, max(l_extendedprice) AS score FROM lineitem WHERE l_suppkey<>l_partkey%1000 GROUP BY 1,2)"""


def supplier_pairs(t):
    return t.lineitem.filter("l_suppkey != l_partkey % 1000").groupBy(
        F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 1000).alias("other")).agg(F.max("l_extendedprice").alias("score"))


@register("w04_per_source_cap", f"""WITH {PAIRS},
    u AS (SELECT src, other, score FROM (SELECT *, row_number() OVER (PARTITION BY least(src,other), greatest(src,other) ORDER BY score DESC, src, other) AS r FROM pr) WHERE r=1)
    SELECT src, other, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, other) AS rn FROM u) WHERE rn<=2
    ORDER BY score DESC, src, other LIMIT 20""")
def _(t):
    return rk.capped_pairs(supplier_pairs(t), 2, 20)


@register("w05_top_ten_per_source", f"""WITH {PAIRS} SELECT src, other, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, other) AS rn FROM pr) WHERE rn<=10""")
def _(t):
    return rk.top_per(supplier_pairs(t), ["src"], [F.desc("score"), F.col("other")], 10)


@register("w06_latest_export", """SELECT l_orderkey AS work_key, max(l_linenumber) AS last FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("work_key")).agg(F.max_by("l_linenumber", "l_linenumber").alias("last"))


@register("w07_repeat_suppression", """SELECT id, op FROM (SELECT id, op, lag(op) OVER (ORDER BY id) AS p FROM dec WHERE revoked_at IS NULL) WHERE p IS NULL OR p<>op""")
def _(t):
    log = star.decisions(t).filter("revoked_at is null").select("id", "op")
    return rk.without_repeats(log, "id", ["op"], bucket=1000).select("id", "op")


@register("w08_daily_allocation", f"""
    WITH alive AS (SELECT c.* FROM crd c WHERE NOT suspended AND entity_key NOT IN (SELECT key FROM ent WHERE status='rejected')
      AND (NOT EXISTS (SELECT 1 FROM edg e WHERE e.dst=c.entity_key AND e.type IN {SRC})
        OR EXISTS (SELECT 1 FROM edg e WHERE e.dst=c.entity_key AND e.type IN {SRC} AND e.status<>'rejected'))),
    due AS (SELECT id, priority, false AS new FROM alive WHERE introduced_at IS NOT NULL AND due<=TIMESTAMP '2000-01-14' ORDER BY priority DESC, due, id LIMIT 60),
    nw AS (SELECT id, priority, true AS new, row_number() OVER (ORDER BY priority DESC, created_at DESC, id) AS rn FROM alive WHERE introduced_at IS NULL)
    SELECT id, priority, new FROM due UNION ALL SELECT id, priority, new FROM nw WHERE rn <= least(30-3, 100-10-(SELECT count(*) FROM due), 60-(SELECT count(*) FROM due))""")
def _(t):
    alive = fl.live_cards(t.library, star.cards(t))
    return rk.daily_allocation(alive, F.expr("timestamp '2000-01-14 00:00:00'"), 60, 100, 30, 10, 3)


@register("w09_top_per_column", """SELECT type, key, rn FROM (SELECT type, key, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN type='work' THEN -id ELSE id END, key) AS rn
    FROM ent WHERE status<>'rejected') WHERE rn<=150""")
def _(t):
    e = fl.not_rejected(t.library.entity)
    order = [F.when(F.col("type") == "work", -F.col("id")).otherwise(F.col("id")), F.col("key")]
    return rk.top_per(e, ["type"], order, 150).select("type", "key", "rn")


UNSEEN = """fr AS (SELECT *, json_extract_string(payload,'$.topic') AS topic FROM que WHERE kind='retro_tag' AND status<>'skipped'
      AND dedupe_key NOT IN (SELECT dedupe_key FROM que WHERE kind='retro_tag' AND status='skipped'))"""


@register("w10_queue_cap", f"""WITH {UNSEEN}
    SELECT topic, id, 0::BIGINT AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rn FROM fr) WHERE rn<=30
    UNION ALL SELECT topic, -1, greatest(count(*)-30,0) FROM fr GROUP BY topic""")
def _(t):
    q = star.queue(t).filter("kind = 'retro_tag'").withColumn("topic", F.get_json_object("payload", "$.topic"))
    page, left = rk.page_unseen(q.filter("status != 'skipped'"), q.filter("status = 'skipped'"), ["topic"], [F.desc("score"), F.col("id")], 30)
    return page.select("topic", "id", F.lit(0).cast("long").alias("remaining")).unionByName(
        left.select("topic", F.lit(-1).cast("long").alias("id"), "remaining"))


@register("w11_last_merge_per_key", """SELECT 'asset:'||a AS key, max_by('asset:'||b, id) AS "into" FROM dec WHERE op='merge' AND revoked_at IS NULL AND b<a GROUP BY 1""")
def _(t):
    return lk.last_redirects(merges(t))


@register("w12_first_declaration", """SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r=1""")
def _(t):
    return rk.top_per(t.conversations, ["conv_id", "role"], [F.col("turn")], 1).select("conv_id", "role", "turn")


@register("w13_category_cap", """SELECT kind, id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rn FROM que) WHERE rn<=8 ORDER BY score DESC, id LIMIT 25""")
def _(t):
    return rk.capped_by_category(star.queue(t), "kind", [F.desc("score"), F.col("id")], 8, 25).select("kind", "id")


@register("w14_surviving_card", """
    WITH n AS (SELECT 'card:'||user_id AS id, count(*) AS history FROM events GROUP BY 1)
    SELECT slot, id, history FROM (SELECT c.q AS slot, c.id, coalesce(history,0) AS history, row_number() OVER (PARTITION BY c.q ORDER BY coalesce(history,0) DESC, c.id) AS r
      FROM crd c LEFT JOIN n USING (id)) WHERE r=1""")
def _(t):
    c = star.cards(t).withColumn("slot", F.col("q"))
    return rk.surviving_cards(c, t.events.selectExpr("concat('card:', user_id) card_id")).select("slot", "id", "history")


@register("a21_review_day_counters", """
    SELECT (SELECT count(*) FROM events WHERE ts>=TIMESTAMP '2024-01-10 04:00:00') AS reviewed,
      count(*) FILTER (introduced_at>=TIMESTAMP '2024-01-10 04:00:00') AS introduced,
      count(*) FILTER (introduced_at IS NULL OR due<=TIMESTAMP '2024-01-11 03:30:00') AS backlog FROM crd""")
def _(t):
    log = t.events.selectExpr("ts reviewed_at")
    return rk.review_counts(log, star.cards(t), F.expr("timestamp '2024-01-11 03:30:00'"))


@register("t06_review_day", """SELECT strftime(date_trunc('day', ts - INTERVAL 4 HOUR) + INTERVAL 4 HOUR, '%Y-%m-%d %H') AS day, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    day = F.window("ts", "1 day", "1 day", "4 hours")
    return t.events.groupBy(day).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("day"), "n")


@register("o01_browse_page", """
    WITH b AS (SELECT key, id FROM ent WHERE type IN ('work','dataset','method','idea','claim','topic') AND status<>'rejected')
    SELECT key, id, (SELECT count(*) FROM b) AS total, 60 < (SELECT count(*) FROM b) AS has_more FROM (SELECT * FROM b ORDER BY id DESC LIMIT 20 OFFSET 40)""")
def _(t):
    lib = t.library
    return rk.page(fl.apply_filters(lib, lib.entity, fl.Filters()).select("key", "id"), [F.desc("id")], 20, 40)


@register("o02_search_page", """SELECT id, true AS has_more FROM (SELECT id FROM que WHERE status='pending' ORDER BY score DESC, id LIMIT 20 OFFSET 20)""")
def _(t):
    rows, more = rk.search_page(fl.pending(star.queue(t)), [F.desc("score"), F.asc("id")], 20, 20)
    return rows.select("id", more.scalar().alias("has_more"))


@register("o04_queue_order", """SELECT id, score FROM que WHERE status='pending' ORDER BY score DESC, id LIMIT 50""")
def _(t):
    return fl.pending(star.queue(t)).orderBy(F.desc("score"), "id").select("id", "score").limit(50)


@register("o05_head_tail_order", """
    WITH r AS (SELECT id, score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rn, kind FROM que),
    s AS (SELECT kind, id, CASE WHEN rn<=50 THEN 1+(id%97)/97.0 ELSE score END AS sc FROM r)
    SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY sc DESC, id) AS pos FROM s""")
def _(t):
    q = star.queue(t).withColumn("rn", gr.rank_in(["kind"], [F.desc("score"), F.col("id")]))
    q = q.withColumn("sc", F.when(F.col("rn") <= 50, 1 + (F.col("id") % 97) / 97.0).otherwise(F.col("score")))
    return q.select("kind", "id", gr.rank_in(["kind"], [F.desc("sc"), F.col("id")]).alias("pos"))


@register("o07_due_order", """SELECT id FROM crd WHERE introduced_at IS NOT NULL ORDER BY priority DESC, due, id LIMIT 40""")
def _(t):
    return star.cards(t).filter("introduced_at is not null").orderBy(F.desc("priority"), F.asc_nulls_last("due"), "id").select("id").limit(40)


@register("o08_drawing_budget", """WITH n AS (SELECT dst AS key, count(*) AS size FROM edg WHERE type='about' AND status<>'rejected' GROUP BY 1)
    SELECT key, size FROM n ORDER BY size DESC, key LIMIT 25""")
def _(t):
    n = fl.not_rejected(t.library.edge).filter("type = 'about'").groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("size"))
    return n.orderBy(F.desc("size"), "key").limit(25)


@register("o09_edge_paging", """
    WITH b AS (SELECT 0 AS dir, dst AS other, status, created_at, src AS node FROM edg WHERE src='topic:n3' AND type='is_a'
      UNION ALL SELECT 1, src, status, created_at, dst FROM edg WHERE dst='topic:n3' AND type='is_a')
    SELECT dir, other, (SELECT count(*) FROM b) AS total, 5 < (SELECT count(*) FROM b) AS has_more FROM (SELECT * FROM b ORDER BY dir,
      CASE status WHEN 'confirmed' THEN 0 WHEN 'auto' THEN 1 ELSE 2 END, created_at, other LIMIT 4 OFFSET 1)""")
def _(t):
    e = t.library.edge.filter("type = 'is_a'")
    out = e.filter("src = 'topic:n3'").selectExpr("0 dir", "dst other", "status", "created_at", "src node")
    inn = e.filter("dst = 'topic:n3'").selectExpr("1 dir", "src other", "status", "created_at", "dst node")
    return rk.page(out.unionByName(inn), [F.col("dir"), *lk.edge_order()], 4, 1).select("dir", "other", "total", "has_more")


@register("o10_tagged_paging", """
    WITH i AS (SELECT DISTINCT src AS key FROM edg WHERE type IN ('about','applicable_to') AND status<>'rejected' AND dst='topic:s5')
    SELECT key, (SELECT count(*) FROM i) AS total, 120 < (SELECT count(*) FROM i) AS has_more FROM (SELECT * FROM i ORDER BY key LIMIT 40 OFFSET 80)""")
def _(t):
    i = ru.tagged(t.library).filter("dst = 'topic:s5'").select(F.col("src").alias("key")).distinct()
    return rk.page(i, [F.col("key")], 40, 80)


@register("o11_job_batches", """SELECT id FROM (SELECT id FROM crd WHERE introduced_at IS NULL ORDER BY created_at DESC, id LIMIT 500)""")
def _(t):
    return star.cards(t).filter("introduced_at is null").orderBy(F.desc("created_at"), "id").limit(500).select("id")


@register("o12_related_tie_rule", """SELECT probe, other, pos FROM (SELECT l_orderkey%7 AS probe, l_partkey AS other, row_number() OVER (PARTITION BY l_orderkey%7
    ORDER BY max(l_quantity) DESC, l_partkey) AS pos FROM lineitem GROUP BY 1,2) WHERE pos<=5""")
def _(t):
    s = t.lineitem.groupBy((F.col("l_orderkey") % 7).alias("probe"), F.col("l_partkey").alias("other")).agg(F.max("l_quantity").alias("score"))
    return rk.top_per(s, ["probe"], [F.desc(F.round("score", 6)), F.col("other")], 5, rank="pos").select("probe", "other", "pos")


@register("u01_union_all_members", "SELECT key, role, coalesce(via,'') AS via FROM mem")
def _(t):
    lib = t.library
    sub = gr.topic_subtree(lib, lib.entity.filter("key = 'topic:r1'").select("key"))
    return ru.members(lib, sub).withColumn("via", F.coalesce("via", F.lit("")))


@register("u02_union_directions", """SELECT src AS node, dst AS other FROM edg WHERE status<>'rejected' UNION SELECT dst, src FROM edg WHERE status<>'rejected'""")
def _(t):
    return gr.both_ways(gr.live(t.library.edge)).distinct()


@register("u03_intersect", """SELECT src AS key FROM edg WHERE dst='topic:s1' AND status<>'rejected' INTERSECT SELECT src FROM edg WHERE dst='topic:s2' AND status<>'rejected'""")
def _(t):
    e = gr.live(t.library.edge)
    return e.filter("dst = 'topic:s1'").selectExpr("src key").intersect(e.filter("dst = 'topic:s2'").selectExpr("src key"))


@register("u04_difference", """SELECT key FROM ent WHERE type='topic' EXCEPT SELECT dst FROM edg WHERE type='applicable_to' AND status='confirmed'""")
def _(t):
    lib = t.library
    used = lib.edge.filter("type = 'applicable_to' and status = 'confirmed'").selectExpr("dst key")
    return lib.entity.filter("type = 'topic'").select("key").join(used, "key", "left_anti")


@register("u05_unordered_pairs", """SELECT DISTINCT least(a,b) AS a, greatest(a,b) AS b FROM dec WHERE op='distinct' AND revoked_at IS NULL AND a<>b""")
def _(t):
    d = star.decisions(t).filter("op = 'distinct' and revoked_at is null and a != b")
    return d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
