"""Registered correction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections as co
from ..operators import filters as fl
from ..operators import lookups as lk
from ..operators import replay
from ..session import cut, stored
from ..sources import star
from .q_sources import once
from .registry import register


def log(t):
    """The correction log with JSON payloads."""
    d = star.decisions(t)
    asset = lambda c: F.concat(F.lit("asset:"), c)
    payload = (F.when(F.col("op") == "merge", F.to_json(F.struct(asset("a").alias("from"), asset("b").alias("into"))))
               .when(F.col("op") == "distinct", F.to_json(F.struct(asset("a").alias("a"), asset("b").alias("b"))))
               .when(F.col("op") == "rename", F.to_json(F.struct(asset("a").alias("key"), F.concat(F.lit("name "), "b").alias("name"))))
               .when(F.col("op") == "edge_status", F.to_json(F.struct(F.concat(F.lit("work:"), "a").alias("src"), F.concat(F.lit("topic:s"), "b").alias("dst"), F.lit("about").alias("type"),
                     F.when(F.col("value") > 50, "rejected").otherwise("confirmed").alias("status"))))
               .otherwise(F.to_json(F.struct(asset(F.col("a") + F.col("b")).alias("key")))))
    return d.withColumn("payload", payload)


def replayed(t):
    return once(t, "replayed", lambda: _replay(t))


def _replay(t):
    lib, skipped = replay.apply_all(t.library.with_(), log(t))
    return lib.with_(entity=stored(lib.entity, "entities")), cut(skipped)


MERGES = """mg AS (SELECT d.id, 'asset:'||a AS f, 'asset:'||b AS i, x.type AS ft, y.type AS it FROM dec d LEFT JOIN ent x ON x.key='asset:'||a LEFT JOIN ent y ON y.key='asset:'||b
      WHERE op='merge' AND revoked_at IS NULL),
    lnk AS (SELECT f, max_by(i, id) AS i FROM mg WHERE ft=it AND f<>i GROUP BY 1)"""


@register("d01_replay")
def _(t):
    lib, _skipped = replayed(t)
    return lib.entity.groupBy("type", "status").agg(F.count("*").alias("n"))


@register("d01_edge_lineages", """
    WITH mg AS (SELECT 'asset:'||a AS f, arg_min('asset:'||b, d.id) AS i, min(d.id) AS mid FROM dec d JOIN ent x ON x.key='asset:'||a JOIN ent y ON y.key='asset:'||b
      WHERE op='merge' AND revoked_at IS NULL AND a%2=1 AND b%2=0 AND x.type=y.type GROUP BY 1),
    oa AS (SELECT d.id, coalesce(CASE WHEN d.id>mg.mid THEN mg.i END, 'asset:'||a) AS src, 'topic:s'||b AS dst, CASE WHEN value>50 THEN 'rejected' ELSE 'confirmed' END AS st
      FROM dec d LEFT JOIN mg ON mg.f='asset:'||a WHERE op='edge_status' AND revoked_at IS NULL),
    lv AS (SELECT src||'|'||dst AS lid, src, dst, status, -1::BIGINT AS since FROM edg WHERE type='applicable_to'
      UNION ALL SELECT 'd'||id, src, dst, 'confirmed', id FROM oa WHERE st='confirmed' AND src IN (SELECT key FROM ent) AND dst IN (SELECT key FROM ent)),
    pc AS (SELECT lid, dst, src AS k, since AS a, coalesce(mg.mid, 9000000000000000000) AS z FROM lv LEFT JOIN mg ON mg.f=lv.src AND mg.mid>since
      UNION ALL SELECT lid, dst, mg.i, mg.mid, 9000000000000000000 FROM lv JOIN mg ON mg.f=lv.src AND mg.mid>since),
    lw AS (SELECT lid, arg_max(st, oa.id) AS st FROM pc JOIN oa ON oa.src=pc.k AND oa.dst=pc.dst AND oa.id>pc.a AND oa.id<=pc.z GROUP BY lid),
    fin AS (SELECT coalesce(mg.i, lv.src) AS src, lv.dst, coalesce(lw.st, lv.status) AS st FROM lv LEFT JOIN mg ON mg.f=lv.src AND mg.mid>lv.since LEFT JOIN lw USING (lid))
    SELECT src, dst, CASE max(CASE st WHEN 'rejected' THEN 2 WHEN 'confirmed' THEN 1 ELSE 0 END) WHEN 2 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'auto' END AS status FROM fin GROUP BY 1,2""")
def _(t):
    """Statuses of asset-topic edges, decided before and after merges of their assets."""
    d = star.decisions(t)
    asset = F.concat(F.lit("asset:"), "a")
    merge = F.to_json(F.struct(asset.alias("from"), F.concat(F.lit("asset:"), "b").alias("into")))
    said = F.to_json(F.struct(asset.alias("src"), F.concat(F.lit("topic:s"), "b").alias("dst"), F.lit("applicable_to").alias("type"), F.when(F.col("value") > 50, "rejected").otherwise("confirmed").alias("status")))
    d = d.filter("(op = 'merge' and a % 2 = 1 and b % 2 = 0) or op = 'edge_status'").withColumn("payload", F.when(F.col("op") == "merge", merge).otherwise(said))
    lib, _skipped = replay.apply_all(t.library.with_(edge=t.library.edge.filter("type = 'applicable_to'")), d)  # the log names no other type
    return lib.edge.select("src", "dst", "status")


@register("d01_rejected_entities", f"""WITH {MERGES}, rj AS (SELECT DISTINCT 'asset:'||(a+b) AS key FROM dec WHERE op='reject_entity' AND revoked_at IS NULL)
    SELECT key FROM ent WHERE key IN (SELECT key FROM rj) AND key NOT IN (SELECT f FROM mg WHERE ft=it AND f<>i) AND key NOT IN (SELECT i FROM mg WHERE ft=it AND f<>i)""")
def _(t):
    """Rejected entities that no merge touches."""
    lib, _skipped = replayed(t)
    merges, _s = co.merges_of(t.library, log(t))
    ends = merges.select(F.col("from_key").alias("key")).unionByName(merges.select(F.col("into_key").alias("key")))
    asked = co.active(log(t)).filter("op = 'reject_entity'").select(co.field("key").alias("key"))
    return lib.entity.filter("status = 'rejected'").join(asked, "key", "left_semi").join(ends, "key", "left_anti").select("key")


@register("d05_skipped", f"""WITH {MERGES}, rk AS (SELECT id, op, 'asset:'||CASE op WHEN 'rename' THEN a ELSE a+b END AS key FROM dec WHERE op IN ('rename','reject_entity') AND revoked_at IS NULL)
    SELECT id, 'merge' AS op, CASE WHEN ft IS NULL OR it IS NULL THEN 'not found' WHEN f=i THEN 'same entity' ELSE 'different types' END AS reason FROM mg WHERE ft IS NULL OR it IS NULL OR f=i OR ft<>it
    UNION ALL SELECT id, op, 'not found' FROM rk WHERE key NOT IN (SELECT key FROM ent)""")
def _(t):
    return replayed(t)[1].select("id", "op", "reason")


@register("d03_validation", """SELECT id, CASE WHEN o='merge2' THEN 'unknown op' WHEN o='rename' AND b%7=0 THEN 'missing name' WHEN o='rename' AND b%7=1 THEN 'empty name'
      WHEN o='edge_status' AND b%5=0 THEN 'unknown edge type' ELSE '' END AS problem
    FROM (SELECT id, a, b, CASE WHEN op='merge' AND b%9=0 THEN 'merge2' ELSE op END AS o FROM dec WHERE op IN ('rename','edge_status') OR (op='merge' AND b%9=0))
    WHERE (o='merge2') OR (o='rename') OR (o='edge_status' AND b%5=0)""")
def _(t):
    d = log(t).filter("op in ('rename','edge_status') or (op = 'merge' and b % 9 = 0)").filter("op != 'edge_status' or b % 5 = 0")
    name = F.when(F.col("b") % 7 == 0, None).when(F.col("b") % 7 == 1, " ").otherwise("x")
    bad = (F.when(F.col("op") == "rename", F.to_json(F.struct(F.concat(F.lit("asset:"), F.col("a")).alias("key"), name.alias("name"))))
           .when(F.col("op") == "edge_status", F.replace(F.col("payload"), F.lit('"about"'), F.lit('"abuot"'))).otherwise(F.col("payload")))
    d = d.withColumn("payload", bad).withColumn("op", F.when(F.col("op") == "merge", "merge2").otherwise(F.col("op")))
    return co.validated(t.library, d).select("id", F.coalesce("problem", F.lit("")).alias("problem"))


@register("d04_revoked_retract", """SELECT doc_id AS id, doc_id NOT IN (SELECT a::VARCHAR FROM dec WHERE op='distinct' AND revoked_at IS NULL) AS is_current FROM (SELECT doc_id::VARCHAR AS doc_id FROM documents)""")
def _(t):
    """Retracts list export ids; a revoked one no longer hides them."""
    d = star.decisions(t).filter("op = 'distinct'").select("id", F.lit("retract").alias("op"), "revoked_at", F.to_json(F.struct(F.array("a").alias("extraction_ids"))).alias("payload"))
    return co.current(t.documents.select(F.col("doc_id").alias("id")), d).select(F.col("id").cast("string").alias("id"), "is_current")


EDGES = """lst AS (SELECT 'work:'||a AS src, 'topic:s'||b AS dst, 'about' AS type, max_by(CASE WHEN value>50 THEN 'rejected' ELSE 'confirmed' END, id) AS s, max(value<=50) AS adds
      FROM dec WHERE op='edge_status' AND revoked_at IS NULL GROUP BY 1,2,3)"""


@register("d06_effective_edge_status", f"""WITH {EDGES}
    SELECT e.src, e.dst, e.type, coalesce(s, e.status) AS status FROM edg e LEFT JOIN lst USING (src, dst, type)
    UNION ALL SELECT src, dst, type, s FROM lst WHERE adds AND NOT EXISTS (SELECT 1 FROM edg e WHERE e.src=lst.src AND e.dst=lst.dst AND e.type='about')
      AND src IN (SELECT key FROM ent) AND dst IN (SELECT key FROM ent)""")
def _(t):
    lib = t.library
    return co.effective_edges(lib, co.edge_decisions(log(t))).select("src", "dst", "type", "status")


@register("d08_id_stability", """
    WITH o AS (SELECT key, id FROM ent WHERE id%20<>1), m AS (SELECT max(id) AS m FROM o)
    SELECT key, id FROM o UNION ALL SELECT key, m + row_number() OVER (ORDER BY md5(key)) FROM ent, m WHERE id%20=1""")
def _(t):
    e = t.library.entity.select("key", "id")
    return co.stable_ids(e, e.filter("id % 20 != 1"))


@register("d09_time_stability", "SELECT 'topic:s'||l_suppkey AS key, strftime(min(l_shipdate),'%Y-%m-%d') AS created FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.concat(F.lit("topic:s"), "l_suppkey").alias("key")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("created"))


@register("d10_pinned", """
    WITH RECURSIVE mm AS (SELECT 'asset:'||a AS f, max_by('asset:'||b, id) AS i FROM dec WHERE op='merge' AND revoked_at IS NULL AND b<a GROUP BY 1),
    wk(k, c) AS (SELECT f, i FROM mm UNION ALL SELECT k, i FROM wk JOIN mm ON mm.f=c), tg AS (SELECT k, c FROM wk WHERE c NOT IN (SELECT f FROM mm)),
    al2 AS (SELECT DISTINCT 'asset:'||b AS i FROM dec WHERE op='merge' AND revoked_at IS NULL AND b<a)
    SELECT k AS key FROM tg WHERE c NOT IN (SELECT key FROM ent WHERE id%3<>0) UNION SELECT i FROM al2""")
def _(t):
    lib = t.library
    part = lib.with_(entity=lib.entity.filter("id % 3 != 0"))
    d = log(t).filter("op = 'merge' and b < a")
    return co.pinned(part, d)


@register("d11_answers_to_decisions", """
    WITH q AS (SELECT id, kind, json_extract_string(payload,'$.a') AS a, json_extract_string(payload,'$.b') AS b, id%3 AS r FROM que WHERE status='pending' AND kind IN ('merge','topic_relation'))
    SELECT id, CASE r WHEN 0 THEN 'merge' WHEN 1 THEN 'distinct' END AS op FROM q WHERE r<2 AND a<>b
    UNION ALL SELECT id, 'add_edge' FROM q WHERE r=2 AND kind='topic_relation' AND a<>b UNION ALL SELECT id, 'obsolete' FROM q WHERE a=b""")
def _(t):
    items = star.queue(t).filter("kind in ('merge','topic_relation')")
    answers = items.select("id", F.when(F.col("id") % 3 == 0, "merge").when(F.col("id") % 3 == 1, "distinct").otherwise("a_is_a_b").alias("action"))
    none = t.library.entity.limit(0).select("key", F.col("key").alias("target"))
    made, gone = co.answers_to_decisions(items, answers, none)
    return made.select("id", "op").unionByName(gone.select("id", F.lit("obsolete").alias("op")))


@register("d12_bulk_dismiss", "SELECT id, CASE WHEN status='pending' AND kind='retro_tag' AND json_extract_string(payload,'$.topic')='topic:n3' THEN 'skipped' ELSE status END AS status FROM que")
def _(t):
    q = star.queue(t)
    hit = fl.pending(q, "retro_tag", "topic:n3").select("id", F.lit(True).alias("_h"))
    return q.join(hit, "id", "left").select("id", F.when(F.col("_h"), "skipped").otherwise(F.col("status")).alias("status"))


@register("d14_restamp", "SELECT o_orderkey AS id, CASE WHEN o_custkey%2=0 THEN 'p'||o_custkey ELSE 'old' END AS work_key FROM orders")
def _(t):
    ex = t.orders.selectExpr("o_orderkey id", "'old' work_key")
    return co.restamped(ex, t.orders.filter("o_custkey % 2 = 0").selectExpr("o_orderkey eid", "concat('p', o_custkey) key")).select("id", "work_key")


@register("d16_suspend_cards", "SELECT id, suspended OR id IN (SELECT 'card:'||user_id FROM events WHERE event_type='error') OR entity_key IN (SELECT key FROM ent WHERE type='claim') AS suspended FROM crd")
def _(t):
    return co.suspend_cards(star.cards(t), t.events.filter("event_type = 'error'").selectExpr("concat('card:', user_id) id").distinct(),
                            t.library.entity.filter("type = 'claim'").select("key")).select("id", "suspended")


@register("c14_card_reconciliation")
def _(t):
    red = lk.redirect_map(co.merges_of(t.library, log(t))[0])
    live = t.library.entity.join(red.select("key"), "key", "left_anti").filter("status != 'rejected'")
    return co.reconcile_cards(star.cards(t), t.events.selectExpr("concat('card:', user_id) card_id"), live, red).select("id", "kept", "suspended", "priority", "history")


@register("c15_queue_insert", """SELECT dedupe_key, min(id) AS id FROM que WHERE status='pending' AND dedupe_key NOT IN (SELECT dedupe_key FROM que WHERE status<>'pending') GROUP BY 1""")
def _(t):
    q = star.queue(t)
    new = q.filter("status = 'pending'").join(q.filter("status != 'pending'").select("dedupe_key"), "dedupe_key", "left_anti")
    return new.groupBy("dedupe_key").agg(F.min("id").alias("id"))


@register("c17_pending_generated_cards", """SELECT id FROM crd WHERE origin='template' AND id NOT IN (SELECT 'card:'||user_id FROM events WHERE event_type='view') ORDER BY created_at DESC, id LIMIT 500""")
def _(t):
    owed = star.cards(t).filter("origin = 'template'").join(t.events.filter("event_type = 'view'").selectExpr("concat('card:', user_id) id"), "id", "left_anti")
    return owed.orderBy(F.desc("created_at"), "id").limit(500).select("id")
