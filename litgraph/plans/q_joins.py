"""Registered join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_ascii
from ..model import SOURCE_EDGES
from ..operators import filters as fl
from ..operators import lookups as lk
from ..sources import star
from .registry import NORM, register

SRC = "('proposes','uses','produces','evaluates','supports','contradicts')"
FIRST = """SELECT type, norm, min_by(entity_key, id) AS key FROM als JOIN ent ON ent.key=als.entity_key WHERE norm<>'' GROUP BY type, norm"""


@register("j01_by_alias", f"""
    WITH idx AS ({FIRST}),
    pr AS (SELECT DISTINCT type, {NORM.format("upper(p_name)||'.'")} AS norm FROM part, (VALUES ('dataset'),('method'),('topic')) v(type))
    SELECT pr.type, pr.norm, idx.key FROM pr LEFT JOIN idx USING (type, norm)""")
def _(t):
    probes = t.part.select(F.explode(F.array(*[F.lit(x) for x in ("dataset", "method", "topic")])).alias("type"),
                           norm_ascii(F.concat(F.upper("p_name"), F.lit("."))).alias("norm")).distinct()
    return lk.by_alias(t.library, probes).select("type", "norm", "key")


def merges(t):
    """The merge decisions in force: each key into a smaller one, so chains end."""
    return (star.decisions(t).filter("op = 'merge' and revoked_at is null and b < a")
            .selectExpr("id", "concat('asset:', a) from_key", "concat('asset:', b) into_key"))


CHAIN = """lnk AS (SELECT 'asset:'||a AS key, max_by('asset:'||b, id) AS into_ FROM dec WHERE op='merge' AND revoked_at IS NULL AND b<a GROUP BY 1),
    walk(key, cur) AS (SELECT key, into_ FROM lnk UNION ALL SELECT w.key, l.into_ FROM walk w JOIN lnk l ON l.key=w.cur),
    red AS (SELECT key, cur AS target FROM walk WHERE cur NOT IN (SELECT key FROM lnk))"""


@register("j02_by_key_with_redirects", f"""
    WITH RECURSIVE {CHAIN}
    SELECT event_id, coalesce(r.target, v.entity_key) AS key, n.canonical_name AS name FROM vlg v LEFT JOIN red r ON r.key=v.entity_key
    LEFT JOIN ent n ON n.key=coalesce(r.target, v.entity_key)""")
def _(t):
    lib = t.library
    v = lk.follow(star.views_log(t), lk.redirect_map(merges(t)), "entity_key")
    return v.join(lib.entity.select(F.col("key").alias("entity_key"), F.col("canonical_name").alias("name")), "entity_key", "left").select(
        "event_id", F.col("entity_key").alias("key"), "name")


@register("d02_redirect_map", f"WITH RECURSIVE {CHAIN} SELECT key, target FROM red")
def _(t):
    return lk.redirect_map(merges(t))


@register("j03_by_external_id", """
    WITH pr AS (SELECT p_partkey, v.type, p_brand||'/'||p_partkey AS external_id FROM part, (VALUES ('dataset'),('method')) v(type))
    SELECT p_partkey, pr.type, key FROM pr LEFT JOIN ent ON ent.type=pr.type AND ent.external_id=pr.external_id""")
def _(t):
    probes = t.part.select("p_partkey", F.explode(F.array(F.lit("dataset"), F.lit("method"))).alias("type"),
                           F.concat("p_brand", F.lit("/"), "p_partkey").alias("external_id"))
    return lk.by_external_id(t.library, probes).select("p_partkey", "type", "key")


REFS = """rf AS (SELECT DISTINCT ref FROM (SELECT ' asset:'||p_partkey||' ' AS ref FROM part UNION ALL SELECT p_brand||'/'||(p_partkey+500) FROM part
      UNION ALL SELECT upper(p_name) FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer
      UNION ALL SELECT 'work:'||o_orderkey FROM orders))"""


@register("j04_resolve_ref", f"""
    WITH {REFS}, rn AS (SELECT ref, trim(ref) AS tr, {NORM.format('trim(ref)')} AS n FROM rf),
    al AS (SELECT a.norm, e.key, e.id, CASE e.type WHEN 'work' THEN 10 WHEN 'dataset' THEN 11 WHEN 'method' THEN 12 WHEN 'idea' THEN 13
       WHEN 'claim' THEN 14 WHEN 'topic' THEN 15 WHEN 'organism' THEN 16 ELSE 17 END AS prio FROM als a JOIN ent e ON e.key=a.entity_key),
    hits AS (SELECT ref, 1 AS prio, id, key FROM rn JOIN ent ON ent.key=tr UNION ALL SELECT ref, 6, id, key FROM rn JOIN ent ON external_id=tr
      UNION ALL SELECT ref, al.prio, id, key FROM rn JOIN al ON al.norm=n),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY prio, id, key) AS r FROM hits) WHERE r=1)
    SELECT rf.ref, key AS found, coalesce(prio,-1) AS prio FROM rf LEFT JOIN best USING (ref)""")
def _(t):
    refs = (t.part.selectExpr("concat(' asset:', p_partkey, ' ') ref")
            .unionByName(t.part.selectExpr("concat(p_brand, '/', p_partkey + 500) ref"))
            .unionByName(t.part.selectExpr("upper(p_name) ref")).unionByName(t.nation.selectExpr("n_name ref"))
            .unionByName(t.customer.selectExpr("c_name ref")).unionByName(t.orders.selectExpr("concat('work:', o_orderkey) ref")).distinct())
    return lk.resolve_ref(t.library, refs).select("ref", "found", F.coalesce("prio", F.lit(-1)).alias("prio"))


@register("j05_source_works", """SELECT s.entity_key AS key, work_key, n.canonical_name AS title, year, edge_type, s.evidence
    FROM srcw s JOIN ent n ON n.key=s.work_key""")
def _(t):
    return lk.source_works(t.library)


@register("j06_linked_to", """SELECT DISTINCT src AS key FROM edg WHERE type IN ('about','applicable_to') AND status<>'rejected'
    AND dst IN (SELECT key FROM ent WHERE type='topic' AND status='candidate')""")
def _(t):
    lib = t.library.with_(edge=t.library.edge_of("about", "applicable_to"))
    return fl.linked_to(lib, lib.entity.filter("type = 'topic' and status = 'candidate'"), ("about", "applicable_to")).distinct()


@register("j07_via_work", f"""SELECT key FROM ent n WHERE EXISTS (SELECT 1 FROM wrk w WHERE w.entity_key=n.key AND w.year=1997 AND w.tier=1)
    OR EXISTS (SELECT 1 FROM edg e JOIN wrk w ON w.entity_key=e.src WHERE e.dst=n.key AND e.status<>'rejected' AND e.type IN {SRC}
      AND w.year=1997 AND w.tier=1)""")
def _(t):
    lib = t.library.with_(edge=t.library.edge_of(*SOURCE_EDGES))
    return fl.on_works(lib, lib.entity, (F.col("year") == 1997) & (F.col("tier") == 1)).select("key")


@register("j08_optional_year", "SELECT n.key, type, coalesce(year,-1) AS year FROM ent n LEFT JOIN wrk w ON w.entity_key=n.key")
def _(t):
    lib = t.library
    return lk.with_year(lib, lib.entity).select("key", "type", F.coalesce("year", F.lit(-1)).alias("year"))


@register("j09_same_title", """
    WITH p AS (SELECT p_partkey AS id, upper(p_name)||' ' AS title, CASE WHEN p_size%10=0 THEN NULL ELSE p_size END AS year FROM part)
    SELECT a.id, min(b.id) AS match_id, count(*)::BIGINT AS matches FROM p a JOIN p b ON lower(trim(a.title))=lower(trim(b.title))
      AND (a.year IS NULL OR b.year IS NULL OR abs(a.year-b.year)<=1) GROUP BY a.id""")
def _(t):
    p = t.part.selectExpr("p_partkey id", "concat(upper(p_name), ' ') title", "if(p_size % 10 = 0, null, p_size) year")
    return lk.same_title(p, p)


CITES = """cit AS (SELECT DISTINCT a, b FROM (SELECT user_id AS a, (json_extract_string(props,'$.k'))::BIGINT AS b FROM events)
    WHERE a<>b AND b IN (SELECT user_id FROM events))"""


@register("j11_link_citations", f"""WITH {CITES} SELECT 'all' AS scope, 'w'||a AS src, 'w'||b AS dst FROM cit
    UNION ALL SELECT 'new', 'w'||a, 'w'||b FROM cit WHERE a IN (SELECT user_id FROM events WHERE value>450)
       OR b IN (SELECT user_id FROM events WHERE value>450)""")
def _(t):
    rec = t.events.selectExpr("cast(user_id as string) id", "array(get_json_object(props, '$.k')) referenced_works")
    works = t.events.selectExpr("cast(user_id as string) metadata_id", "concat('w', user_id) key").distinct()
    only = t.events.filter("value > 450").selectExpr("concat('w', user_id) key").distinct()
    return (lk.citations(rec, works).withColumn("scope", F.lit("all"))
            .unionByName(lk.citations(rec, works, only).withColumn("scope", F.lit("new"))))


PROBED = "(SELECT key FROM ent WHERE type='work' AND status<>'rejected' AND ((id-1)//10)%100=0)"


def probe_works(lib):
    """The papers whose number is divisible by 100."""
    return lib.entity.filter("type = 'work' and status != 'rejected' and pmod((id - 1) div 10, 100) = 0").select("key")


@register("j12_shared_neighbours", f"""
    WITH le AS MATERIALIZED (SELECT src, dst, type FROM edg WHERE status<>'rejected'), pw AS MATERIALIZED {PROBED},
    mine AS (SELECT DISTINCT e.src AS probe, e.dst, split_part(e.dst,':',1) AS kind FROM le e JOIN pw ON pw.key=e.src WHERE split_part(e.dst,':',1) IN ('topic','asset')),
    ty AS MATERIALIZED (SELECT key, type FROM ent WHERE type IN ('topic','dataset','method'))
    SELECT probe, mine.dst, ty.type AS dtype, e.src AS other, e.type AS etype FROM mine JOIN ty ON ty.key=mine.dst JOIN le e ON e.dst=mine.dst AND e.src<>probe""")
def _(t):
    lib = t.library
    return lk.sharing_papers(lib, probe_works(lib)).select("probe", "dst", "dtype", "other", "etype")


@register("j13_shared_material", """SELECT src AS key FROM edg WHERE type IN ('about','applicable_to') AND status<>'rejected' AND dst='topic:s1'
    INTERSECT SELECT src FROM edg WHERE type IN ('about','applicable_to') AND status<>'rejected' AND dst='topic:s2'""")
def _(t):
    return lk.shared_material(t.library, "topic:s1", "topic:s2")


@register("j14_anti_joins", """
    SELECT 'untagged' AS what, key FROM ent WHERE type='work' AND key NOT IN (SELECT src FROM edg WHERE type='about' AND status<>'rejected')
    UNION ALL SELECT 'unqueued', key FROM ent WHERE type='topic' AND key NOT IN (SELECT json_extract_string(payload,'$.b') FROM que)
    UNION ALL SELECT 'unseen', key FROM ent WHERE type IN ('dataset','method') AND key NOT IN (SELECT entity_key FROM vlg)""")
def _(t):
    lib = t.library
    tagged = fl.not_rejected(lib.edge).filter("type = 'about'").select(F.col("src").alias("key"))
    queued = star.queue(t).select(F.get_json_object("payload", "$.b").alias("key"))
    seen = star.views_log(t).select(F.col("entity_key").alias("key"))
    parts = (("untagged", "type = 'work'", tagged), ("unqueued", "type = 'topic'", queued), ("unseen", "type in ('dataset','method')", seen))
    out = None
    for what, cond, drop in parts:
        one = lib.entity.filter(cond).join(drop, "key", "left_anti").select(F.lit(what).alias("what"), "key")
        out = one if out is None else out.unionByName(one)
    return out


@register("j16_positional_view", f"""
    WITH ins AS (SELECT conv_id, turn, text, {NORM.format('text')} AS n FROM conversations),
    stored AS (SELECT conv_id, turn, 'idea:'||conv_id||'.'||turn AS key FROM conversations WHERE role='user'),
    named AS (SELECT n, min(conv_id*1000+turn) AS k FROM ins GROUP BY n)
    SELECT i.conv_id, i.turn, coalesce(s.key, 'alias:'||k) AS key FROM ins i LEFT JOIN stored s USING (conv_id, turn) LEFT JOIN named USING (n)""")
def _(t):
    c = t.conversations.select("conv_id", "turn", "role", norm_ascii(F.col("text")).alias("n"))
    stored = c.filter("role = 'user'").selectExpr("conv_id", "turn", "concat('idea:', conv_id, '.', turn) stored")
    named = c.groupBy("n").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    return (c.join(stored, ["conv_id", "turn"], "left").join(named, "n", "left")
            .select("conv_id", "turn", F.coalesce("stored", F.concat(F.lit("alias:"), "k")).alias("key")))


@register("j17_find_existing", f"""
    WITH q AS (SELECT DISTINCT lower(p_name) AS ident, upper(n_name) AS title FROM part JOIN nation ON n_nationkey=p_partkey%25),
    al AS (SELECT a.norm, e.key, e.id FROM als a JOIN ent e ON e.key=a.entity_key WHERE e.type='work')
    SELECT ident, title, NULL::VARCHAR AS found FROM q WHERE {NORM.format('ident')} NOT IN (SELECT norm FROM al)
    UNION ALL SELECT 'order '||o_orderkey, '', 'work:'||o_orderkey FROM orders""")
def _(t):
    lib = t.library
    titled = lib.with_(alias=lib.alias.unionByName(
        t.orders.selectExpr("concat('work:', o_orderkey) entity_key", "concat('order ', o_orderkey) alias", "'name' source",
                            "concat('order ', o_orderkey) norm", "'en' lang")))
    q = t.part.join(t.nation, F.col("n_nationkey") == F.col("p_partkey") % 25).selectExpr("lower(p_name) ident", "upper(n_name) title").distinct()
    q = q.unionByName(t.orders.selectExpr("concat('order ', o_orderkey) ident", "'' title"))
    return lk.find_existing(titled, q).select("ident", "title", "found")


@register("j18_dataset_info", """SELECT n.external_id, n.canonical_name, e.src AS work_key, e.type AS edge_type, e.evidence FROM ent n
    JOIN edg e ON e.dst=n.key AND e.status<>'rejected' JOIN ent w ON w.key=e.src AND w.type='work' WHERE n.type='dataset' AND n.status<>'rejected'""")
def _(t):
    return lk.dataset_info(t.library, t.part.selectExpr("concat(p_brand, '/', p_partkey) accession"))


@register("j19_queue_context", """
    WITH asked AS (SELECT id, 'a' AS side, json_extract_string(payload,'$.a') AS key FROM que WHERE status='pending'
      UNION ALL SELECT id, 'b', json_extract_string(payload,'$.b') FROM que WHERE status='pending'),
    al AS (SELECT entity_key AS key, string_agg(alias, ',' ORDER BY alias) AS aliases FROM
      (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY alias) AS r FROM als) WHERE r<=8 GROUP BY 1),
    ends AS (SELECT src AS key, dst AS other, type, created_at FROM edg WHERE status<>'rejected'
       UNION ALL SELECT dst, src, type, created_at FROM edg WHERE status<>'rejected'),
    ed AS (SELECT key, string_agg(type||'>'||other, ',' ORDER BY type||'>'||other) AS edges FROM
      (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at, other, type) AS r FROM ends) WHERE r<=3 GROUP BY 1)
    SELECT asked.id, side, asked.key, coalesce(aliases,'') AS aliases, coalesce(edges,'') AS edges FROM asked JOIN ent n ON n.key=asked.key
    LEFT JOIN al ON al.key=asked.key LEFT JOIN ed ON ed.key=asked.key""")
def _(t):
    items = fl.pending(star.queue(t)).select("id", F.get_json_object("payload", "$.a").alias("a"), F.get_json_object("payload", "$.b").alias("b"))
    keys = items.select(F.col("a").alias("key")).unionByName(items.select(F.col("b").alias("key"))).filter("key is not null")
    return lk.queue_context(t.library.with_(edge=t.library.edge_at(keys)), items, ["a", "b"])


QK = "substr(sha256('judge'||chr(10)||json_extract_string(payload,'$.a')||chr(10)||json_extract_string(payload,'$.b')),1,48)"


def questions(t):
    q = fl.pending(star.queue(t)).withColumn("qkey", lk.question_key(
        "judge", F.get_json_object("payload", "$.a"), F.get_json_object("payload", "$.b")))
    memo = (q.filter(F.get_json_object("payload", "$.agent.action").isNotNull())
            .groupBy("qkey").agg(F.min_by(F.get_json_object("payload", "$.agent.action"), "id").alias("verdict")))
    return q, memo


@register("j20_verdict_memo", f"""
    WITH q AS (SELECT id, score, {QK} AS qkey, json_extract_string(payload,'$.agent.action') AS act FROM que WHERE status='pending'),
    memo AS (SELECT qkey, min_by(act, id) AS verdict FROM q WHERE act IS NOT NULL GROUP BY qkey)
    SELECT 'memo' AS what, id, verdict FROM q LEFT JOIN memo USING (qkey)
    UNION ALL SELECT 'ask', id, NULL FROM (SELECT id FROM q WHERE qkey NOT IN (SELECT qkey FROM memo) ORDER BY score DESC, id LIMIT 200)""")
def _(t):
    q, memo = questions(t)
    return (lk.with_verdicts(q, memo).select(F.lit("memo").alias("what"), "id", "verdict")
            .unionByName(lk.to_judge(q, memo, 200).select(F.lit("ask").alias("what"), "id", F.lit(None).cast("string").alias("verdict"))))


@register("j21_embedding_cache", """
    WITH cache AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, sha256(text) AS text_sha, sha256(text) IN (SELECT h FROM cache) AS cached FROM documents""")
def _(t):
    cache = (t.documents.join(t.labels, "doc_id").select(F.sha2("text", 256).alias("text_sha")).distinct()
             .select("text_sha", F.lit("hash").alias("model"), F.lit(1).alias("vec")))
    texts = t.documents.select("doc_id", "text")
    return lk.with_cached_vectors(texts, cache, "hash").select("doc_id", "text_sha", F.col("vec").isNotNull().alias("cached"))


@register("j23_entity_cards", """
    WITH ks AS (SELECT key FROM ent WHERE type IN ('topic','organism','modality')),
    ends AS (SELECT src AS node, dst AS other, 'out' AS direction, type, status, created_at, evidence FROM edg
      UNION ALL SELECT dst, src, 'in', type, status, created_at, evidence FROM edg),
    pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, direction, type ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'auto' THEN 1
      ELSE 2 END, created_at, node, other) AS rn FROM ends WHERE node IN (SELECT key FROM ks)) WHERE rn<=50),
    fe AS (SELECT node AS key, string_agg(type||'|'||direction||'|'||rn||'|'||other, ',' ORDER BY type, direction, rn) AS edges FROM pg GROUP BY 1),
    ct AS (SELECT key, string_agg(type||'='||n, ',' ORDER BY type) AS counts FROM (SELECT node AS key, type, count(*) AS n FROM ends GROUP BY 1,2) GROUP BY 1),
    na AS (SELECT entity_key AS key, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM als GROUP BY 1)
    SELECT n.key, n.canonical_name AS name, coalesce(aliases,'') AS aliases, coalesce(edges,'') AS edges, coalesce(counts,'') AS counts, coalesce(year,-1) AS year
    FROM ent n JOIN ks USING (key) LEFT JOIN fe USING (key) LEFT JOIN ct USING (key) LEFT JOIN na USING (key) LEFT JOIN wrk w ON w.entity_key=n.key""")
def _(t):
    lib = t.library
    keys = lib.entity.filter("type in ('topic','organism','modality')").select("key")
    names = lk.entity_names(lib, keys).groupBy("key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))  # a part has one or two
    c = lk.entity_cards(lib, keys).join(names, "key", "left")
    text = F.array_join(F.transform("edges", lambda e: F.concat_ws("|", e["type"], e["direction"], e["rn"], e["other"])), ",")
    counts = F.array_join(F.transform("edge_counts", lambda e: F.concat_ws("=", e["type"], e["n"])), ",")
    return c.select("key", F.col("canonical_name").alias("name"), F.coalesce(F.array_join("aliases", ","), F.lit("")).alias("aliases"),
                    F.coalesce(text, F.lit("")).alias("edges"), F.coalesce(counts, F.lit("")).alias("counts"), F.coalesce("year", F.lit(-1)).alias("year"))
