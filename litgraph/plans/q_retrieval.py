"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..functions.embed import hash_features
from ..operators import retrieval as rt
from ..operators import ranking as rk
from ..operators import rollups as ru
from ..operators import vector_index as vi
from ..model import SEARCH_TYPES
from ..operators.filters import Filters
from ..session import broadcast_if_small
from ..sources import star
from .q_joins import probe_works
from .registry import NORM, register

DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"


def units(t, ids: str = "concat('asset:', vec_id)"):
    return t.embeddings.selectExpr(f"{ids} id", "label", "vec_id", "embedding vec")


@register("v01_hash_embedding", f"""
    WITH n AS (SELECT p_partkey AS id, {NORM.format('p_name')} AS s FROM part),
    f AS (SELECT id, 'w:'||unnest(regexp_extract_all(s,'[a-z0-9]+')) AS f, 1.0 AS w FROM n
      UNION ALL SELECT id, 'c:'||substr(' '||s||' ', i, 3), 0.5 FROM n, generate_series(1, 60) g(i) WHERE i<=length(s)),
    b AS (SELECT id, ('0x'||substr(md5(f),1,8))::BIGINT % 1024 AS bucket, sum(CASE WHEN substr(md5(f),9,1) IN ('8','9','a','b','c','d','e','f') THEN w ELSE -w END) AS v FROM f GROUP BY 1,2),
    l AS (SELECT id, sqrt(sum(v*v)) AS len FROM b GROUP BY 1)
    SELECT id, bucket, round(v/len,5) AS weight FROM b JOIN l USING (id) WHERE v<>0""")
def _(t):
    v = hash_features(t.part.selectExpr("p_partkey id", "p_name"), "id", tx.norm_ascii(F.col("p_name")))
    return v.select("id", "bucket", F.round("weight", 5).alias("weight"))


KNN = f"""pr AS (SELECT label AS lab, arg_min(embedding, vec_id) AS v, min(vec_id) AS pid FROM embeddings GROUP BY 1),
    s AS (SELECT pid AS probe, vec_id AS id, round({DOT.format('v', 'embedding')},6) AS sim FROM pr, embeddings WHERE vec_id<>pid)"""


def label_probes(t):
    return t.embeddings.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("m")).select(
        F.col("m.vec_id").alias("id"), F.col("m.embedding").alias("vec"))


@register("v03_knn", f"""WITH {KNN} SELECT probe, id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY sim DESC, id) AS rank FROM s) WHERE rank<=20""")
def _(t):
    return rt.top_similar(units(t, "vec_id"), label_probes(t), 20)


@register("j22_vector_neighbour_grid", f"""WITH {KNN} SELECT probe, id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY sim DESC, id) AS rank FROM s) WHERE rank<=20""")
def _(t):
    """The same neighbours by inverted lists and their bounds, which serve probe sets too large to send around."""
    return vi.nearest(units(t, "vec_id"), label_probes(t), 20, exact=True, lists=4, list_rows=50)


@register("v18_index_recall", """SELECT count(*) AS probes, 10*count(*) AS wanted, true AS reached FROM embeddings""")
def _(t):
    """Whether the nearest lists hold nine of ten true neighbours, over every vector as a probe."""
    u = units(t, "vec_id")
    found = vi.nearest(u, u, 10, list_rows=25)
    return vi.recall(found, vi.nearest(u, u, 10, exact=True)).select("probes", "wanted", (F.col("recall") >= 0.9).alias("reached"))


@register("o03_top_k_types", f"""WITH {KNN} SELECT probe, id, sim, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY probe ORDER BY sim DESC, id) AS rank
    FROM s JOIN embeddings e ON e.vec_id=s.id WHERE e.label IN (1,3,5)) WHERE rank<=5""")
def _(t):
    return rt.top_similar(units(t, "vec_id").filter("label in (1,3,5)"), label_probes(t), 5)


@register("v04_similar_pairs", f"""
    WITH src AS (SELECT vec_id, embedding, label FROM embeddings),
    s AS (SELECT a.vec_id AS src, b.vec_id AS other, a.label AS la, b.label AS lb, round({DOT.format('a.embedding', 'b.embedding')},6) AS sim FROM src a JOIN embeddings b ON a.vec_id<>b.vec_id)
    SELECT src, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, other) AS rn FROM s WHERE sim>=0.3) WHERE rn<=10 AND la<>lb""")
def _(t):
    u = units(t, "vec_id")
    hits = vi.nearest(u, u, 10, 0.3, exact=True)
    lab = u.select("id", "label")
    return (hits.join(lab, "id").join(lab.select(F.col("id").alias("probe"), F.col("label").alias("pl")), "probe").filter("label != pl")
            .select(F.col("probe").alias("src"), F.col("id").alias("other"), "sim"))


STOP = ",".join(f"'{w}'" for w in tx.STOPWORDS)
TERMS = f"""qs AS (SELECT item_id AS q, regexp_extract_all({NORM.format("replace(lower(text),'ß','ss')")}, '[a-z0-9]+') AS ws FROM benchmark),
    qw AS (SELECT q, unnest(ws) AS w, generate_subscripts(ws,1) AS i FROM qs), qd AS (SELECT q, w, min(i) AS i FROM qw GROUP BY 1,2),
    qt AS (SELECT q, w AS term FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY length(w) DESC, i) AS r FROM qd WHERE length(w)>=3 AND w NOT IN ({STOP}))),
    dw AS (SELECT id, w, count(*) AS c FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text),'[a-z0-9]+')) AS w FROM documents) WHERE length(w)>=3 GROUP BY 1,2),
    vt AS (SELECT w, term, len(list_filter(generate_series(1,length(w)-length(term)+1), lambda i: substr(w,i,length(term))=term)) AS times
      FROM (SELECT DISTINCT w FROM dw) v JOIN (SELECT DISTINCT term FROM qt) x ON contains(v.w, x.term)),
    tf AS (SELECT id, term, sum(c*times) AS tf FROM dw JOIN vt USING (w) GROUP BY 1,2),
    sz AS (SELECT doc_id AS id, greatest(length(text)-2,0) AS len FROM documents),
    tt AS (SELECT count(*) AS n, avg(len) AS av FROM sz),
    idf AS (SELECT term, CASE WHEN ln((n-df+0.5)/(df+0.5))>0 THEN ln((n-df+0.5)/(df+0.5)) ELSE 1e-6 END AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), tt),
    sco AS (SELECT q, id, round(sum(idf*tf*2.2/(tf+1.2*(0.25+0.75*len/av))),6) AS score FROM tf JOIN sz USING (id) JOIN idf USING (term) JOIN qt USING (term), tt GROUP BY 1,2),
    kw AS (SELECT q, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sco) WHERE rank<=200)"""


def passages(t):
    return t.benchmark.select(F.col("item_id").alias("q"), "text"), t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))


@register("x06_query_terms", f"""WITH {TERMS.split('dw AS')[0].rstrip().rstrip(',')}, o AS (SELECT q, w, row_number() OVER (PARTITION BY q ORDER BY length(w) DESC, i) AS r
    FROM qd WHERE length(w)>=3 AND w NOT IN ({STOP})) SELECT qt.q, term, r<={tx.MAX_LATIN_TERMS} AS bounded FROM qt JOIN o ON o.q=qt.q AND o.w=term""")
def _(t):
    """All terms of each question, and which of them an interactive query keeps."""
    q, _d = passages(t)
    n = tx.norm(F.col("text"))
    q = q.select("q", tx.query_terms(n).alias("all"), tx.query_terms(n, tx.MAX_LATIN_TERMS, tx.MAX_HAN_TERMS).alias("first"))
    return q.select("q", F.explode("all").alias("term"), "first").select("q", "term", F.array_contains("first", F.col("term")).alias("bounded"))


@register("v05_keyword_search", f"WITH {TERMS} SELECT q, id, score FROM kw")
def _(t):
    q, d = passages(t)
    return rt.keyword_search(d, q).select("q", "id", "score")


ANCHOR_CHARS = 6


def holding(t):
    """(q, key): the documents that contain a passage. Both sides meet on a run of six words that stands inside the
    passage, or on the first characters of its longest word where it is too short for one; then the whole passage is
    checked. The anchors of the benchmark meet the texts inside the scan when they are few."""
    q, d = passages(t)
    split = lambda c: F.filter(F.split(c, "\\s+"), lambda w: F.length(w) > 0)
    asked = q.select("q", "text", split("text").alias("w"))
    runs = F.when(F.size("w") >= 6, F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " ")))
    long = asked.filter(F.size("w") >= 8).select("q", F.array_join(F.slice("w", 2, 6), " ").alias("anchor"))
    by_run = d.select("id", split("body").alias("w")).select("id", F.explode(F.array_distinct(runs)).alias("anchor")).join(broadcast_if_small(long), "anchor")
    head = F.substring(F.element_at(F.array_sort(F.transform("w", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"], 1, ANCHOR_CHARS)
    short = asked.filter(F.size("w").between(1, 7)).select("q", head.alias("anchor")).withColumn("n", F.length("anchor"))
    # pieces of each length that an anchor has, at most ANCHOR_CHARS lengths
    sizes = short.groupBy().agg(F.collect_set("n").alias("sizes"))
    pieces = F.flatten(F.transform("sizes", lambda n: F.when(F.length("body") >= n, F.transform(
        F.sequence(F.lit(1), F.length("body") - n + 1), lambda i: F.substr(F.col("body"), i, n))).otherwise(F.array().cast("array<string>"))))
    lengths = sizes.first()["sizes"]
    met = by_run.select("q", "id")
    if lengths:
        of = d.withColumn("sizes", F.array(*[F.lit(n) for n in lengths])).select("id", F.explode(F.array_distinct(pieces)).alias("anchor"))
        met = met.unionByName(of.join(broadcast_if_small(short.select("q", "anchor")), "anchor").select("q", "id"))
    return met.distinct().join(d, "id").join(q, "q").filter(F.col("body").contains(F.col("text"))).select("q", F.col("id").alias("key"))


@register("a12_retrieval_metrics", f"""WITH {TERMS},
    ex AS (SELECT item_id AS q, doc_id AS key FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    fr AS (SELECT ex.q, min(rank) AS rank FROM ex LEFT JOIN kw ON kw.q=ex.q AND kw.id=ex.key AND rank<=10 GROUP BY 1)
    SELECT round(avg(CASE WHEN rank=1 THEN 1.0 ELSE 0.0 END),4) AS hit_at_1, round(avg(CASE WHEN rank<=5 THEN 1.0 ELSE 0.0 END),4) AS hit_at_5,
      round(avg(coalesce(1.0/rank,0)),4) AS mrr, count(*) FILTER (rank IS NULL) AS missed, count(*) AS questions FROM fr""")
def _(t):
    q, d = passages(t)
    ranked = rt.keyword_search(d, q).filter("rank <= 10").select("q", F.col("id").alias("key"), "rank")
    return ru.retrieval_metrics(ranked, holding(t))


@register("s22_benchmark_expectations", """SELECT item_id AS q, doc_id AS key FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def _(t):
    return holding(t)


@register("v06_rank_fusion", """
    WITH a AS (SELECT kind AS q, id, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank FROM que),
    b AS (SELECT kind AS q, id, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id) AS rank FROM que)
    SELECT q, id AS key, round(sum(1.0/(60+rank)),7) AS fused FROM (SELECT * FROM a WHERE rank<=200 UNION ALL SELECT * FROM b WHERE rank<=200) GROUP BY 1,2""")
def _(t):
    q = star.queue(t).select(F.col("kind").alias("q"), F.col("id").alias("key"), "score", "created_at")
    a = rk.top_per(q, ["q"], [F.desc("score"), F.col("key")], 200, rank="rank")
    b = rk.top_per(q, ["q"], [F.desc("created_at"), F.col("key")], 200, rank="rank")
    return rt.fuse(a, b).select("q", "key", F.round("fused", 7).alias("fused"))


def line_pairs(t):
    """Part name against its supplier nation's name and brand: one text pair per line item group."""
    return (t.lineitem.select("l_partkey", "l_suppkey").distinct().join(t.part, F.col("p_partkey") == F.col("l_partkey"))
            .join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("p_name", "s_nationkey").agg(F.min("p_type").alias("p_type"))
            .selectExpr("p_name", "s_nationkey", "concat(lower(p_type), ' ', p_name, ' ', s_nationkey) b"))


@register("v08_lexical_overlap", """
    WITH p AS (SELECT p_name, s_nationkey, lower(min(p_type))||' '||p_name||' '||s_nationkey AS b FROM lineitem JOIN part ON p_partkey=l_partkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1,2),
    f AS (SELECT *, list_distinct(regexp_extract_all(p_name,'[a-z0-9]+')) AS ta, list_distinct(regexp_extract_all(b,'[a-z0-9]+')) AS tb,
      list_distinct(list_transform(generate_series(1,length(p_name)), lambda i: substr(' '||p_name||' ',i,3))) AS ga,
      list_distinct(list_transform(generate_series(1,length(b)), lambda i: substr(' '||b||' ',i,3))) AS gb FROM p),
    c AS (SELECT *, len(list_intersect(ta,tb)) AS tc, len(list_intersect(ga,gb)) AS gc FROM f)
    SELECT p_name, s_nationkey, round(greatest(tc/(len(ta)+len(tb)-tc), 2.0*gc/(len(ga)+len(gb)), 0.75*tc/least(len(ta),len(tb))),4) AS score FROM c""")
def _(t):
    p = line_pairs(t)
    ta, ga = sc.sides(tx.norm_ascii(F.col("p_name")))
    tb, gb = sc.sides(tx.norm_ascii(F.col("b")))
    s = p.withColumn("ta", ta).withColumn("ga", ga).withColumn("tb", tb).withColumn("gb", gb)
    return s.select("p_name", "s_nationkey", F.round(sc.overlap(F.col("ta"), F.col("tb"), F.col("ga"), F.col("gb")), 4).alias("score"))


def vectors_of(lib):
    """(key, vec) of every indexed entity, as they are asked for; each different text is embedded once."""
    return rt.Indexed(lib, lib.entity.limit(0).selectExpr("key text_sha", "type model", "cast(null as array<float>) vec"), "hash")


def name_questions(t):
    return t.part.select(F.col("p_name").alias("q"), F.col("p_name").alias("text")).distinct()


@register("v02_entity_indexing", """SELECT type, count(*) AS n FROM ent WHERE type IN ('work','dataset','method','idea','claim','topic') GROUP BY 1""")
def _(t):
    lib = t.library
    return vectors_of(lib).of().filter(F.size("vec") == 1024).join(lib.entity.select("key", "type"), "key").groupBy("type").agg(F.count("*").alias("n"))


@register("v07_rerank")
def _(t):
    """Every distinct (part name, nation name) pair of the line items scored by the reranker."""
    p = line_pairs(t)
    return rt.lexical_scores(p, "p_name", "b").select("p_name", "s_nationkey", F.col("rel").alias("score"))


@register("v09_hybrid_search")
def _(t):
    lib = t.library
    return rt.search(lib, name_questions(t), vectors_of(lib), Filters(types=SEARCH_TYPES), limit=20)


@register("v10_recall")
def _(t):
    lib = t.library
    return rt.recall(lib, name_questions(t), vectors_of(lib), ru.view_log(star.views_log(t)), F.expr("timestamp '2024-02-01 00:00:00'"))


@register("v12_related_works")
def _(t):
    return rt.related_works(t.library, probe_works(t.library), vectors_of(t.library), ru.view_log(star.views_log(t)), F.expr("timestamp '2024-02-01 00:00:00'"))


@register("v13_related_entities")
def _(t):
    """What is close to each topic's own text, itself left out."""
    lib = t.library
    q = lib.entity.filter("type = 'topic'").select(F.col("key").alias("q"), F.col("canonical_name").alias("text"))
    hits = rt.recall(lib, q, vectors_of(lib), ru.view_log(star.views_log(t)), F.expr("timestamp '2024-02-01 00:00:00'"), limit=9, floor=0.0, types=SEARCH_TYPES)
    return rk.top_per(hits.filter("q != key"), ["q"], [F.col("pos")], 8).select("q", "key", "score", "pos")


@register("v14_synthesis_candidates", f"""
    WITH ast AS (SELECT key, status, created_at FROM ent WHERE type IN ('dataset','method','idea','claim')),
    vv AS (SELECT 'asset:'||vec_id AS key, label, embedding FROM embeddings WHERE 'asset:'||vec_id IN (SELECT key FROM ast)),
    rc AS (SELECT key FROM ast WHERE created_at>=TIMESTAMP '1998-06-01'),
    s AS (SELECT a.key AS src, b.key AS other, a.label AS la, b.label AS lb, round({DOT.format('a.embedding', 'b.embedding')},6) AS sim FROM vv a JOIN rc ON rc.key=a.key JOIN vv b ON a.key<>b.key),
    p10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, other) AS rn FROM s WHERE sim>=0.25) WHERE rn<=10),
    okk AS (SELECT key FROM ast WHERE status<>'rejected'),
    cand AS (SELECT src, other, sim AS score FROM p10 WHERE la<>lb AND src IN (SELECT key FROM okk) AND other IN (SELECT key FROM okk)),
    le AS (SELECT src, dst FROM edg WHERE status<>'rejected'), adj AS (SELECT src AS node, dst AS other FROM le UNION SELECT dst, src FROM le),
    opn AS (SELECT key FROM ent WHERE type NOT IN ('organism','modality')),
    far AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM adj WHERE node=c.src AND other=c.other)
      AND NOT EXISTS (SELECT 1 FROM adj x JOIN adj y ON x.other=y.other WHERE x.node=c.src AND y.node=c.other AND x.other IN (SELECT key FROM opn))),
    u AS (SELECT src, other, score FROM (SELECT *, row_number() OVER (PARTITION BY least(src,other), greatest(src,other) ORDER BY score DESC, src, other) AS r FROM far) WHERE r=1)
    SELECT src, other, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, other) AS rn FROM u) WHERE rn<=2 ORDER BY score DESC, src, other LIMIT 20""")
def _(t):
    u = units(t)
    comm = u.select(F.col("id").alias("key"), F.col("label").alias("community"))
    known = star.queue(t).select("dedupe_key")
    return rt.synthesis_candidates(t.library, u.select(F.col("id").alias("key"), "vec"), comm, F.expr("timestamp '1998-06-01 00:00:00'"), known, 0.25)


@register("v15_threshold_tuning", """
    SELECT 'm'||model AS model, round(list_reduce([0.0::DOUBLE]||list(CASE WHEN useful THEN -0.016::DOUBLE ELSE 0.004::DOUBLE END ORDER BY id), lambda a, c: greatest(-0.15::DOUBLE, least(0.15::DOUBLE, a+c))),4) AS delta
    FROM (SELECT event_id AS id, event_type AS model, value>90 AS useful FROM events) GROUP BY 1""")
def _(t):
    fb = t.events.selectExpr("concat('m', event_type) model", "event_id id", "value > 90 useful")
    return rt.tuned_delta(fb)


@register("v16_weekly_digest", """
    WITH pd AS (SELECT id, kind, score, json_extract_string(payload,'$.a') AS a, json_extract_string(payload,'$.b') AS b FROM que WHERE status='pending')
    SELECT 'pair' AS what, a, b, score FROM (SELECT * FROM pd WHERE kind='synthesis' ORDER BY score DESC, id LIMIT 30) WHERE a IN (SELECT key FROM ent) AND b IN (SELECT key FROM ent)
    UNION ALL SELECT 'contested', src, dst, 0.0 FROM edg WHERE type='contradicts' AND status<>'rejected' AND created_at>=TIMESTAMP '2001-05-01'
    UNION ALL SELECT 'waiting', a, b, score FROM pd WHERE kind='contradiction'""")
def _(t):
    return rt.weekly_digest(t.library, star.queue(t), F.expr("timestamp '2001-07-15 00:00:00'"), F.expr("timestamp '2001-05-01 00:00:00'"))


@register("v17_cache_prune", """SELECT sha256(text) AS text_sha FROM conversations WHERE role<>'system' AND text IN (SELECT text FROM conversations WHERE turn<3) GROUP BY 1""")
def _(t):
    cache = t.conversations.select(F.sha2("text", 256).alias("text_sha"), F.when(F.col("role") == "system", "old").otherwise("m").alias("model")).distinct()
    return rt.prune_vector_cache(cache, t.conversations.filter("turn < 3"), "m").select("text_sha")


@register("c08_topic_relation_candidates")
def _(t):
    from ..operators.resolution import topic_relation_candidates
    lib = t.library
    apart = star.decisions(t).filter("op = 'distinct' and revoked_at is null").selectExpr("concat('topic:s', a) a", "concat('topic:s', b) b")
    topics = lib.entity.filter("type = 'topic'").select("key", "canonical_name")
    new = lib.entity.filter("type = 'topic' and status = 'candidate'").select("key", "canonical_name")
    return topic_relation_candidates(new, topics, apart)

