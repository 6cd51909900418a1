"""Registered source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..plans import ingest
from ..session import stored
from ..sources import documents as docs
from ..sources import exports as ex
from ..sources import star
from .registry import register

_MEMO: dict[tuple[str, str, str], object] = {}


def once(t, name: str, make):
    """A step several queries share, materialised once per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.path, name)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def loaded(t) -> docs.Loaded:
    return once(t, "loaded", lambda: docs.load(star.documents(t)))


def extractions(t):
    files = star.documents(t).select("eid", "path")
    at = F.expr("timestamp '2024-01-01 00:00:00'")
    return once(t, "extractions", lambda: stored(
        loaded(t).good.join(files, "path").select("eid", "sha256", "doc", F.lit(1).alias("tier"), at.alias("created_at")), "extractions"))


BAD = "(p_size=50 OR p_size%10 IN (3,5) OR p_size IN (7,21))"


@register("s01_document_load", f"SELECT p_partkey AS eid, CASE WHEN p_partkey%2=0 THEN 'deep' ELSE 'light' END AS depth, (1990+p_size%20)::INT AS year, p_size=49 AS repaired FROM part WHERE NOT {BAD}")
def _(t):
    files = star.documents(t).select("eid", "path")
    return loaded(t).good.join(files, "path").select("eid", "doc.depth", "doc.paper.year", (F.size("repairs") > 0).alias("repaired"))


@register("a18_problem_grouping", f"""
    SELECT 'doc'||p_partkey||'.yaml' AS path, CASE WHEN p_size=50 THEN 'rxf_version' WHEN p_size%10=3 THEN 'claims.*' WHEN p_size%10=5 THEN 'assets.ideas.*'
      WHEN p_size=7 THEN 'topics.*' ELSE 'user_insights.*.links_to.*' END AS pattern, CASE WHEN p_size=50 THEN 'other' WHEN p_size%10=3 THEN 'missing_field' WHEN p_size%10=5 THEN 'transfer'
      WHEN p_size=7 THEN 'unexpected_field' ELSE 'bad_reference' END AS kind, 1::BIGINT AS places FROM part WHERE {BAD}""")
def _(t):
    return docs.grouped(loaded(t).problems).select("path", "pattern", "kind", "places")


@register("s19_document_report", f"""SELECT 'doc'||p_partkey||'.yaml' AS path, 1::BIGINT AS causes, CASE WHEN p_size%10=5 THEN 2 ELSE 1 END::BIGINT AS problems,
    CASE WHEN p_size%10=5 THEN 'transfer_flattened' WHEN p_size=7 THEN 'topic_new_flag' ELSE '' END AS repairable FROM part WHERE {BAD}""")
def _(t):
    load = loaded(t)
    return docs.report(load.problems, load.parsed).withColumn("repairable", F.array_join("repairable", ","))


@register("x31_drift_repair", f"SELECT count(*) AS good FROM part WHERE NOT (p_size=50 OR p_size%10=3 OR p_size=21)")
def _(t):
    return docs.load(star.documents(t), repair=True).good.agg(F.count("*").alias("good"))


@register("x32_reference_check", "SELECT 'doc'||p_partkey||'.yaml' AS path, 'bad_reference' AS kind, 'c9' AS value FROM part WHERE p_size=21")
def _(t):
    return docs.reference_problems(loaded(t).parsed).select("path", "kind", "value")


@register("f16_stored_versions", f"""SELECT p_partkey AS eid, CASE WHEN p_partkey%5=0 THEN 'unknown version' ELSE 'ok' END AS state FROM part WHERE NOT {BAD}""")
def _(t):
    rows = loaded(t).parsed.join(star.documents(t).select("eid", "path"), "path").join(loaded(t).good.select("path"), "path", "left_semi")
    rows = rows.select(F.col("eid").alias("id"), F.when(F.col("eid") % 5 == 0, "v9").otherwise("v1").alias("schema_version"), F.col("json").alias("output"))
    good, bad = docs.stored(rows)
    return good.select(F.col("id").alias("eid"), F.lit("ok").alias("state")).unionByName(bad.select(F.col("id").alias("eid"), F.col("reason").alias("state")))


@register("s04_file_selection", "SELECT page_id FROM pages WHERE page_id%4<>0 AND page_id%4<>3")
def _(t):
    name = F.when(F.col("page_id") % 4 == 0, F.lit("a.pdf")).when(F.col("page_id") % 4 == 1, F.lit("a.yaml")).when(F.col("page_id") % 4 == 2, F.lit("export.txt")).otherwise(F.lit("notes.txt"))
    body = F.when(F.col("page_id") % 4 == 2, F.concat(F.lit("here you go\nrxf_version: 1\n"), "html")).otherwise(F.col("html"))
    files = t.pages.select("page_id", F.concat(F.lit("in/"), "page_id", F.lit("/"), name).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return docs.candidates(files).select("page_id")


@register("s05_batch_staging", """
    WITH d AS (SELECT 'in/'||c_name||'.yaml' AS path, lower(c_name) AS stem FROM customer), p AS (SELECT lower(s_name) AS x, 'in/Customer#'||lpad(s_suppkey::VARCHAR,9,'0')||'.PDF' AS pdf FROM supplier
      UNION ALL SELECT 'x', 'in/orphan'||n_nationkey||'.pdf' FROM nation), q AS (SELECT lower(regexp_replace(split_part(pdf,'/',2),'\\.[^.]*$','')) AS stem, pdf FROM p)
    SELECT d.path, coalesce(q.pdf,'') AS pdf_path FROM d LEFT JOIN q USING (stem) UNION ALL SELECT '', pdf FROM q WHERE stem NOT IN (SELECT stem FROM d)""")
def _(t):
    files = (t.customer.select(F.concat(F.lit("in/"), "c_name", F.lit(".yaml")).alias("path"))
             .unionByName(t.supplier.select(F.concat(F.lit("in/Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".PDF")).alias("path")))
             .unionByName(t.nation.select(F.concat(F.lit("in/orphan"), "n_nationkey", F.lit(".pdf")).alias("path"))))
    pairs, orphans = docs.pair_pdfs(files)
    return pairs.select("path", F.coalesce("pdf_path", F.lit("")).alias("pdf_path")).unionByName(orphans.select(F.lit("").alias("path"), "pdf_path"))


@register("s06_batch_resume", """SELECT 'todo' AS what, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'failed', doc_id FROM labels WHERE quality=0""")
def _(t):
    todo = t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return todo.select(F.lit("todo").alias("what"), "doc_id").unionByName(t.labels.filter("quality = 0").select(F.lit("failed").alias("what"), "doc_id"))


@register("s07_content_store", """SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def _(t):
    known = t.documents.join(t.labels, "doc_id").select(F.sha2("text", 256).alias("sha256"))
    files = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return docs.new_objects(files, known).select("sha256")


@register("s08_replay_order", """
    WITH c AS (SELECT sha256(text) AS h, min(conv_id*100+turn) AS k FROM conversations GROUP BY 1)
    SELECT h AS sha256, row_number() OVER (ORDER BY k%50, h) AS seq FROM c WHERE k%3<>0""")
def _(t):
    caps = t.conversations.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min(F.col("conv_id") * 100 + F.col("turn")).alias("k"))
    known = caps.filter("k % 3 = 0").select("sha256")
    return docs.to_replay(caps.withColumn("captured_at", F.col("k") % 50), known).select("sha256", "seq")


@register("s09_integrity", """
    SELECT 'missing' AS what, 'k'||p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity>10)
    UNION ALL SELECT 'unknown', 'f'||l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity>10) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size<40)
      AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size>=60)
    UNION ALL SELECT 'empty', 'f'||p_partkey FROM part WHERE p_size=1 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity>10)""")
def _(t):
    objects = t.part.select(F.concat(F.lit("k"), "p_partkey").alias("sha256"))
    held = t.lineitem.filter("l_quantity > 10").select(F.col("l_partkey").alias("p_partkey")).distinct()
    listing = t.part.join(held, "p_partkey").select(F.concat(F.lit("k"), "p_partkey").alias("sha256"), F.concat(F.lit("f"), "p_partkey").alias("name"), F.when(F.col("p_size") == 1, 0).otherwise(10).alias("length"))
    return docs.integrity(objects, listing)


META = "(SELECT 'rec'||o_orderkey AS id, 'd'||(o_orderkey%4000) AS doi FROM orders WHERE o_orderstatus='F')"


@register("s10_metadata_attach", f"""
    WITH w AS (SELECT p_partkey AS k, 'd'||(p_partkey*3) AS doi FROM part WHERE p_size>5), m AS {META}
    SELECT k AS key, coalesce(min(m.id),'') AS metadata_id, CASE WHEN min(m.id) IS NULL THEN 'not_found' ELSE 'attached' END AS status FROM w LEFT JOIN m USING (doi) GROUP BY k""")
def _(t):
    return attach(t).withColumn("metadata_id", F.coalesce("metadata_id", F.lit("")))


def attach(t):
    meta = t.orders.filter("o_orderstatus = 'F'").selectExpr("concat('rec', o_orderkey) id", "concat('d', o_orderkey % 4000) doi")
    papers = t.part.selectExpr("p_partkey key", "p_size", "concat('d', p_partkey * 3) doi")
    return ex.attach_metadata(papers.select("key"), papers.select("key", "doi"), meta, papers.filter("p_size <= 5").select("key"))


@register("s11_metadata_backfill", f"""
    WITH w AS (SELECT p_partkey AS k, 'd'||(p_partkey*3) AS doi FROM part WHERE p_size>5), m AS {META}
    SELECT CASE WHEN n=0 THEN 'not_found' ELSE 'attached' END AS status, count(*) AS n FROM (SELECT k, count(m.id) AS n FROM w LEFT JOIN m USING (doi) GROUP BY k) GROUP BY 1""")
def _(t):
    return attach(t).groupBy("status").agg(F.count("*").alias("n"))


def registries(t):
    acc = t.customer.selectExpr("concat('GSE', 1000 + c_custkey % 400) accession", "c_custkey % 400 < 200 found").distinct()
    repos = t.supplier.selectExpr("concat('github.com/lab/tool', s_suppkey) repo", "s_suppkey % 2 = 0 found").distinct()
    return acc, repos


@register("s12_id_checks", f"""
    WITH d AS (SELECT p_partkey AS eid, CASE WHEN p_size=11 THEN 'made-up' ELSE 'GSE'||(1000+p_partkey%300) END AS acc, p_partkey%300 AS r, p_partkey%97 AS k FROM part WHERE NOT {BAD}),
    have AS (SELECT DISTINCT c_custkey%400 AS r FROM customer)
    SELECT eid, acc AS item, CASE WHEN acc='made-up' THEN 'bad_format' WHEN r NOT IN (SELECT r FROM have) THEN 'unverified' WHEN r<200 THEN 'verified' ELSE 'not_found' END AS status FROM d
    UNION ALL SELECT eid, 'github.com/lab/tool'||k, CASE WHEN k NOT IN (SELECT s_suppkey FROM supplier) THEN 'unverified' WHEN k%2=0 THEN 'verified' ELSE 'not_found' END FROM d""")
def _(t):
    return ingest.check_ids(extractions(t), *registries(t))


@register("s13_taxon_lookup", f"""SELECT DISTINCT p_type AS name, CASE WHEN p_type IN ('ECONOMY','SMALL') THEN length(p_type)::VARCHAR ELSE '' END AS taxon_id FROM part WHERE NOT {BAD}""")
def _(t):
    tax = t.part.filter("p_type in ('ECONOMY','SMALL')").selectExpr("p_type name", "cast(length(p_type) as string) taxon_id").distinct()
    return ingest.check_taxa(extractions(t), tax).withColumn("taxon_id", F.coalesce("taxon_id", F.lit("")))


@register("s14_controlled_vocabulary", "SELECT p_partkey, CASE p_size%4 WHEN 0 THEN 'whole-genome sequencing' WHEN 1 THEN 'bulk RNA-seq' WHEN 2 THEN 'Hi-C' ELSE '' END AS modality FROM part")
def _(t):
    raw = F.when(F.col("p_size") % 4 == 0, "wgs").when(F.col("p_size") % 4 == 1, "RNAseq").when(F.col("p_size") % 4 == 2, " hi c ").otherwise("sonar")
    names = F.broadcast(ingest.modality_names(t.spark))  # fixed size
    p = t.part.select("p_partkey", ingest.norm(raw).alias("norm"))
    return p.join(names, "norm", "left").select("p_partkey", F.coalesce("name", F.lit("")).alias("modality"))


@register("s15_library_export", """SELECT 'entities' AS file, count(*) AS n FROM ent UNION ALL SELECT 'aliases', count(*) FROM als
    UNION ALL SELECT 'edges', count(*) FROM edg WHERE src IN (SELECT key FROM ent) AND dst IN (SELECT key FROM ent)""")
def _(t):
    out = None
    for name, df in ex.library_rows(t.library).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("file"), "n")
        out = one if out is None else out.unionByName(one)
    return out


VOCAB = """voc AS (SELECT CASE n.status WHEN 'active' THEN 'topics' ELSE 'candidate_topics' END AS section, n.canonical_name AS name, n.key, coalesce(papers,0) AS papers, coalesce(parents,'') AS parents
    FROM ent n LEFT JOIN (SELECT e.dst, count(DISTINCT e.src) AS papers FROM edg e JOIN ent w ON w.key=e.src AND w.type='work' WHERE e.type IN ('about','applicable_to') AND e.status<>'rejected' GROUP BY 1) p ON p.dst=n.key
    LEFT JOIN (SELECT e.src, string_agg(DISTINCT d.canonical_name, ',' ORDER BY d.canonical_name) AS parents FROM edg e JOIN ent d ON d.key=e.dst WHERE e.type='is_a' AND e.status<>'rejected' GROUP BY 1) q ON q.src=n.key
    WHERE n.type='topic' AND (n.status='active' OR (n.status='candidate' AND coalesce(papers,0)>=1)))"""


@register("s16_vocabulary", f"WITH {VOCAB} SELECT * FROM voc")
def _(t):
    return ex.vocabulary(t.library)


@register("s17_export_staleness", "SELECT 'same' AS what, false AS stale UNION ALL SELECT 'active only', true")
def _(t):
    v = ex.vocabulary(t.library)
    same = ex.is_stale(v, ex.fingerprint(v)).select(F.lit("same").alias("what"), "stale")
    return same.unionByName(ex.is_stale(v, ex.fingerprint(ex.vocabulary(t.library, False))).select(F.lit("active only").alias("what"), "stale"))


@register("s20_code_context", "SELECT p_partkey, p_type||chr(10)||'look at '||p_name AS context FROM part")
def _(t):
    src = F.concat(F.lit("#SBATCH --time=1\nimport os, "), "p_type", F.lit(" as x\n# look at "), "p_name", F.lit("\nx = 1\n"))
    return t.part.select("p_partkey", ex.code_context(src).alias("context"))


@register("v11_recall_code")
def _(t):
    """Scripts that mention each part's name, and what they should remind of."""
    from ..operators import retrieval as rt
    from ..operators import rollups as ru
    from .q_retrieval import vectors_of
    lib = t.library
    src = F.concat(F.lit("import numpy\n# about "), "p_name", F.lit("\n"))
    q = t.part.select("p_name").distinct().select(F.col("p_name").alias("q"), ex.code_context(src).alias("text"))
    return rt.recall(lib, q, vectors_of(lib), ru.view_log(star.views_log(t)), F.expr("timestamp '2024-02-01 00:00:00'"), types=("dataset", "method", "idea", "claim"))


@register("s21_decision_log", """SELECT id, op, total FROM (SELECT id, op, count(*) OVER () AS total FROM dec WHERE revoked_at IS NULL AND created_at>=TIMESTAMP '2024-01-10') ORDER BY id DESC LIMIT 50 OFFSET 25""")
def _(t):
    from ..operators.ranking import page
    d = star.decisions(t).filter("revoked_at is null and created_at >= timestamp '2024-01-10 00:00:00'").select("id", "op")
    return page(d, [F.desc("id")], 50, 25).select("id", "op", "total")


@register("x13_url_cleaning", """WITH u AS (SELECT page_id, regexp_extract(url,'^https?://(?:www\\.|m\\.)?([^/]+)/([^/?#]+)',1) AS host,
    regexp_extract(url,'^https?://(?:www\\.|m\\.)?([^/]+)/([^/?#]+)',2) AS first FROM pages)
    SELECT page_id, CASE WHEN regexp_full_match(host,'[\\w.\\-]+') AND regexp_matches(first,'^[\\w.\\-]') THEN regexp_replace('github.com/'||lower(host)||'/'||
      regexp_extract(lower(first),'^[\\w.\\-]+'),'\\.git$','') END AS repo FROM u""")
def _(t):
    asrepo = F.regexp_replace("url", "^https?://(?:www\\.|m\\.)?([^/]+)/", "https://github.com/$1/")
    return t.pages.select("page_id", ids.repo(asrepo).alias("repo"))


@register("x16_download_class", """SELECT l_partkey, CASE l_partkey%5 WHEN 0 THEN 'series:GSE'||CASE WHEN length(l_partkey::VARCHAR)>3 THEN substr(l_partkey::VARCHAR,1,length(l_partkey::VARCHAR)-3) ELSE '' END||'nnn'
    WHEN 1 THEN 'run' WHEN 2 THEN 'project' WHEN 3 THEN 'zenodo:'||l_partkey ELSE 'other' END AS cls FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
def _(t):
    k = F.col("l_partkey")
    acc = (F.when(k % 5 == 0, F.concat(F.lit("GSE"), k)).when(k % 5 == 1, F.concat(F.lit("SRR"), k)).when(k % 5 == 2, F.concat(F.lit("PRJNA"), k))
           .when(k % 5 == 3, F.concat(F.lit("10.5281/zenodo."), k)).otherwise(F.concat(F.lit("lab data "), k)))
    return t.lineitem.select("l_partkey").distinct().select("l_partkey", ids.download_class(acc, F.lit(None).cast("string")).alias("cls"))


