"""Registered text-column queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import scoring as sc
from ..functions import text as tx
from ..functions.entity import entity_text, topic_definition
from ..sources import documents as docs
from ..sources import star
from .registry import NORM, register


@register("x02_token_counts", f"""SELECT doc_id, len(regexp_extract_all({NORM.format("replace(lower(text),'ß','ss')")}, '[a-z0-9]+'))::INT AS tokens,
    len(list_distinct(regexp_extract_all({NORM.format("replace(lower(text),'ß','ss')")}, '[a-z0-9]+')))::INT AS words FROM documents""")
def _(t):
    d = t.documents.select("doc_id", tx.tokens(tx.norm(F.col("text"))).alias("w"))
    return d.select("doc_id", F.size("w").alias("tokens"), F.size(F.array_distinct("w")).alias("words"))


@register("x04_trigrams", f"""WITH n AS (SELECT item_id, ' '||{NORM.format("replace(lower(text),'ß','ss')")}||' ' AS s FROM benchmark)
    SELECT item_id, substr(s, i, 3) AS gram, count(*) AS n FROM n, generate_series(1, 100000) g(i) WHERE i<=length(s)-2 GROUP BY 1,2""")
def _(t):
    n = t.benchmark.select("item_id", tx.norm(F.col("text")).alias("n"))
    return n.select("item_id", F.explode(tx.char_ngrams(F.col("n"))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@register("x07_language", "SELECT doc_id, 'en' AS by_script, CASE WHEN lang='zh' THEN 'en' ELSE lang END AS alias_lang FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.lang_of(F.col("text")).alias("by_script"), tx.alias_language(F.concat(F.upper("lang"), F.lit("_XX"))).alias("alias_lang"))


@register("x08_hashes", "SELECT doc_id, sha256(text) AS sha, substr(sha256(text),1,20) AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2("text", 256), 1, 20).alias("short"))


@register("x18_evidence_strength", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax>0.06 OR l_returnflag='N' THEN 'weak' WHEN l_returnflag='A' THEN 'strong' ELSE 'medium' END AS strength FROM lineitem""")
def _(t):
    kind = F.when(F.col("l_returnflag") == "N", "speculative").when(F.col("l_returnflag") == "A", "causal").otherwise("correlational")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sc.strength(kind, F.col("l_tax") > 0.06).alias("strength"))


NEG = "('not','no','never','none','cannot','without','fails','fail','neither','nor')"


@register("x19_negation", f"""SELECT conv_id, turn, len(list_filter(regexp_extract_all({NORM.format("replace(text,'n''t',' not')")}, '[a-z0-9]+'), lambda w: w IN {NEG}))%2=1 AS negated FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", sc.negated(F.col("text")).alias("negated"))


@register("x20_opposite_polarity", f"""WITH c AS (SELECT p_partkey, 'the '||p_name||CASE WHEN p_size%2=0 THEN ' increases ' ELSE ' decreases ' END||'yield'||CASE WHEN p_size%5=0 THEN ' not' ELSE '' END AS a FROM part)
    SELECT p_partkey, ((a LIKE '%not') OR (a LIKE '%decreases%')) AND NOT ((a LIKE '%not') AND (a LIKE '%decreases%') AND false) AS opposite FROM c""")
def _(t):
    """Each statement against 'the thing increases yield'."""
    a = F.concat(F.lit("the "), "p_name", F.when(F.col("p_size") % 2 == 0, " increases ").otherwise(" decreases "), F.lit("yield"), F.when(F.col("p_size") % 5 == 0, " not").otherwise(""))
    b = F.concat(F.lit("the "), "p_name", F.lit(" increases yield"))
    p = t.part.select("p_partkey", sc.negated(a).alias("na"), sc.directions(a).alias("da"), sc.negated(b).alias("nb"), sc.directions(b).alias("db"))
    return p.select("p_partkey", sc.opposite(F.col("na"), F.col("da"), F.col("nb"), F.col("db")).alias("opposite"))


@register("x22_entity_text", """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY','LARGE') THEN p_name||chr(10)||p_brand||chr(10)||p_type WHEN p_type IN ('MEDIUM','PROMO') THEN p_name
    ELSE p_name END AS text FROM part""")
def _(t):
    etype = F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "dataset").when(F.col("p_type").isin("MEDIUM", "PROMO"), "method").otherwise("claim")
    attrs = F.create_map(F.lit("accession"), F.col("p_brand"), F.lit("tissue"), F.col("p_type"), F.lit("scale"), F.lit(""))
    return t.part.select("p_partkey", entity_text(etype, F.col("p_name"), attrs).alias("text"))


@register("x23_topic_definition", """SELECT s_suppkey, s_name||chr(10)||'def '||s_nationkey||chr(10)||'Examples: a; b'||CASE WHEN s_acctbal<0 THEN chr(10)||'Not: c' ELSE '' END AS text FROM supplier""")
def _(t):
    attrs = F.create_map(F.lit("definition"), F.concat(F.lit("def "), F.col("s_nationkey")), F.lit("examples"), F.lit("a\nb"), F.lit("counter_examples"), F.when(F.col("s_acctbal") < 0, "c").otherwise(""))
    return t.supplier.select("s_suppkey", topic_definition(F.col("s_name"), attrs).alias("text"))


@register("x24_forgetting", """WITH l AS (SELECT entity_key, max(ts) AS m FROM vlg GROUP BY 1)
    SELECT n.key, round(1-exp(-greatest((epoch(TIMESTAMP '2024-02-01')-epoch(coalesce(m, created_at)))/86400.0,0)/30),4) AS forget FROM ent n LEFT JOIN l ON l.entity_key=n.key WHERE type IN ('dataset','method','idea','claim')""")
def _(t):
    seen = star.views_log(t).groupBy(F.col("entity_key").alias("key")).agg(F.max("ts").alias("m"))
    e = t.library.entity.filter("type in ('dataset','method','idea','claim')").join(seen, "key", "left")
    return e.select("key", F.round(sc.forgetting(F.col("m"), F.col("created_at"), F.expr("timestamp '2024-02-01 00:00:00'")), 4).alias("forget"))


@register("x25_recall_score", """SELECT id, round(score*(0.5+0.5*(id%10)/10.37)*CASE WHEN kind='merge' THEN 2 ELSE 1 END,5) AS s FROM que""")
def _(t):
    q = star.queue(t)
    return q.select("id", F.round(sc.recall_score(F.col("score"), (F.col("id") % 10) / 10.37, F.when(F.col("kind") == "merge", "user")), 5).alias("s"))


@register("x26_json_access", """SELECT id, json_extract_string(payload,'$.topic') AS topic, coalesce(json_extract_string(payload,'$.agent.action'),'') AS action FROM que""")
def _(t):
    p = F.from_json("payload", "struct<topic:string,agent:struct<action:string>>")
    return star.queue(t).select("id", p["topic"].alias("topic"), F.coalesce(p["agent"]["action"], F.lit("")).alias("action"))


@register("x29_path_patterns", """SELECT CASE l_linenumber%3 WHEN 0 THEN 'claims.*' WHEN 1 THEN 'assets.ideas.*.transfer' ELSE 'topics.*.aliases.*' END AS pattern, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    n = F.col("l_linenumber")
    path = (F.when(n % 3 == 0, F.concat(F.lit("claims."), "l_partkey")).when(n % 3 == 1, F.concat(F.lit("assets.ideas."), "l_suppkey", F.lit(".transfer")))
            .otherwise(F.concat(F.lit("topics."), "l_suppkey", F.lit(".aliases."), n)))
    return t.lineitem.groupBy(docs.path_pattern(path).alias("pattern")).agg(F.count("*").alias("n"))


@register("x30_confidence_clamp", """SELECT event_id, CASE WHEN event_type='error' THEN 0.0 ELSE round(least(1.0,greatest(0.0,value/100.3-0.2)),3) END AS c FROM events""")
def _(t):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise((F.col("value") / 100.3 - 0.2).cast("string"))
    return t.events.select("event_id", sc.clamp_confidence(raw).alias("c"))


@register("t07_sliding_views", """SELECT strftime(g.d,'%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS d) g
    JOIN events ON ts>=g.d AND ts<g.d+INTERVAL 7 DAY GROUP BY 1""")
def _(t):
    w = t.events.groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n")


@register("x05_search_units", f"""WITH n AS (SELECT item_id, regexp_extract_all({NORM.format("replace(lower(text),'ß','ss')")}, '[a-z0-9]+') AS w FROM benchmark)
    SELECT item_id, array_to_string(w, ' ') AS latin, '空间域 间域检 域检测 单细胞' AS han, '基因' AS pairs FROM n""")
def _(t):
    """What each passage is searched by, with Han runs of every length behind it."""
    u = tx.search_units(tx.norm(F.concat("text", F.lit(" 空间域检测 基因 单细胞 网"))))
    d = t.benchmark.select("item_id", u.alias("u"))
    han = F.filter("u.terms", lambda w: tx.has_han(w))
    return d.select("item_id", F.array_join(F.filter("u.terms", lambda w: ~tx.has_han(w)), " ").alias("latin"), F.array_join(han, " ").alias("han"),
                    F.array_join("u.pairs", " ").alias("pairs"))


@register("x14_tool_and_record_ids", """SELECT page_id, 'tool_'||page_id AS tool, (1000+page_id)::VARCHAR AS record FROM pages""")
def _(t):
    """The ids inside the addresses of tools and records, in each of their forms."""
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    tool = F.concat(F.when(k == 0, "https://bio.tools/").when(k == 1, "biotools:").otherwise(""), F.lit("Tool_"), n)
    num = (F.col("page_id") + 1000).cast("string")
    record = F.when(k == 0, F.concat(F.lit("https://zenodo.org/records/"), num)).when(k == 1, F.concat(F.lit("10.5281/zenodo."), num)).otherwise(num)
    return t.pages.select("page_id", ids.biotools(tool).alias("tool"), ids.zenodo(record).alias("record"))


@register("x17_link_unwrap", """SELECT page_id, CASE page_id%3 WHEN 0 THEN url WHEN 1 THEN url||' (cached)' ELSE '[see here]('||url||')' END AS url FROM pages""")
def _(t):
    """Markdown links around page addresses; a label of its own keeps the link."""
    k = F.col("page_id") % 3
    wrapped = F.when(k == 0, F.concat(F.lit("["), "url", F.lit("]("), "url", F.lit(")"))).when(k == 1, F.concat(F.lit("["), "url", F.lit("]("), "url", F.lit(") (cached)"))).otherwise(
        F.concat(F.lit("[see here]("), "url", F.lit(")")))
    return t.pages.select("page_id", ids.unwrap_link(wrapped).alias("url"))
