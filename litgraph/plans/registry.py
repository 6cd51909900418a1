"""Registered queries with their SQL twins, and the SQL views that mirror ``sources.star``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.star import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NORM = ("trim(regexp_replace(regexp_replace(lower({0}), "
        "'[\\s\\-_/·•,.;:()\\[\\]{{}}''\"`~!?，。；：（）【】、]+', ' ', 'g'), '\\s+', ' ', 'g'))")

# name -> (views it needs, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ent": ((), """
      SELECT o_orderkey*10+1 AS id, 'work' AS type, 'work:'||o_orderkey AS key, 'order '||o_orderkey AS canonical_name,
        NULL::VARCHAR AS external_id,
        CASE WHEN o_orderstatus='P' AND o_orderpriority='1-URGENT' THEN 'rejected' ELSE 'active' END AS status,
        NULL::VARCHAR AS origin, o_orderdate::TIMESTAMP AS created_at FROM orders
      UNION ALL SELECT p_partkey*10+2, CASE WHEN p_type IN ('ECONOMY','LARGE') THEN 'dataset'
        WHEN p_type IN ('MEDIUM','PROMO') THEN 'method' WHEN p_type='SMALL' THEN 'idea' ELSE 'claim' END,
        'asset:'||p_partkey, p_name, p_brand||'/'||p_partkey, CASE WHEN p_size>=49 THEN 'rejected' ELSE 'active' END,
        CASE WHEN p_brand IN ('Brand#1','Brand#2') THEN 'user' ELSE 'model' END,
        TIMESTAMP '1995-01-01' + to_days((p_size*40)::INT) FROM part
      UNION ALL SELECT s_suppkey*10+3,'topic','topic:s'||s_suppkey,s_name,NULL,
        CASE WHEN s_acctbal<3000 THEN 'candidate' ELSE 'active' END,NULL,TIMESTAMP '1995-01-01' FROM supplier
      UNION ALL SELECT n_nationkey::BIGINT*10+4,'topic','topic:n'||n_nationkey,n_name,NULL,'active',NULL,TIMESTAMP '1995-01-01' FROM nation
      UNION ALL SELECT r_regionkey::BIGINT*10+5,'topic','topic:r'||r_regionkey,r_name,NULL,'active',NULL,TIMESTAMP '1995-01-01' FROM region
      UNION ALL SELECT n_nationkey::BIGINT*10+6,'organism','organism:'||n_nationkey,n_name,NULL,'active',NULL,TIMESTAMP '1995-01-01' FROM nation
      UNION ALL SELECT ascii(c_mktsegment)::BIGINT*10+7,'modality','modality:'||lower(c_mktsegment),c_mktsegment,NULL,'active',NULL,
        TIMESTAMP '1995-01-01' FROM (SELECT DISTINCT c_mktsegment FROM customer)"""),
    "wrk": ((), """SELECT 'work:'||o_orderkey AS entity_key, year(o_orderdate)::INT AS year,
        substr(o_orderpriority,1,1)::INT AS tier FROM orders"""),
    "als": ((), f"""SELECT entity_key, alias, source, {NORM.format('alias')} AS norm FROM (
        SELECT 'asset:'||p_partkey AS entity_key, p_name AS alias, 'name' AS source FROM part
        UNION ALL SELECT 'asset:'||p_partkey, p_brand||'/'||p_partkey, 'external' FROM part
        UNION ALL SELECT 'topic:s'||s_suppkey, s_name, 'name' FROM supplier
        UNION ALL SELECT 'topic:n'||n_nationkey, n_name, 'name' FROM nation
        UNION ALL SELECT 'topic:r'||r_regionkey, r_name, 'name' FROM region
        UNION ALL SELECT 'organism:'||n_nationkey, n_name, 'name' FROM nation
        UNION ALL SELECT DISTINCT 'modality:'||lower(c_mktsegment), c_mktsegment, 'name' FROM customer)"""),
    "stm": ((), """
      SELECT 'work:'||l_orderkey AS src, 'asset:'||l_partkey AS dst,
        CASE WHEN l_returnflag='A' THEN 'uses' WHEN l_returnflag='R' THEN 'produces'
          WHEN l_linestatus='F' AND l_tax<0.02 THEN 'contradicts' WHEN l_linestatus='F' THEN 'supports'
          WHEN l_quantity>25 THEN 'proposes' ELSE 'evaluates' END AS type,
        CASE WHEN l_discount=0 THEN 2 WHEN l_linestatus='F' THEN 1 ELSE 0 END AS rank,
        round(1-l_discount,2) AS confidence, l_linenumber AS extraction_id, l_shipdate::TIMESTAMP AS created_at FROM lineitem
      UNION ALL SELECT 'work:'||l_orderkey,'topic:s'||l_suppkey,'about',
        CASE WHEN l_discount=0 THEN 2 WHEN l_linestatus='F' THEN 1 ELSE 0 END, round(1-l_discount,2), l_linenumber, l_shipdate FROM lineitem
      UNION ALL SELECT 'asset:'||l_partkey,'topic:s'||l_suppkey,'applicable_to',
        CASE WHEN l_discount=0 THEN 2 WHEN l_linestatus='F' THEN 1 ELSE 0 END, round(1-l_discount,2), l_linenumber, l_shipdate
        FROM lineitem WHERE l_quantity>=49
      UNION ALL SELECT 'work:'||o_orderkey,'organism:'||c_nationkey,'of_organism',0,1.0,0,o_orderdate
        FROM orders JOIN customer ON o_custkey=c_custkey
      UNION ALL SELECT 'work:'||o_orderkey,'modality:'||lower(c_mktsegment),'of_modality',0,1.0,0,o_orderdate
        FROM orders JOIN customer ON o_custkey=c_custkey
      UNION ALL SELECT 'topic:n'||n_nationkey,'topic:r'||n_regionkey,'is_a',1,1.0,0,TIMESTAMP '1995-01-01' FROM nation
      UNION ALL SELECT 'topic:s'||s_suppkey,'topic:n'||s_nationkey,'is_a',CASE WHEN s_acctbal<200 THEN 2 ELSE 0 END,1.0,0,
        TIMESTAMP '1995-01-01' FROM supplier"""),
    "edg": (("stm",), """SELECT src, dst, type, CASE max(rank) WHEN 2 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'auto' END AS status,
        max(confidence) AS confidence, min(created_at) AS created_at, min(extraction_id) AS extraction_id,
        'line '||min(extraction_id) AS evidence FROM stm GROUP BY src, dst, type"""),
    "crd": ((), """SELECT 'card:'||p_partkey AS id, 'asset:'||p_partkey AS entity_key, 'about '||p_name||'?' AS q, p_brand AS a,
        CASE WHEN p_type='ECONOMY' THEN 'export' ELSE 'template' END AS origin,
        CASE WHEN p_brand IN ('Brand#1','Brand#2') THEN 10 ELSE 0 END AS priority,
        CASE WHEN p_type='PROMO' THEN NULL ELSE TIMESTAMP '2000-01-01' + to_days(p_size::INT) END AS introduced_at,
        CASE WHEN p_type='PROMO' THEN NULL ELSE TIMESTAMP '2000-01-10' + to_days((p_size + p_partkey%30)::INT) END AS due,
        p_size IN (47,48) AS suspended, TIMESTAMP '1995-01-01' + to_days((p_size*40)::INT) AS created_at FROM part"""),
    "que": ((), """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'merge' WHEN '2-HIGH' THEN 'topic_relation'
          WHEN '3-MEDIUM' THEN 'contradiction' WHEN '4-NOT SPECIFIED' THEN 'retro_tag' ELSE 'synthesis' END AS kind,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'resolved' ELSE 'skipped' END AS status,
        round(o_totalprice/1000000,4) AS score, o_orderdate::TIMESTAMP AS created_at,
        '{"topic":"topic:n'||(o_custkey%25)||'","a":"'||CASE WHEN o_orderkey%3=0 THEN 'topic:s' ELSE 'asset:' END||(o_custkey%100)
          ||'","b":"topic:s'||(o_orderkey%100)||'"'||CASE o_orderkey%4 WHEN 0 THEN ',"agent":{"action":"'||CASE o_custkey%5 WHEN 0 THEN 'skip'
          WHEN 1 THEN 'merge' WHEN 2 THEN 'about' WHEN 3 THEN 'a_is_a_b' ELSE 'useful' END||'","confidence":'||(o_custkey%10)||'}' ELSE '' END||'}' AS payload,
        'q'||o_custkey||'|'||o_orderpriority AS dedupe_key FROM orders"""),
    "vlg": ((), """SELECT 'asset:'||user_id AS entity_key, ts::TIMESTAMP AS ts, event_type, event_id FROM events"""),
    "dec": ((), """SELECT event_id AS id, ts::TIMESTAMP AS created_at, CASE WHEN value<1 THEN ts END AS revoked_at,
        CASE event_type WHEN 'signup' THEN 'merge' WHEN 'error' THEN 'edge_status' WHEN 'click' THEN 'distinct' WHEN 'view' THEN 'rename'
          ELSE 'reject_entity' END AS op, user_id AS a, (json_extract_string(props,'$.k'))::BIGINT AS b, value FROM events"""),
    # papers behind each entity
    "srcw": (("edg", "ent", "wrk"), """SELECT e.dst AS entity_key, e.src AS work_key, e.type AS edge_type, e.evidence, w.year, w.tier
        FROM edg e JOIN ent n ON n.key=e.src JOIN wrk w ON w.entity_key=e.src
        WHERE e.status<>'rejected' AND e.type IN ('proposes','uses','produces','evaluates','supports','contradicts')"""),
    # everything below region 1
    "sub": (("edg",), """SELECT 'topic:r1' AS key UNION SELECT src FROM edg WHERE type='is_a' AND status<>'rejected' AND dst='topic:r1'
        UNION SELECT c.src FROM edg c JOIN edg p ON c.dst=p.src WHERE c.type='is_a' AND c.status<>'rejected'
          AND p.type='is_a' AND p.status<>'rejected' AND p.dst='topic:r1'"""),
    # (entity, role, via paper) under region 1
    "mem": (("edg", "ent", "sub"), """SELECT e.src AS key, e.type AS role, NULL::VARCHAR AS via FROM edg e JOIN sub s ON s.key=e.dst
          WHERE e.type IN ('about','applicable_to') AND e.status<>'rejected'
        UNION ALL SELECT e.dst, e.type, e.src FROM edg e
          WHERE e.type IN ('proposes','uses','produces','evaluates','supports','contradicts') AND e.status<>'rejected'
          AND e.src IN (SELECT d.src FROM edg d JOIN sub s ON s.key=d.dst JOIN ent n ON n.key=d.src AND n.type='work'
                        WHERE d.type IN ('about','applicable_to') AND d.status<>'rejected')"""),
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for need in VIEWS[n][0]:
            add(need)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def expand(sql: str) -> str:
    """Prefix the SQL with the views it names. The SQL may itself start with WITH."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in _order(used)]
    body = sql.strip()
    if not ctes:
        return body
    m = re.match(r"(?is)with\s+(recursive\s+)?(.*)", body)
    if m:
        return f"WITH {m.group(1) or ''}{', '.join(ctes)}, {m.group(2)}"
    return f"WITH {', '.join(ctes)} {body}"


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = expand(sql)
        return fn
    return deco
