"""Fill-in-middle against a brute-force cut, with odd and very long texts."""

import hashlib
import re

from pyspark.sql import functions as F

from litgraph.llm import fim

TEXTS = [(1, None), (2, ""), (3, "one"), (4, "Two words.\nAnd $1 \\2 {3} é中🙂x\r\n"), (5, "has <S> in it"), (6, "<<<P <S <M S> >"), (7, " " * 40_000 + "ab1" * 30_000),
         (8, "again and again"), (8, "again and again"), (None, "no id"), (9, "x"), (10, "a b\x85c\n")] + [(i, f"text {i}: some words, and {i * 7} more\n") for i in range(20, 120)]


def brute(key, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cut_and_restored(spark):
    docs = spark.createDataFrame([(i, t, "clash", "kept") for i, t in TEXTS], "doc_id long, text string, form string, `_parts` string")
    rows = fim.restore(fim.transform(docs)).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=repr)
    assert got == sorted(((i, *brute(i, t)) for i, t in TEXTS), key=repr)
    assert all(r["restored"] == (r["text"] or "") and r["_parts"] == "kept" for r in rows)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0


def test_plan_has_no_shuffle_and_one_match(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    plan = fim.restore(fim.transform(docs)).select(F.sha2("output", 256), F.sha2("restored", 256))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_replace(") == 1 and "Python" not in plan
