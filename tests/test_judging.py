"""Judges, their memory, staged entailment, and scorers as arguments."""

import pytest
from pyspark.sql import functions as F

from litgraph.operators import judging as jd
from litgraph.operators import resolution as rs


def table_judge(name, answers, asked):
    """A judge that looks its answers up and notes how many questions it was asked."""
    def ask(pairs, a, b):
        asked.append(pairs.count())
        known = pairs.sparkSession.createDataFrame(answers, "ta string, tb string, label string, p double")
        return pairs.join(known, (F.col(a) == F.col("ta")) & (F.col(b) == F.col("tb")), "left").drop("ta", "tb")
    return jd.Judge(name, ask)


def test_rounds_end_with_the_first_same_claim(spark):
    near = spark.createDataFrame([("k", "1", 1, "K", "A"), ("k", "2", 2, "K", "B"), ("k", "3", 3, "K", "C"), ("z", "1", 1, "Z", "A"), ("z", "2", 2, "Z", "B"), ("y", "1", 1, "K", "A")],
                                 "key string, cand string, rank int, a string, b string")
    answers = [("K", "A", "entailment", .9), ("A", "K", "neutral", .5), ("K", "B", "entailment", .8), ("B", "K", "entailment", .7), ("Z", "A", "neutral", .1), ("A", "Z", "contradiction", .6)]
    asked = []
    said, memo = jd.staged_entailment(near, table_judge("m", answers, asked))
    assert {(r["key"], r["cand"], r["verdict"], r["p"]) for r in said.collect()} == {
        ("k", "1", "supports", .9), ("k", "2", "same", .8), ("z", "1", "contradiction", .6), ("y", "1", "supports", .9)}
    assert asked == [2, 2, 2, 2, 0, 0]  # equal questions once, and the third neighbour of a settled claim never
    again = []
    more, new = jd.staged_entailment(near, table_judge("m", answers, again), memo, at=1)
    assert again == [0, 0, 1, 1, 0, 0] and new.count() == 0  # only what it had no verdict on
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, said.collect()))


def test_the_latest_verdict_counts_and_a_switch_turns_all_off(spark):
    pairs = spark.createDataFrame([("x", "y"), ("x", None)], "a string, b string")
    d = jd.digest(F.lit("x"), F.lit("y"))
    memo = spark.range(2).select(F.lit("m").alias("judge"), d.alias("digest"), F.when(F.col("id") == 0, "old").otherwise("new").alias("label"), F.lit(.5).alias("p"), "id").withColumnRenamed("id", "at")
    told, new = jd.judged(pairs, "a", "b", table_judge("m", [("x", "y", "asked", .1)], []), memo)
    assert {(r["b"], r["label"]) for r in told.collect()} == {("y", "new"), (None, None)} and new.count() == 0
    told, new = jd.judged(pairs, "a", "b", table_judge("other", [("x", "y", "asked", .1)], []), memo)
    assert {(r["b"], r["label"]) for r in told.collect()} == {("y", "asked"), (None, None)} and new.count() == 1
    off, none = jd.judged(pairs, "a", "b", table_judge("m", [], []), memo, on=False)
    assert {r["label"] for r in off.collect()} == {None} and none.count() == 0


def test_rules(spark):
    rows = [("the root grows fast", "root grows", "entailment"), ("root grows", "the root grows fast", "neutral"), ("growth increases in light", "growth decreases in light", "contradiction"),
            ("it does not grow", "it does grow", "contradiction")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r["label"] == r["want"] for r in jd.rule_entailment().ask(df, "a", "b").collect())


@pytest.fixture(scope="module")
def claims(spark):
    names = ["Factor X increases root growth", "factor x increases the root growth", "Factor X never increases root growth", "Cells divide late"]
    return spark.createDataFrame([(str(i), n, i) for i, n in enumerate(names)], "mid string, name string, seq long").select(
        "*", F.lit("claim").alias("type"), F.lit(None).cast("string").alias("origin"), F.array().cast("array<string>").alias("aliases"), F.col("name").alias("text"),
        F.lit(None).cast("string").alias("anchor"), F.lit(False).alias("auto"))


def test_claims_resolved_by_a_classifier(spark, claims):
    same = [("factor x increases the root growth", "Factor X increases root growth", "entailment", .9), ("Factor X increases root growth", "factor x increases the root growth", "entailment", .9),
            ("Factor X never increases root growth", "Factor X increases root growth", "contradiction", .8)]
    res = rs.resolve(claims, nli=table_judge("m", same, []))
    key = {r["mid"]: r["key"] for r in res.assigned.collect()}
    assert key["0"] == key["1"] and len(set(key.values())) == 3
    assert {(r["kind"], r["score"]) for r in res.queue.filter("kind = 'contradiction'").collect()} == {("contradiction", .8)}
    assert res.memo.count() == 3
    again = rs.resolve(claims, nli=table_judge("m", [], []), memo=res.memo)
    assert {r["mid"]: r["key"] for r in again.assigned.collect()} == key and again.memo.count() == 0


def test_a_reranker_is_an_argument(spark, claims):
    topics = claims.withColumn("type", F.lit("topic")).withColumn("auto", F.lit(True))
    merged = rs.resolve(topics, rerank=lambda pairs, a, b: pairs.withColumn("rel", F.lit(0.95)))
    assert len({r["key"] for r in merged.assigned.collect()}) == 1
    apart = rs.resolve(topics, rerank=lambda pairs, a, b: pairs.withColumn("rel", F.lit(0.1)))
    assert len({r["key"] for r in apart.assigned.collect()}) == 4 and apart.queue.count() == 0


def test_vectors_are_not_written_or_moved(spark, monkeypatch):
    """Scores of pairs write no vectors, and the vector of a text that one entity has stays where it was made."""
    from litgraph.model import Library
    from litgraph.operators import retrieval as rt
    written = []
    monkeypatch.setattr(rt, "stored", lambda df, what: written.append(df.schema.simpleString()) or df)
    pairs = spark.createDataFrame([("red widget", "a red ring"), ("red widget", None), ("空间域", "空间 red"), ("", "")], "a string, b string")
    got = rt.lexical_scores(pairs, "a", "b").collect()
    assert not written
    slow = rt.lexical_scores(pairs, "a", "b", rt.hash_embedder(512)).collect()
    assert [(r["a"], r["b"], r["rel"]) for r in got] == [(r["a"], r["b"], r["rel"]) for r in slow] and got[0]["rel"] > 0.2
    rows = [(f"k{i}", "work", f"name {i // 2 if i < 10 else i}", "active") for i in range(30)] + [("k7", "work", "name 3", "active")]
    lib = Library(entity=spark.createDataFrame(rows, "key string, type string, canonical_name string, status string"), edge=None)
    cache = spark.createDataFrame([], "text_sha string, model string, vec array<float>")
    vec, new = rt.index_entities(lib, cache, "hash")
    assert sorted(r["key"] for r in vec.collect()) == sorted(r[0] for r in rows) and new.count() == 25
    plan = vec._jdf.queryExecution().executedPlan().toString().split("\n")
    first = next(i for i, line in enumerate(plan) if "ArrowEvalPython" in line)
    assert not any(w in line for line in plan[:first] for w in ("Sort", "Exchange", "Join"))


def test_vectors_of_some_are_embedded_without_the_others(spark):
    from litgraph.model import Library
    from litgraph.operators import retrieval as rt
    rows = [(f"k{i}", "work", f"name {i // 2}", "active") for i in range(8)]
    lib = Library(entity=spark.createDataFrame(rows, "key string, type string, canonical_name string, status string"), edge=None)
    all_of = rt.Indexed(lib, spark.createDataFrame([], "text_sha string, model string, vec array<float>"), "hash")
    keys = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    some = rt.vectors_at(all_of, keys)
    assert sorted(some.collect()) == sorted(rt.vectors_at(all_of.of(), keys).collect()) and some.count() == 3
    plan = some._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert next(i for i, line in enumerate(plan) if "ArrowEvalPython" in line) < next(i for i, line in enumerate(plan) if "LeftSemi" in line)


def test_heavy_terms_are_ranked_once(spark, monkeypatch):
    """Every question has words that many documents have: the same hits as by all pairs, ties and all."""
    from litgraph.operators import retrieval as rt
    docs = spark.createDataFrame([(i, f"supplier number{i % 40:03d} {'red ' * (i % 3)}{'widget' if i % 4 else 'ring'} x{i % 7}yz") for i in range(400)], "id long, body string")
    asked = spark.createDataFrame([(q, f"supplier number{q:03d}" + (" red widget" if q % 2 else "")) for q in range(45)] + [(99, "supplier")], "q long, text string")
    got = {}
    for most in (rt.MAX_PAIRS, 0):
        monkeypatch.setattr(rt, "MAX_PAIRS", most)
        got[most] = sorted((r["q"], r["id"], r["score"], r["rank"]) for r in rt.keyword_search(docs, asked, 3).collect())
    assert got[0] == got[20_000_000] and len(got[0]) == 46 * 3
