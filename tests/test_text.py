"""Scalar rules against plain expected values."""

import pytest
from pyspark.sql import functions as F

from litgraph.functions import ids, keys, scoring, text as tx


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(*cols).first()


def test_normal_form_is_pinned(spark):
    f = lambda s: one(spark, tx.norm(F.col("s")), s=s)[0]
    assert f("  Spatial-Domain Detection (v2) ") == "spatial domain detection v2"
    assert f("ＧＲＮ　推断") == "grn 推断"
    assert tx.norm_text("ＧＲＮ　推断") == "grn 推断"


def test_hashed_keys_are_pinned(spark):
    k = keys.free_key(F.lit("idea"), tx.norm(F.col("s")))
    assert one(spark, k, s="Use priors.")[0] == "idea:6a35298f047acbff3158"
    assert one(spark, keys.free_key(F.lit("topic"), tx.norm(F.col("s"))), s="GRN Inference")[0] == "topic:grn inference"


def test_tokens_and_windows(spark):
    r = one(spark, tx.lex_tokens(tx.norm(F.col("s"))), tx.tokens(tx.norm(F.col("s"))), s="GRN 基因调控 x1")
    assert r[0] == ["grn", "基因", "因调", "调控", "x1"] and r[1] == ["grn", "基", "因", "调", "控", "x1"]
    n = spark.createDataFrame([("ab",)], "s string").select(tx.norm(F.col("s")).alias("n"))
    assert n.select(tx.char_ngrams(F.col("n"))).first()[0] == [" ab", "ab "]


def test_query_terms_keep_the_twelve_longest(spark):
    s = "the and " + " ".join("w" + "x" * i for i in range(2, 20)) + " 空间域检测"
    n = tx.norm(F.col("s"))
    every, first = one(spark, tx.query_terms(n), tx.query_terms(n, tx.MAX_LATIN_TERMS, tx.MAX_HAN_TERMS), s=s)
    assert first[:12] == ["w" + "x" * i for i in range(19, 7, -1)] and first[12:] == ["空间域", "间域检", "域检测"]
    assert every == ["w" + "x" * i for i in range(19, 1, -1)] + first[12:]


@pytest.mark.parametrize("raw,want", [
    ("https://doi.org/10.1101/ABC.1", "10.1101/abc.1"), ("DOI: 10.1101/abc.1", "10.1101/abc.1"), ("10.1101/abc.1.", "10.1101/abc.1"),
    ("doi:10.1101/abc.1;", "10.1101/abc.1"), ("10.1002/(sici)1097-0258(19980815)17:15", "10.1002/(sici)1097-0258(19980815)17:15"),
    ("10.1000/x)", "10.1000/x"), ("doi.org/abc", None)])
def test_doi(spark, raw, want):
    assert one(spark, ids.doi(F.col("s")), s=raw)[0] == want


@pytest.mark.parametrize("raw,want", [
    ("https://github.com/Owner/Repo.git", "github.com/owner/repo"), ("github.com/a/b/", "github.com/a/b"), ("https://example.com/a/b", None),
    ("https://github.com/Owner/Repo/tree/main/src", "github.com/owner/repo"), ("git@github.com:Owner/Repo.git", "github.com/owner/repo"),
    ("https://gitee.com/lab/tool", "gitee.com/lab/tool"), ("https://huggingface.co/org/model", None)])
def test_repo(spark, raw, want):
    assert one(spark, ids.repo(F.col("s")), s=raw)[0] == want


def test_accessions(spark):
    ok = lambda a, d: one(spark, ids.accession_ok(F.col("a"), F.col("d")), a=a, d=d)[0]
    assert ok("GSE123456", "GEO") and not ok("GSE12A", "GEO") and ok("SRR000001", "SRA") and ok("E-MTAB-1234", "ArrayExpress")
    assert ok("CRA001234", "GEO") and not ok("made-up", None)
    db = lambda a, d: one(spark, ids.effective_database(F.col("a"), F.col("d")), a=a, d=d)[0]
    assert db("GSE123456", "SRA") == "GEO" and db("PRJCA012345", "SRA") == "GSA" and db("PRJNA12345", None) == "SRA"
    assert one(spark, ids.biotools(F.col("s")), s="https://bio.tools/Scanpy")[0] == "scanpy" and one(spark, ids.biotools(F.col("s")), s="not valid!")[0] is None
    cls = lambda a: one(spark, ids.download_class(F.col("a"), F.lit(None).cast("string")), a=a)[0]
    assert cls("GSE999001") == "series:GSE999nnn" and cls("GSE12") == "series:GSEnnn" and cls("SRR1") == "run" and cls("PRJNA1") == "project"


def test_link_unwrap(spark):
    f = lambda s: one(spark, ids.unwrap_link(F.col("s")), s=s)[0]
    assert f("[https://x.y](https://x.y/z)w") == "https://x.y/zw" and f("[label](https://x.y)") == "[label](https://x.y)"


def test_polarity(spark):
    def opp(a, b):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        p = df.select(scoring.negated(F.col("a")).alias("na"), scoring.directions(F.col("a")).alias("da"), scoring.negated(F.col("b")).alias("nb"), scoring.directions(F.col("b")).alias("db"))
        return p.select(scoring.opposite(F.col("na"), F.col("da"), F.col("nb"), F.col("db"))).first()[0]
    assert opp("TF X increases growth", "TF X decreases growth") and opp("X is needed", "X is not needed")
    assert not opp("X increases Y", "X increases Y in roots") and opp("上调表达", "下调表达") and not opp("两者不同", "两者有别")


def test_dense_vectors_are_the_sparse_features(spark):
    from litgraph.functions.embed import hash_embedder, hash_features
    from litgraph.functions.text import norm
    texts = spark.createDataFrame([(1, "Red widget, red"), (2, "两者 Ab"), (3, ""), (4, "x")], "id long, t string")
    sparse = {(r["id"], r["bucket"]): r["weight"] for r in hash_features(texts.withColumn("n", norm(F.col("t"))), "id", F.col("n")).collect()}
    for r in texts.select("id", hash_embedder()(F.col("t")).alias("v")).collect():
        got = {(r["id"], i): x for i, x in enumerate(r["v"]) if x}
        want = {k: v for k, v in sparse.items() if k[0] == r["id"]}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
