"""Scorers and judges as arguments: who scores a pair of texts, who gives a verdict, and what is remembered of it.

A ``Reranker`` adds ``rel`` to pairs, a ``Judge`` adds ``label`` and ``p``; a null label is no verdict, which leaves the
question to the user. Verdicts are remembered by judge and digest of the texts, so that a second run asks nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..session import cut, stored

Reranker = Callable[[DataFrame, str, str], DataFrame]
MEMO = "judge string, digest string, label string, p double, at bigint"


@dataclass(frozen=True)
class Judge:
    """``ask(pairs, a, b)`` gives pairs with label and p; labels of another ``name`` are not its own."""
    name: str
    ask: Callable[[DataFrame, str, str], DataFrame]


NOBODY = Judge("queue", lambda pairs, a, b: pairs.withColumn("label", F.lit(None).cast("string")).withColumn("p", F.lit(None).cast("double")))


# ---- rules that stand in for a model -------------------------------------------------------

def _words(c: Column) -> Column:
    return F.array_distinct(tx.tokens(tx.norm(c)))


def rule_entailment() -> Judge:
    """Of the texts a and b: contradiction if their polarity is opposite, entailment if a has all words of b, else
    neutral; p is the share of common words."""
    def ask(pairs: DataFrame, a: str, b: str) -> DataFrame:
        p = pairs.select("*", *(f.alias(n) for side, c in (("a", a), ("b", b)) for n, f in (
            (f"_w{side}", _words(F.col(c))), (f"_n{side}", sc.negated(F.col(c))), (f"_d{side}", sc.directions(F.col(c))))))
        rest = F.array_except("_wb", F.array(*[F.lit(w) for w in sc.NEGATIONS]))
        label = (F.when(sc.opposite(F.col("_na"), F.col("_da"), F.col("_nb"), F.col("_db")), "contradiction")
                 .when(F.size(F.array_except(rest, "_wa")) == 0, "entailment").otherwise("neutral"))
        share = F.size(F.array_intersect("_wa", "_wb")) / F.greatest(F.size(F.array_union("_wa", "_wb")), F.lit(1))
        return p.select(*pairs.columns, label.alias("label"), F.round(share, 4).alias("p"))
    return Judge("rules", ask)


def rule_relation(sure: float = 0.9) -> Judge:
    """Whether a text a is about the topic named b: surely if it has all its words, surely not if it has none of them;
    no verdict in between."""
    def ask(pairs: DataFrame, a: str, b: str) -> DataFrame:
        have, want = _words(F.col(a)), _words(F.col(b))
        common = F.size(F.array_intersect(have, want))
        label = F.when(common == F.size(want), "about").when(common == 0, "none")
        return pairs.withColumn("label", label).withColumn("p", F.when(label.isNotNull(), F.lit(sure)))
    return Judge("rules", ask)


# ---- memory ----------------------------------------------------------------------------------

def digest(a: Column, b: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), 256)


def remembered(memo: DataFrame, judge: Judge) -> DataFrame:
    """(digest, label, p): the judge's latest verdict on each question."""
    last = F.max_by(F.struct("label", "p"), F.struct("at", "label", "p")).alias("v")
    return memo.filter(F.col("judge") == judge.name).groupBy("digest").agg(last).select("digest", "v.label", "v.p")


def judged(pairs: DataFrame, a: str, b: str, judge: Judge, memo: DataFrame | None = None, at: int = 0, on: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pairs with label and p, new memo rows). Each different question is asked once, and only if the memory lacks it;
    the new rows are to be appended. Switched off, nobody is asked and nothing is known."""
    spark = pairs.sparkSession
    none = spark.createDataFrame([], MEMO)
    if not on:
        return NOBODY.ask(pairs, a, b), none
    keyed = pairs.withColumn("_digest", digest(F.col(a), F.col(b)))
    known = remembered(none if memo is None else memo, judge)
    ask = keyed.select(F.col("_digest").alias("digest"), F.col(a).alias("a"), F.col(b).alias("b")).dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    new = stored(judge.ask(ask, "a", "b").filter("label is not null").select(F.lit(judge.name).alias("judge"), "digest", "label", F.col("p").cast("double").alias("p"),
                                                                             F.lit(at).cast("bigint").alias("at")), "verdicts")
    every = known.unionByName(new.select("digest", "label", "p")).withColumnRenamed("digest", "_digest")
    return keyed.join(every, "_digest", "left").drop("_digest"), new


# ---- claims: one neighbour after the other -----------------------------------------------------

def staged_entailment(near: DataFrame, judge: Judge, memo: DataFrame | None = None, at: int = 0) -> tuple[DataFrame, DataFrame]:
    """((key, cand, verdict, p), new memo rows): what a pair classifier says about claims and their neighbours.
    near(key, cand, rank, a, b). A round hands every open claim's next neighbour to the classifier, both ways; the first
    one entailed both ways is the same claim and ends its search. One-way entailment is support."""
    near = cut(near.select("key", "cand", "rank", "a", "b"))
    ranks = [r["rank"] for r in near.select("rank").distinct().orderBy("rank").collect()]  # as many as neighbours are looked at
    memory = near.sparkSession.createDataFrame([], MEMO) if memo is None else memo
    done, out, new = near.limit(0).select("key"), None, None
    for rank in ranks:
        open_ = near.filter(F.col("rank") == rank).join(done, "key", "left_anti")
        forward, one = judged(open_, "a", "b", judge, memory, at)
        memory = memory.unionByName(one)
        backward, two = judged(forward.withColumnRenamed("label", "forward").withColumnRenamed("p", "pf"), "b", "a", judge, memory, at)
        memory = memory.unionByName(two)
        both = (F.col("forward") == "entailment") & (F.col("label") == "entailment")
        verdict = (F.when(both, "same").when(F.col("forward") == "entailment", "supports")
                   .when((F.col("forward") == "contradiction") | (F.col("label") == "contradiction"), "contradiction"))
        said = stored(backward.select("key", "cand", verdict.alias("verdict"), F.greatest("pf", "p").alias("p")), "said")
        done = done.unionByName(said.filter("verdict = 'same'").select("key"))
        said = said.filter("verdict is not null")
        out = said if out is None else out.unionByName(said)
        new = one.unionByName(two) if new is None else new.unionByName(one).unionByName(two)
    if out is None:
        out, new = near.select("key", "cand", F.col("a").alias("verdict"), F.lit(0.0).alias("p")), memory.limit(0)
    return out, new
