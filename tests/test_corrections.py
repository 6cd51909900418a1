"""Replay of corrections on small libraries."""

import json

from pyspark.sql import functions as F

from litgraph.model import Library
from litgraph.operators import corrections as co, replay

ENT = "id long, key string, type string, canonical_name string, status string, origin string, created_at timestamp"
EDGE = "src string, dst string, type string, status string, confidence double, evidence string, created_at timestamp"


def library(spark):
    import datetime as dt
    at = dt.datetime(2024, 1, 1)
    ents = [(i, k, k.split(":")[0], k.split(":")[1], s, o, at) for i, (k, s, o) in enumerate([
        ("work:p", "active", None), ("work:q", "active", None), ("topic:grn", "candidate", None), ("topic:gene network", "active", None), ("topic:c", "active", None),
        ("idea:mine", "active", "user"), ("idea:model", "active", "model"), ("claim:x", "active", None)])]
    edges = [("work:p", "topic:grn", "about", "auto", 0.5, None, at), ("work:p", "topic:gene network", "about", "confirmed", 0.9, "Fig. 1", at),
             ("work:q", "topic:grn", "about", "auto", 1.0, "Fig. 2", at), ("topic:grn", "topic:gene network", "is_a", "auto", 1.0, None, at), ("work:q", "claim:x", "supports", "auto", 1.0, "F", at)]
    alias = [(e[1], e[3], e[3], "extraction") for e in ents]
    return Library(entity=spark.createDataFrame(ents, ENT), edge=spark.createDataFrame(edges, EDGE),
                   alias=spark.createDataFrame(alias, "entity_key string, alias string, norm string, source string"),
                   work=spark.createDataFrame([("work:p", 2020, 1), ("work:q", 2021, 2)], "entity_key string, year int, tier int"))


def decided(spark, *ops):
    rows = [(i, op, json.dumps(p), revoked) for i, (op, p, *r) in enumerate(ops) for revoked in [bool(r)]]
    d = spark.createDataFrame(rows, "id long, op string, payload string, r boolean")
    at = F.expr("timestamp '2024-02-01 00:00:00'")
    return d.select("id", "op", "payload", at.alias("created_at"), F.when(F.col("r"), at).alias("revoked_at"))


def edges(lib):
    return {(r["src"], r["dst"], r["type"]): (r["status"], r["confidence"]) for r in lib.edge.collect()}


def test_merge_folds_edges_and_drops_self_loops(spark):
    out, skipped = replay.apply_all(library(spark), decided(spark, ("merge", {"from": "topic:grn", "into": "topic:gene network"})))
    e = edges(out)
    assert e[("work:p", "topic:gene network", "about")] == ("confirmed", 0.9) and ("work:q", "topic:gene network", "about") in e
    assert not any("topic:grn" in k for k in e) and skipped.isEmpty()
    assert {r["norm"] for r in out.alias.filter("entity_key = 'topic:gene network'").collect()} == {"grn", "gene network"}


def test_user_wording_survives_a_merge(spark):
    out, _ = replay.apply_all(library(spark), decided(spark, ("merge", {"from": "idea:mine", "into": "idea:model"})))
    r = out.entity.filter("key = 'idea:model'").first()
    assert (r["canonical_name"], r["origin"]) == ("mine", "user")


def test_stale_and_revoked_decisions(spark):
    out, skipped = replay.apply_all(library(spark), decided(
        spark, ("merge", {"from": "topic:grn", "into": "claim:x"}), ("rename", {"key": "topic:nowhere", "name": "x"}), ("reject_entity", {"key": "claim:x"}, "revoked"), ("reject_entity", {"key": "work:p"})))
    assert {(r["op"], r["reason"]) for r in skipped.collect()} == {("merge", "different types"), ("rename", "not found"), ("reject_entity", "a paper is retracted, not rejected")}
    assert out.entity.filter("status = 'rejected'").isEmpty()


def test_last_word_on_an_edge_wins_and_missing_ones(spark):
    out, _ = replay.apply_all(library(spark), decided(
        spark, ("edge_status", {"src": "work:p", "dst": "topic:grn", "type": "about", "status": "rejected"}), ("add_edge", {"src": "work:p", "dst": "topic:grn", "type": "about"}),
        ("edge_status", {"src": "work:q", "dst": "topic:c", "type": "about", "status": "rejected"}), ("add_edge", {"src": "topic:c", "dst": "topic:grn", "type": "is_a"})))
    e = edges(out)
    assert e[("work:p", "topic:grn", "about")][0] == "confirmed" and ("work:q", "topic:c", "about") not in e and e[("topic:c", "topic:grn", "is_a")][0] == "confirmed"


def test_split_moves_listed_edges(spark):
    out, _ = replay.apply_all(library(spark), decided(spark, ("split", {"key": "topic:grn", "new_name": "GRN in plants", "edges": [{"src": "work:q", "dst": "topic:grn", "type": "about"}]}),
                                                  ("split", {"key": "topic:c", "new_name": "nothing", "edges": [{"src": "work:q", "dst": "topic:c", "type": "about"}]})))
    e = edges(out)
    assert ("work:q", "topic:grn in plants", "about") in e and ("work:q", "topic:grn", "about") not in e
    assert out.entity.filter("key = 'topic:nothing'").isEmpty() and out.entity.filter("key = 'topic:grn in plants'").count() == 1


def test_created_and_renamed(spark):
    out, _ = replay.apply_all(library(spark), decided(spark, ("create_topic", {"name": "New One"}), ("create_topic", {"name": "grn"}), ("rename", {"key": "topic:c", "name": "Sea"}), ("confirm_topic", {"key": "topic:grn"})))
    r = {x["key"]: x for x in out.entity.collect()}
    assert r["topic:new one"]["status"] == "active" and str(r["topic:new one"]["created_at"]).startswith("2024-02-01")
    assert r["topic:grn"]["status"] == "active" and r["topic:c"]["canonical_name"] == "Sea" and out.alias.filter("norm = 'sea'").count() == 1


def test_validation_hints(spark):
    v = co.validated(library(spark), decided(spark, ("merge", {"from": "topic:GRN", "into": "topic:c"}), ("rename", {"key": "topic:c"}), ("fly", {}), ("add_edge", {"src": "work:p", "dst": "topic:c", "type": "likes"})))
    got = {r["op"]: (r["problem"], r["hint"]) for r in v.collect()}
    assert got["merge"] == ("not found: topic:GRN", "topic:grn") and got["rename"][0] == "missing name" and got["fly"][0] == "unknown op" and got["add_edge"][0] == "unknown edge type"
