"""Documents to graph, end to end on three synthetic exports, and the rebuild around them."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from litgraph.operators import resolution as rs
from litgraph.plans import ingest, rebuild
from litgraph.sources import documents as d
from litgraph.streaming import cards, feeds

DEEP = """rxf_version: 1
depth: deep
language: en
paper: {doi: 10.5555/made.1, title: A root atlas, year: 2024, organisms: [Arabidopsis thaliana], modalities: [snRNAseq]}
tldr: [one, two]
topics:
  - {id: t1, name: gene regulatory network inference, relation: about}
  - {id: t2, name: spatial domain detection, relation: applicable_to}
claims:
  - {id: c1, text: Factor X increases root growth, evidence_type: causal, evidence: Fig. 1}
  - {id: c2, text: Cells of the cortex divide late, evidence_type: correlational, evidence: Fig. 2, logic_jump: true}
assets:
  datasets: [{id: d1, accession: GSE900001, tissue: root, role: produces}]
  methods: [{id: m1, name: RootNet, repo: 'https://github.com/Lab/RootNet.git', role: proposes, io: counts to network, extends: [GENIE3]}]
  ideas: [{id: i1, text: Use the network on leaves, transfer: {type: cross-problem, to: t2}}]
user_insights: [{id: u1, text: The cortex timing may explain the domains, links_to: [c2, t2]}]
review_cards: [{q: What does RootNet infer?, a: a network, about: m1}]
"""
LIGHT = """rxf_version: 1
paper: {doi: 10.5555/made.2, title: A benchmark, year: 2023}
topics: [{id: t1, name: GRN inference, relation: about}]
claims: [{id: c1, text: Factor X decreases root growth, evidence_type: correlational, evidence: Table 1}]
assets: {datasets: [{id: d1, accession: GSE900001, tissue: shoot, role: uses}], methods: [{id: m1, name: GENIE3, role: evaluates}]}
"""
AGAIN = LIGHT.replace("doi: 10.5555/made.2", "doi: 10.5555/other").replace("year: 2023", "year: 2024").replace("c1, text: Factor X decreases", "c1, text: Factor X never decreases")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{i}.yaml", t.encode()) for i, t in enumerate((DEEP, LIGHT, AGAIN), 1)]
    f = spark.createDataFrame(rows, "eid long, path string, content binary")
    loaded = d.load(f)
    assert loaded.problems.isEmpty()
    return loaded.good.join(f.select("eid", "path"), "path").select("eid", "doc", F.lit(1).alias("tier"), F.lit(dt.datetime(2024, 5, 1)).alias("created_at"))


@pytest.fixture(scope="module")
def graph(docs):
    return ingest.materialize(docs)


def test_edges_and_entities(graph):
    e = {(r["src"], r["dst"], r["type"]): r for r in graph.edge.collect()}
    w = "work:doi:10.5555/made.1"
    assert (w, "dataset:GSE900001", "produces") in e and (w, "method:repo:github.com/lab/rootnet", "proposes") in e
    assert (w, "topic:gene regulatory network inference", "about") in e and (w, "topic:spatial domain detection", "applicable_to") in e
    assert (w, "modality:snrna-seq", "of_modality") in e and (w, "organism:arabidopsis thaliana", "of_organism") in e
    assert ("method:repo:github.com/lab/rootnet", "method:genie3", "extends") in e
    strengths = {r["attrs"]["strength"]: r["confidence"] for k, r in e.items() if k[2] == "supports" and k[0] == w}
    assert strengths == {"strong": 1.0, "weak": 0.5}
    kinds = {k[2] for k in e if k[0].startswith("idea:")}
    assert kinds == {"applicable_to", "relates_to"}


def test_same_title_next_year_is_one_paper(graph):
    assert {r["eid"]: r["key"] for r in graph.paper_of.collect()} == {1: "work:doi:10.5555/made.1", 2: "work:doi:10.5555/made.2", 3: "work:doi:10.5555/made.2"}


def test_producer_wins_and_questions_are_asked(graph):
    ds = graph.entity.filter("key = 'dataset:GSE900001'").first()
    assert ds["attrs"]["tissue"] == "root" and ds["external_id"] == "GSE900001"
    q = graph.queue.collect()
    assert any(r["kind"] == "contradiction" for r in q)
    assert graph.edge.filter("type = 'contradicts'").isEmpty()


def test_cards_only_from_deep_documents(graph):
    c = {r["entity_key"]: r for r in graph.cards.collect()}
    assert c["method:repo:github.com/lab/rootnet"]["origin"] == "export" and all(not k.startswith("claim:") for k in c)
    assert sum(r["priority"] == 10 for r in c.values()) == 1 and not any(k == "method:genie3" for k in c)


def test_result_does_not_depend_on_partitioning(docs, graph):
    other = ingest.materialize(docs.repartition(7))
    for name in ("entity", "edge", "alias", "cards", "queue"):
        a, b = getattr(graph, name), getattr(other, name)
        key = [c for c in a.columns if not c == "attrs"]
        assert a.select(*key).exceptAll(b.select(*key)).isEmpty() and a.count() == b.count(), name


def test_close_names_merge_but_not_across_origins(spark):
    rows = [("1", "method", "spatial domain detector", None, 1), ("2", "method", "spatial domain detectors", None, 2), ("3", "idea", "use the atlas on leaves", "model", 3),
            ("4", "idea", "use the atlas on leaves!!", "user", 4), ("5", "idea", "use the atlas on the leaves", "user", 5)]
    m = spark.createDataFrame(rows, "mid string, type string, name string, origin string, seq long").select(
        "*", F.array().cast("array<string>").alias("aliases"), F.col("name").alias("text"), F.lit(None).cast("string").alias("anchor"), F.lit(True).alias("auto"))
    res = rs.resolve(m, th=rs.Thresholds(merge_auto=0.7, merge_review=0.5))
    got = {r["mid"]: r["key"] for r in res.assigned.collect()}
    assert got["1"] == got["2"] and got["3"] == got["4"] and got["5"] != got["3"]


def test_a_long_chain_does_not_undo_other_merges(spark):
    """Fourteen names, each like the one before, go to earlier ones of the chain only, and an unrelated pair still merges."""
    words = [f"part{i:02d}x" for i in range(20)]
    names = [" ".join(words[i:i + 6]) for i in range(14)] + ["spatial domain detector", "spatial domain detectors"]
    m = spark.createDataFrame([(str(i), n, i) for i, n in enumerate(names)], "mid string, name string, seq long").select(
        "*", F.lit("method").alias("type"), F.lit(None).cast("string").alias("origin"), F.array().cast("array<string>").alias("aliases"), F.col("name").alias("text"),
        F.lit(None).cast("string").alias("anchor"), F.lit(True).alias("auto"))
    got = {int(r["mid"]): r["key"] for r in rs.resolve(m, th=rs.Thresholds(merge_auto=0.7, merge_review=0.5)).assigned.collect()}
    assert got[14] == got[15] and len(got) == 16
    assert all(names.index(got[i].removeprefix("method:")) <= i for i in range(14)) and len({got[i] for i in range(14)}) < 14


def test_an_acronym_is_a_question(spark):
    names = ["Spatially Resolved Domain Mapper", "SRM db", "SRDM"]
    m = spark.createDataFrame([(str(i), n, i) for i, n in enumerate(names)], "mid string, name string, seq long").select(
        "*", F.lit("method").alias("type"), F.lit(None).cast("string").alias("origin"), F.array().cast("array<string>").alias("aliases"), F.col("name").alias("text"),
        F.lit(None).cast("string").alias("anchor"), F.lit(True).alias("auto"))
    res = rs.resolve(m)
    assert {(r["kind"], r["a"], r["b"], r["score"]) for r in res.queue.collect()} == {("merge", "method:srdm", "method:spatially resolved domain mapper", 0.6)}


def test_rebuild_twice_keeps_ids_and_publishes(spark, docs, tmp_path):
    ex = docs.withColumn("is_current", F.lit(True))
    none = spark.createDataFrame([], "id long, reason string")
    dec = spark.createDataFrame([(1, "rename", '{"key": "method:genie3", "name": "GENIE 3"}'), (2, "retract", '{"work": "x", "extraction_ids": [3]}')], "id long, op string, payload string").select(
        "*", F.lit(dt.datetime(2024, 6, 1)).alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    one = rebuild.rebuild(ex, none, dec)
    rebuild.publish(spark, one, str(tmp_path), 1)
    first = spark.read.parquet(rebuild.current(spark, str(tmp_path))["entity"])
    two = rebuild.rebuild(ex, none, dec, old_ids=first.select("key", "id"))
    assert two["entity"].select("key", "id").exceptAll(first.select("key", "id")).isEmpty()
    assert first.filter("key = 'method:genie3'").first()["canonical_name"] == "GENIE 3" and one["paper_of"].count() == 2
    with pytest.raises(rebuild.PreflightError):
        rebuild.rebuild(ex, spark.createDataFrame([(9, "unknown version")], "id long, reason string"), dec)


def test_inbox_stream_routes_and_ignores_repeats(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "out")
    box.mkdir()
    (box / "a.yaml").write_text(DEEP)
    (box / "b.yaml").write_text("rxf_version: 9\n")
    feeds.ingest_stream(spark, str(box), out, str(tmp_path / "cp")).awaitTermination()
    (box / "copy of a.yaml").write_text(DEEP)
    (box / "c.yaml").write_text(LIGHT)
    feeds.ingest_stream(spark, str(box), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/documents").count() == 2 and spark.read.parquet(f"{out}/quarantine").count() == 1
    assert spark.read.parquet(f"{out}/objects").count() == 3


def test_failed_batch_is_repeated_and_unseen(spark, tmp_path):
    box, out = tmp_path / "in", str(tmp_path / "out")
    box.mkdir()
    (box / "a.yaml").write_text(DEEP)
    feeds.ingest_stream(spark, str(box), out, str(tmp_path / "cp")).awaitTermination()
    (box / "b.yaml").write_text("rxf_version: 9\n")
    (box / "c.yaml").write_text(LIGHT)
    calls = []

    def stop(batch, table):
        calls.append((batch, table))
        if calls == [(1, "documents"), (1, "quarantine")]:
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        feeds.ingest_stream(spark, str(box), out, str(tmp_path / "cp"), watch=stop).awaitTermination()
    assert feeds.ingested(spark, out, "documents").count() == 1  # the half-written batch is not seen
    feeds.ingest_stream(spark, str(box), out, str(tmp_path / "cp"), watch=stop).awaitTermination()
    assert [feeds.ingested(spark, out, n).count() for n in feeds.TABLES] == [2, 1, 3]
    feeds.ingest_stream(spark, str(box), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/ledger").count() == 2


def test_card_states_with_late_reviews_and_lost_state(spark, tmp_path):
    def review(name, rows):
        spark.createDataFrame(rows, "card_id string, rating int, at string").selectExpr("card_id", "rating", "cast(at as timestamp) reviewed_at").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "log"))

    def drain():
        schema = "card_id string, rating int, reviewed_at timestamp"
        n = cards.drain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")), str(tmp_path))
        return n, {r["card_id"]: (r["reviews"], r["lapses"], r["last_rating"]) for r in cards.cards(spark, str(tmp_path)).collect()}

    review("one", [("a", 3, "2024-01-05"), ("a", 1, "2024-01-03"), ("b", 2, "2024-01-01")])
    assert drain() == (0, {"a": (2, 1, 3), "b": (1, 0, 2)})
    review("late", [("a", 1, "2024-01-01"), ("b", 4, "2024-01-09")])  # the first is older than what the state has
    assert drain() == (0, {"a": (3, 2, 3), "b": (2, 0, 4)})
    for f in (tmp_path / "checkpoint-0" / "state").rglob("*"):
        if f.is_file() and f.suffix in (".zip", ".changelog", ".delta", ".snapshot"):
            f.write_bytes(b"no state")
    review("after", [("c", 1, "2024-01-10"), ("a", 2, "2024-01-11")])
    assert drain() == (1, {"a": (4, 2, 2), "b": (2, 0, 4), "c": (1, 1, 1)})


def test_papers_by_metadata_id_and_unwrapped_address(spark, docs):
    made = docs.select("eid").orderBy("eid").collect()
    ids = spark.createDataFrame([(made[0]["eid"], "W9"), (made[-1]["eid"], "W9")], "eid long, metadata_id string")
    keys = {r["eid"]: r["key"] for r in ingest.papers(docs, ids).collect()}
    assert keys[made[0]["eid"]] == keys[made[-1]["eid"]] == "work:openalex:W9"
    assert all(k.startswith("work:doi:") for k in (r["key"] for r in ingest.papers(docs).collect()))
    url = F.struct(*[F.lit("[https://a.example/x](https://a.example/x)").alias("url") if c == "url" else F.col(f"doc.paper.{c}").alias(c) for c in docs.select("doc.paper.*").columns])
    g = ingest.materialize(docs.withColumn("doc", F.col("doc").withField("paper", url)))
    assert {r["u"] for r in g.entity.filter("type = 'work'").select(F.col("attrs")["url"].alias("u")).collect()} == {"https://a.example/x"}


def test_papers_and_hubs_wait_for_no_resolution(docs, graph, monkeypatch):
    """All tables were made for whichever was asked for."""
    monkeypatch.setattr(ingest, "resolve", None)
    g = ingest.materialize(docs)
    assert sorted(g.paper_of.collect()) == sorted(graph.paper_of.collect())
    cols = ["key", "type", "canonical_name", "external_id"]
    assert sorted(map(str, g.hubs.select(*cols).collect())) == sorted(map(str, graph.entity.filter("type in ('organism','modality')").select(*cols).collect()))


def test_one_type_resolves_like_all(docs, graph):
    own = ingest.materialize(docs).resolved("topic").entities.select("key")
    assert sorted(own.collect()) == sorted(graph.entity.filter("type = 'topic'").select("key").collect())
