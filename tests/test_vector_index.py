"""Inverted lists against brute force: exact search, recall, copies, ties, classes with an order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.operators import retrieval as rt
from litgraph.operators import vector_index as vi


def crowd(n: int = 1500, dim: int = 16, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(25, dim))
    v = middle[rng.integers(25, size=n)] + 0.5 * rng.normal(size=(n, dim))
    v[: n // 3] = v[0]  # a third of the rows are copies
    v[n // 3] = 0
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def brute(v: np.ndarray, probes, k: int, floor: float = -2.0, seq: bool = False):
    for p in probes:
        s = np.round(v.astype(np.float64) @ v[p].astype(np.float64), 6)
        ok = [i for i in range(len(v)) if i != p and s[i] >= floor and (not seq or (i < p and i % 3 == p % 3))]
        for rank, i in enumerate(sorted(ok, key=lambda i: (-s[i], i))[:k], 1):
            yield p, i, rank


@pytest.fixture(scope="module")
def frame(spark):
    v = crowd()
    rows = [(i, v[i].tolist(), i % 3, i) for i in range(len(v))]
    return v, spark.createDataFrame(rows, "id long, vec array<float>, cls long, seq long").repartition(4).cache()


def answers(df):
    return sorted((r["probe"], r["id"], r["rank"]) for r in df.collect())


def test_exact_search_is_brute_force(frame):
    v, df = frame
    own = df.select("id", "vec")
    probes = list(range(0, len(v), 10))
    got = answers(vi.nearest(own, own.filter("id % 10 = 0"), 7, exact=True, lists=2, list_rows=40))
    assert got == sorted(brute(v, probes, 7))
    got = answers(vi.nearest(own, own.filter("id % 10 = 0"), 7, 0.6, exact=True, lists=2, list_rows=40))
    assert got == sorted(brute(v, probes, 7, 0.6))


def test_recall_of_few_lists(frame):
    v, df = frame
    own = df.select("id", "vec").filter("id >= 500")
    probes = own.filter("id % 10 = 0")
    truth = vi.nearest(own, probes, 10, exact=True, list_rows=10**6)
    row = vi.recall(vi.nearest(own, probes, 10, list_rows=40), truth).first()
    assert row["probes"] == 100 and row["wanted"] == 1000 and row["recall"] >= 0.9


def test_earlier_rows_of_a_class(frame):
    v, df = frame
    late = df.filter("id >= 500")
    got = vi.nearest(late, late, 3, lists=4, list_rows=40, exact=True)
    want = [(p, i, r) for p, i, r in brute(np.concatenate([np.zeros((500, 16), np.float32), v[500:]]), range(500, len(v)), 10**6, seq=True) if i >= 500]
    best = {}
    for p, i, _ in want:
        best.setdefault(p, []).append(i)
    assert answers(got) == sorted((p, i, r) for p, ids in best.items() for r, i in enumerate(ids[:3], 1))
    # few earlier rows: a probe that found too little looks into all lists
    few = {r["probe"] for r in vi.nearest(late, late.filter("id < 512"), 3, lists=1, list_rows=40).collect()}
    assert few == set(range(503, 512))


def test_empty_sides(frame):
    _, df = frame
    own = df.select("id", "vec")
    assert vi.nearest(own, own.limit(0), 3).count() == 0 and vi.nearest(own.limit(0), own, 3).count() == 0


def test_a_hot_list_is_dealt_to_cells(frame, monkeypatch):
    v, df = frame
    monkeypatch.setattr(vi, "CELL", 30)
    late = df.filter("id >= 500").select("id", F.concat(F.array(F.lit(1.0).cast("float")), F.transform("vec", lambda x: x * 0)).alias("vec"))
    hits = vi.search(vi.build(late, list_rows=100), late.filter("id % 100 = 0"), 4)
    assert answers(hits) == sorted((p, i, r) for p in range(500, 1500, 100) for r, i in enumerate([i for i in range(500, 506) if i != p][:4], 1))


def test_recall_does_not_fall_with_the_number_of_lists(spark):
    v = np.random.default_rng(5).normal(size=(3000, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(len(v))], "id long, vec array<float>").repartition(4).cache()
    probes = df.filter("id % 10 = 0")
    truth = spark.createDataFrame([(int(p), int(i)) for p, i, _ in brute(v, range(0, len(v), 10), 10)], "probe long, id long")
    assert vi.recall(vi.nearest(df, probes, 10, list_rows=10), truth).first()["recall"] >= 0.9


def test_a_probe_goes_to_a_pack_once(frame):
    _, df = frame
    index = vi.build(df.select("id", "vec").filter("id >= 500"), list_rows=10)
    routed = vi._routed(index, index.rows.select("id", "vec", F.lit(-2.0).alias("least")), 2, 5, "exact")
    assert len(index.sizes) == 100 and routed.count() == 1000 * len(set(index.pack.tolist())) == 1000
    assert routed.agg(F.min(F.size("lists"))).first()[0] >= len(index.sizes) - 2 - int((index.sizes == 0).sum())


def test_centroids_are_not_fitted_in_the_driver(frame, monkeypatch):
    import os
    driver, fit = os.getpid(), vi.centres

    def elsewhere(*of):
        assert os.getpid() != driver
        return fit(*of)

    monkeypatch.setattr(vi, "centres", elsewhere)
    index = vi.build(frame[1].select("id", "vec"), list_rows=100)
    assert index.centroids.shape[1] == 16 and len(index.centroids) > 1 and index.sizes.sum() == index.rows.count()


def test_embedding_keeps_few_places(monkeypatch):
    from litgraph.functions import embed
    texts = ["one text", "", "one  text", "grün 增加"]
    whole = embed.hash_vectors(texts, {})
    known = {}
    monkeypatch.setattr(embed, "KNOWN", 2)
    assert (embed.hash_vectors(texts, known) == whole).all() and len(known) <= 2
    assert np.allclose(np.linalg.norm(whole, axis=1), 1)


@pytest.mark.parametrize("k", [7, 2000])
def test_long_lists_are_not_sorted_in_one_task(frame, monkeypatch, k):
    """More hits of a probe than one task may sort: numbered over ranges, or all of them, with the same ranks."""
    v, df = frame
    own = df.select("id", "vec")
    monkeypatch.setattr(rt, "RANKED", 5)
    assert answers(rt.top_similar(own, own.filter("id in (0, 500, 900)"), k)) == sorted(brute(v, (0, 500, 900), k))


@pytest.mark.parametrize("kept", [2_000_000, 0])
def test_scan_with_bounds_is_brute_force(frame, monkeypatch, kept):
    """Small blocks, so that bounds tighten; classes with an order; the same probes by their different vectors."""
    v, df = frame
    monkeypatch.setattr(rt, "KEPT", kept)
    monkeypatch.setattr(rt, "BLOCK", 200)
    some = df.filter("id % 100 < 2")
    ids = [i for i in range(len(v)) if i % 100 < 2]
    assert answers(rt.top_similar(df, some, 4, 0.2)) == sorted(brute(v, ids, 4, 0.2, seq=True))
    two = df.select("id", "vec")
    monkeypatch.setattr(rt, "nearest", None)
    for most in (2000, 25):  # 30 probes, 10 of them copies of one vector: beyond the count they need no lists
        assert answers(rt.top_similar(two, two.filter("id % 100 < 2"), 4, 0.2, max_probes=most)) == sorted(brute(v, ids, 4, 0.2))
