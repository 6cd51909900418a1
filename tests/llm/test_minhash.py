"""Near-duplicates with hot buckets, repeated ids and rows, and pairs that have to wait, against brute force."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from litgraph.llm import minhash

from .test_operators import brute_components


def crowd():
    """A large group of near copies, copies of copies, a chain, and groups of like texts that are not similar enough."""
    rnd = random.Random(9)
    base = [f"v{rnd.randrange(900)}" for _ in range(100)]

    def bent(words, k):
        words = list(words)
        for _ in range(k):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
        return " ".join(words)

    rows = [(i, bent(base, rnd.randint(0, 6))) for i in range(60)]
    for g in range(6):
        core = [f"g{g}x{rnd.randrange(500)}" for _ in range(90)]
        rows += [(1000 + 100 * g + i, bent(core, rnd.choice([2, 9, 12]))) for i in range(14)]
    return rows


def test_hot_buckets_and_waiting_pairs(spark, monkeypatch):
    for name, value in (("HOT", 3), ("BLOCK", 4), ("FIRST_BEST", 1)):
        monkeypatch.setattr(minhash, name, value)
    texts = crowd()
    _, root = brute_components(texts, 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), size=2, percent=80).collect()}
    assert got == root


def test_repeated_ids_are_one_node_and_one_row_stays(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a)] * 40 + [(5, b), (7, b), (9, a + " end"), (None, a), (None, "alone and without an id"), (None, "alone and without an id"), (3, None), (3, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, number string, id int")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, size=5, percent=80).collect())
    assert got == {(5, 56, 5, True): 41, (7, 56, 5, False): 1, (9, 57, 5, False): 1, (None, 56, 5, False): 1, (None, 1, None, True): 2, (3, 0, 3, True): 2}
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(5, a), (5, b), (None, "alone and without an id"), (3, None), (3, None)], key=repr)


def test_pairs_of_cells_are_all_pairs():
    rng = np.random.default_rng(4)
    rows, bands, per = [], 8, 5
    pool = rng.integers(0, 3, (30, bands * per)).astype("<u2")
    pool[:, :per] = 1  # all share the first band, whose bucket they are in
    same = np.arange(60, dtype=np.uint64) << np.uint64(57)
    for cell in range(4):
        kind = cell % 2
        for node in range(12):
            rows.append((cell // 2, kind, 0, 0, 2 if kind else node % 2, 0, 100 * cell + node, 100 * cell + node // 3, 50 + node, pool[rng.integers(30)].tobytes(), minhash.sketch(same)))
    names = ["bucket", "kind", "i", "j", "side", "band", "node", "root", "n_shingles", "sig", "sketch"]
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})

    def brute():
        for (p, x), (q, y) in itertools.permutations(enumerate(rows), 2):
            if x[:4] != y[:4] or x[7] == y[7] or not (x[4] == y[4] == 2 and x[6] < y[6] or (x[4], y[4]) == (0, 1)):
                continue
            one, two = (np.frombuffer(r[9], "<u2") for r in (x, y))
            if 100 * min(x[8], y[8]) >= 80 * max(x[8], y[8]) and (one == two).sum() >= 12:
                yield p, q

    want = set(brute())
    x, y, waits = minhash.meet(table, 12, per, 80, 10**6)
    assert want and set(zip(x.tolist(), y.tolist())) == want and not waits.any()
    x, y, waits = minhash.meet(table, 12, per, 80, 1)
    assert set(zip(x.tolist(), y.tolist())) == want
    assert max(collections.Counter((i, rows[j][7]) for i, j in zip(x[~waits].tolist(), y[~waits].tolist())).values()) == 1


def test_sketches_let_every_similar_pair_pass():
    rng = np.random.default_rng(8)
    passed = collections.Counter()
    for size in (1, 2, 5, 9, 40, 170, 600, 3000):
        for trial in range(150):
            union = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
            for share in (0.8, 0.6):
                both = -(-len(union) * int(100 * share) // 100)
                mixed = rng.permutation(union)
                half = both + rng.integers(0, len(union) - both + 1)
                one, two = np.sort(np.concatenate([mixed[:both], mixed[both:half]])), np.sort(np.concatenate([mixed[:both], mixed[half:]]))
                ok = minhash.alike(*(minhash.bins_of(minhash.sketch(s), len(s))[None] for s in (one, two)), np.array([len(one) + len(two)]), 80)[0]
                passed[size, share] += ok
    some = np.unique(rng.integers(0, 1 << 63, 250, np.uint64) * np.uint64(2))
    assert (minhash.bins_of(minhash.sketch(some), len(some)) == minhash.binned(some >> np.uint64(54), some & np.uint64(0xFFFF))).all()
    assert all(n == 150 for (_, share), n in passed.items() if share == 0.8)
    assert all(n <= 1 for (size, share), n in passed.items() if share == 0.6 and size >= 40)


def test_tables_of_the_rounds_are_deleted(spark):
    import glob
    import os
    from litgraph.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l"), (4, None), (5, "one two three")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    before = set(glob.glob(f"{folder}/minhash-*"))
    out = minhash.near_duplicates(texts, size=2, percent=80)
    left = {os.path.basename(f).rsplit("-", 1)[0] for f in set(glob.glob(f"{folder}/minhash-*")) - before}
    assert left.isdisjoint({"minhash-signed", "minhash-classes", "minhash-alone", "minhash-texts", "minhash-members"})
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_keep_first_holds_a_text_once(spark, monkeypatch):
    held = {}
    write = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, what: held.setdefault(what, df.columns) and write(df, what))
    rows = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "g h i j k l", "z")], "doc_id long, text string, more string")
    assert sorted(r["more"] for r in minhash.keep_first(rows).collect()) == ["x", "z"]
    assert "text" not in held["minhash-rows"]
