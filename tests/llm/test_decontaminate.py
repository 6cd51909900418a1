"""Decontamination against brute force over all windows, with short items, edges, repeats and long texts."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.llm import decontaminate


def spoken(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = spoken(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i:i + k])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    for key, text in docs:
        w, hit, found = spoken(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        yield key, len(w), len(hit), tuple(sorted(found))


def cases():
    rnd = random.Random(5)
    word = lambda: rnd.choice("alpha beta gamma delta é中 x9 Zed".split())  # noqa: E731 - few words, so that many runs repeat
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 40)))) for i in range(40)]
    items += [(1, "a second text of item one with more than ten words in it"), (None, "an item without any id but with a long enough text to have windows"),
              (90, None), (91, "!!"), (92, "Single"), (93, "two, words"), (94, "single"), (95, "the same word the same word the same word the same word the same word")]
    docs = [(1, None), (2, ""), (3, "... ,"), (4, "single"), (5, "some Two-words, and a SINGLE one"), (6, "the same word " * 400), (6, "the same word " * 400)]
    for i in range(150):
        text = [word() for _ in range(rnd.randint(0, 60))]
        own = spoken(rnd.choice(items)[1])
        at = rnd.randint(0, len(text))
        cut = sorted((rnd.randint(0, len(own)), rnd.randint(0, len(own))))
        docs.append((100 + i, rnd.choice([" ", "; ", "\n"]).join(text[:at] + own[cut[0]:cut[1]] + text[at:])))
    docs += [(None, "no id: " + (items[3][1] or "")), (999, " ".join(f"w{i}" for i in range(600_000)) + " " + items[0][1])]
    return docs, items


@pytest.mark.parametrize("small", [True, False])
def test_every_window_is_found(spark, monkeypatch, small):
    docs, items = cases()
    if not small:  # the join of tables beyond the broadcast bound, a filter that lets much through, small blocks
        monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df: df.hint("merge"))
        monkeypatch.setattr(decontaminate, "BLOOM_BITS", (64, 64))
        monkeypatch.setattr(decontaminate, "BLOCK", 17)
        docs = docs[:-1]
    d = spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], "doc_id long, text string, item string, row int").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hash int")
    rows = decontaminate.find(d, b).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows), key=repr)
    assert got == sorted(brute(docs, items), key=repr)
    assert all(s["end"] - s["begin"] >= 1 and s["end"] <= r["n_words"] for r in rows for s in r["spans"])
    assert {r["n_hit"] for r in decontaminate.find(d, b.limit(0)).collect()} == {0}
    assert decontaminate.find(d.limit(0), b).count() == 0


def test_least_fingerprints_are_few_and_cover():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 20_000, np.uint64)
    place, hash_ = decontaminate.winnowed(h, np.zeros(len(h), np.int32))
    assert np.diff(place).max() <= decontaminate.SPAN - decontaminate.GRAM + 1 and 0.25 < len(place) / len(h) < 0.32
    g = decontaminate.grams(h, decontaminate.GRAM)
    assert all(hash_[np.searchsorted(place, i):np.searchsorted(place, i + 6)].min() == g[i:i + 6].min() for i in range(0, 19_000, 7))


def test_filter_has_no_false_negatives(spark):
    prints = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    hashes = np.array([r["hash"] for r in prints.collect()], np.int64).astype(np.uint64)
    filter_ = decontaminate.bloom(prints)
    assert decontaminate.maybe(filter_, hashes).all()
    assert decontaminate.maybe(filter_, np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64)).mean() < 0.01
