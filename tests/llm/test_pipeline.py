"""The whole pipeline on a small corpus with nulls, repeated rows and clashing columns, stage by stage against brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from litgraph.llm import quality, toxicity
from litgraph.llm.common import crc_bucket, local_tokenizer

from .test_operators import brute_components, insults

tokenizers = pytest.importorskip("tokenizers")


def corpus():
    rnd = random.Random(6)
    rows = [(i, "the " + t + " and of the end", 7, y) for i, t, y in insults(500, 8)]  # stop words keep the rules quiet
    clean = [r for r in rows if not r[3]]
    for k, (i, t, n, _) in enumerate(clean[:40]):
        words = t.split()
        if k % 2:
            words[rnd.randrange(len(words))] = "changed"
        rows += [(1000 + 3 * k + j, " ".join(words), n, 0) for j in range(1 + k % 3)]
    rows += [(5000, None, 1, 0), (5001, "", 1, 0), (5002, "too short", 1, 0), (5003, "same words here again and now " * 40, 1, 0), (None, clean[50][1], 1, 0), (None, "the words of a row without an id and of some length to stay", 1, 0)]
    rows += [rows[0], clean[60], clean[60]]  # repeated rows
    rows.append((9000, "the " + " ".join(f"w{i}" for i in range(4000)) + " of and the", 1, 0))
    return rows


def judged(text):
    """The verdict of the quality rules, spelled out."""
    w = [x.decode() for x in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    repeat = len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)})
    if len(w) < 10 or 100 * repeat > 20 * len(w):
        return False
    m = {"n_words": len(w), "mean_word_chars": sum(map(len, w)) / len(w), "symbol_ratio": sum(map((text or "").count, "#*$%&|<>")) / len(w),
         "stop_word_ratio": sum(x.lower() in quality.STOP_WORDS for x in w) / len(w), "bar_word_ratio": w.count("|") / len(w),
         "capital_word_ratio": sum(len(x) > 1 and x.upper() == x != x.lower() for x in w) / len(w), "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)),
         "top_word_run_ratio": sum(a == b for a, b in zip(w, w[1:])) / len(w)}
    return all((lo is None or m[k] >= lo) and (hi is None or m[k] <= hi) for k, (lo, hi) in quality.RULES.items())


def test_run_is_its_stages(spark, tmp_path):
    rows = corpus()
    columns = "doc_id long, text string, n_words int, toxic_ int, kept string, score string, row string, _row string, component_id string"
    docs = spark.createDataFrame([(*r, "k", "s", "r", "_r", "c") for r in rows], columns)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, _, y in rows if i is not None and i < 500], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))

    good = corpus_pipeline.quality_rules(spark, whole, str(tmp_path))
    assert good.columns == whole.columns
    want = [r[:2] for r in rows if judged(r[1])]
    assert 400 < len(want) < len(rows) and sorted(((r["doc_id"], r["text"]) for r in good.collect()), key=repr) == sorted(want, key=repr)

    good = good.cache()
    mild = corpus_pipeline.toxicity_filter(spark, good, str(tmp_path))
    assert mild.columns == whole.columns
    model = toxicity.learn(good, spark.read.parquet(str(tmp_path / "labels.parquet")).select("doc_id", "toxic"), crc_bucket(F.col("doc_id")) != 0)
    stay = [t for i, t in want if model.scores(toxicity.worst_words(model, [t]))[0] < 0.5]
    left = mild.collect()
    assert sorted(r["text"] for r in left) == sorted(stay)
    toxic = collections.Counter(bool(r["toxic_"]) for r in left)
    assert toxic[True] <= 3 and toxic[False] >= 0.97 * sum(judged(t) and not y for _, t, _, y in rows)

    one = corpus_pipeline.near_duplicates(spark, mild, str(tmp_path))
    assert one.columns == whole.columns
    texts = list(enumerate(r["text"] for r in left))
    _, root = brute_components(texts, 5, 80)
    groups = collections.defaultdict(list)
    for k, r in root.items():
        groups[r].append((left[k]["doc_id"] is None, left[k]["doc_id"] or 0))
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in one.collect())
    assert ids == sorted(-1 if none else i for none, i in map(min, groups.values()))

    library = tokenizers.Tokenizer.from_file(local_tokenizer())
    library.no_padding()
    library.no_truncation()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text_of = {i: t for i, t in want}
    assert {r["doc_id"] if r["doc_id"] is not None else -1 for r in pieces} == set(ids)
    for r in pieces:
        if r["doc_id"] is not None:
            full = np.array([*library.encode(text_of[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
            assert r["doc_tokens"] == len(full) and r["ids_crc32"] == zlib.crc32(full[r["start"]:r["start"] + r["length"]].tobytes())
    held = collections.Counter()
    for r in pieces:
        held[r["doc_id"]] += r["length"]
    assert all(held[i] == len(library.encode(text_of[i], add_special_tokens=False).ids) + 1 for i in ids if i >= 0)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "packing"]
