"""Operators on small tables with nulls, empty and odd texts, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.llm import bpe, chat, gru, licenses, minhash, packing, quality, shards, sketch, toxicity
from litgraph.llm.common import LOWER, crc_bucket, local_tokenizer

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, kept string, shard string, _row string"


def odd_texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(4)
    base = [rnd.choice("red green blue olive amber teal coral ivory".split()) + str(rnd.randrange(400)) for _ in range(300)]
    near = [w if rnd.random() > 0.02 else "zz" for w in base]
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "It's we'll I'd <|endoftext|> ΑΣ ΟΔΟΣ É é 中文 🙂\x1c x"), (6, " ".join(base)), (7, " ".join(near)),
            (8, " ".join(base)), (8, " ".join(base)), (9, "the same line of text here\nthe same line of text here\nother"), (10, "ab" * 3000), (11, "a | b | c <|im_end|> #$%&"),
            (12, " ".join(f"w{i}" for i in range(5000))), (13, " ".join(f"w{i}" for i in range(5000)).upper()), (None, "no id at all, but some words of its own to keep here"),
            (14, "THE CAPITALS OF THE WORLD ARE LOUD AND LONG AND LOUD"), (15, "x\n\ny\nx\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "k", "s", "r") for i, t in odd_texts()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(local_tokenizer())
    t.no_padding()
    t.no_truncation()
    return t


def by_id(rows, *names):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, *(r[n] for n in names)) for r in rows), key=repr)


def test_encoding_is_the_librarys(docs, none, library):
    rows = bpe.encode(docs.withColumn("ids", F.lit(1)), local_tokenizer(), decoded="decoded").collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs.select("doc_id", "text"), local_tokenizer()), local_tokenizer()).collect()
    assert by_id(again, "decoded") == by_id(rows, "decoded")
    assert bpe.encode(none, local_tokenizer()).count() == 0


def test_long_and_short_trees_agree():
    b = bpe.Bpe(local_tokenizer())
    for text in ("internationalization", "abab" * 12, "q" * 60):
        raw = text.encode()
        rows = np.frombuffer(b.merge([raw])[0], "<u4").tolist()
        assert rows == bpe.merge_one([*b.first[list(raw[:-1])].tolist(), int(b.last[raw[-1]])], b.table)


def test_packing_holds_every_id_once(docs, none, library):
    want = collections.defaultdict(list)
    for i, t in odd_texts():
        want[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    rows = packing.with_crc(packing.pack(docs, local_tokenizer(), seq_len=256, group_rests=4)).collect()
    seqs, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        assert ids == want[r["doc_id"]][0][r["start"]:r["start"] + r["length"]] and r["doc_tokens"] == len(want[r["doc_id"]][0])
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append((r["start"], r["length"]))
    for of in seqs.values():
        at = 0
        for offset, n in sorted(of):
            assert offset == at
            at += n
        assert at <= 256
    for i, of in parts.items():
        copies = len(want[i])
        covered = collections.Counter(p for start, n in of for p in range(start, start + n))
        assert covered == collections.Counter({p: copies for p in range(len(want[i][0]))})
    assert packing.pack(none, local_tokenizer()).count() == 0


def test_rests_go_to_the_cheapest_sequence_with_room():
    placed = packing.assign(np.array([90, 80, 20, 10]), 100, 1.0, 0.01)
    assert [(r, s) for r, _, _, s, _ in placed] == [(0, 0), (1, 1), (2, 1), (3, 0)]
    cut = packing.assign(np.array([70, 70, 60]), 100, 1.0, 0.0)
    assert sum(n for _, _, n, _, _ in cut) == 200 and len({s for *_, s, _ in cut}) == 2


def test_quality_measures(docs, none):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        t = r["text"] or ""
        w = [x.decode() for x in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i:i + 5])].append(i)
        repeat = len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)})
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeat)
        assert r["n_symbols"] == sum(map(t.count, "#*$%&|<>"))
        assert r["base_failed"] == (len(w) < 10 or 100 * repeat > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(none).count() == 0
    assert not [r for r in rows if r["doc_id"] == 14][0]["kept"]


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().translate(LOWER).split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, {i: find(i) for i in sets}


def test_near_duplicates_are_the_exact_components(spark, docs, none):
    texts = [(i, t) for i, t in odd_texts() if i is not None]
    rnd = random.Random(2)
    base = [f"v{rnd.randrange(900)}" for _ in range(120)]
    for k in range(40):  # a chain of near copies, each close to the one before
        base = list(base)
        base[rnd.randrange(120)] = f"n{k}"
        texts.append((100 + k, " ".join(base)))
    for size in (2, 5):
        sets, root = brute_components(texts, size, 80)
        df = spark.createDataFrame(texts + [(None, "no id at all")], "doc_id long, text string")
        rows = minhash.near_duplicates(df, size=size, percent=80).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            i = r["doc_id"]
            if i is None:
                assert r["kept"] and r["component_id"] is None
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root[i], root[i] == i)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_first(docs).collect()
    _, root = brute_components([(i, t) for i, t in odd_texts() if i is not None], 5, 80)
    assert {r["doc_id"] for r in kept} == {i for i, r in root.items() if i == r} | {None}
    assert set(kept[0].asDict()) == set(docs.columns)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in minhash.components(links).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def test_chat_fold_and_round_trip(spark):
    e = [(1, 1, "message", 0, "user", "a <|im_end|> b <\\| c"), (1, 2, "message", 1, "assistant", None), (1, 3, "delta", 1, None, "one "), (1, 4, "delta", 1, None, "two"),
         (1, 5, "message", 2, "user", "dropped"), (1, 6, "regenerate", 1, None, "x"), (1, 7, "delta", 1, None, "<|im_start|>new"), (1, 8, "edit", 0, None, "asked again"),
         (1, 9, None, 2, "us\\er\n", ""), (None, 1, "message", None, None, None)]
    log = spark.createDataFrame(e, "conv_id long, seq long, kind string, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    messages = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(log).collect()}
    assert messages == {(1, 0): ("user", "asked again"), (1, 1): ("assistant", "<|im_start|>new"), (1, 2): ("us\\er\n", ""), (None, None): ("", "")}
    segments = chat.render(chat.fold(log))
    back = {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["masked"]) for r in chat.read_back(segments).collect()}
    assert {k: v[:2] for k, v in back.items()} == messages and back[1, 1][2] == "<|im_start|>new" and back[1, 0][2] is None
    row = {r["conv_id"]: r for r in chat.digests(segments).collect()}[1]
    said = "user\nasked again\nassistant\n<|im_start|>new\nus\\er\n\n\n"
    assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and row["n_turns"] == 3 and row["loss_chars"] == 15
    whole = "".join(r["segment"] for r in segments.where("conv_id = 1").orderBy("position").collect())
    assert row["formatted_chars"] == len(whole)
    assert chat.digests(chat.render(chat.fold(log.limit(0)))).count() == 0


def test_null_turns_stand_first(spark):
    e = [(1, 1, "message", None, "system", "rules"), (1, 2, "message", 1, "user", "q"), (1, 3, "message", 2, "assistant", "old"), (1, 4, "regenerate", 1, None, ""), (1, 5, "delta", 1, None, "new"),
         (2, 1, "message", None, "user", "a"), (2, 2, "message", 0, "user", "gone"), (2, 3, "regenerate", None, None, ""), (2, 4, "delta", None, None, "b")]
    log = spark.createDataFrame(e, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = sorted(((r["conv_id"], r["turn"], r["text"]) for r in chat.fold(log).collect()), key=repr)
    assert got == sorted([(1, None, "rules"), (1, 1, "new"), (2, None, "b")], key=repr)


def test_rests_of_one_id_are_spread(spark):
    df = spark.createDataFrame([(7 if i % 3 else i, f"text of row {i}") for i in range(600)], "doc_id long, text string").repartition(4)
    rows = packing.pack(df, local_tokenizer(), seq_len=64, group_rests=20).collect()
    sizes = collections.Counter(r["sequence_id"] >> 32 for r in rows)
    assert max(sizes.values()) < 80 and sum(r["length"] for r in rows) == sum({(i): r["doc_tokens"] for i, r in enumerate(rows) if r["start"] == 0}.values())


def test_shards_are_even_and_gapless(spark, docs, none):
    rows = [(i, int(h), 8 + i % 50) for i in range(4000) for h in [hash(str(i)) % 1000 if i % 3 else 7]]
    df = spark.createDataFrame(rows + [(None, None, None)] * 2, "id long, key long, size long")
    got = shards.shard(df, "key", "id", "size", 24).collect()
    assert len(got) == 4002
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"] or 0
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 24
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean
    few = shards.shard(df.where("key <> 7"), "key", "id", "size", 4, whole_keys=100).collect()
    where = collections.defaultdict(set)
    for r in few:
        where[r["key"]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    assert shards.shard(df.limit(0), "key", "id", "size").count() == 0


def test_sketches_recover_differences(spark, docs, none):
    rng = np.random.default_rng(1)
    sets = [(rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, m, np.uint64)) for n, m in ((0, 0), (3, 0), (40, 41), (500, 2))]
    common = rng.integers(0, 1 << 63, 300, np.uint64)
    left, right = [np.concatenate([a, common]) for a, _ in sets], [np.concatenate([b, common]) for _, b in sets]
    only = sketch.differences(left, right)
    for i, (a, b) in enumerate(sets):
        assert sorted(only[0][i].tolist()) == sorted(a.tolist()) and sorted(only[1][i].tolist()) == sorted(b.tolist())
    texts = sorted(((i, t or "") for i, t in odd_texts()), key=lambda x: (-(x[0] if x[0] is not None else -10**9), x[1]))
    want = []
    for (i, t), (_, nxt) in zip(texts, texts[1:] + texts[:1], strict=True):
        want.append((i, len(t), hashlib.sha256(sketch.edited(t, nxt).encode()).hexdigest()))
    rows = sketch.compare_next(docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=repr) == sorted(want, key=repr)
    same = [r["fingerprint"] for r in rows if r["doc_id"] in (6, 8)]
    assert len(same) == 3 and len(set(same)) == 1
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert sketch.compare_next(none).count() == 0
    one = sketch.compare_next(docs.where("doc_id = 12")).collect()[0]
    assert one["near_next"] == 1.0 and 0.5 < one["near_edited"] < 1


def test_neighbours_across_many_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = {r["doc_id"]: r for r in sketch.compare_next(df).collect()}
    assert len(rows) == 3000
    for k in (0, 7, 700, 7 * 2999, 7 * 1500):
        n = k // 7
        nxt = f"text {n - 1 if n else 2999}"
        assert rows[k]["edited_sha256"] == hashlib.sha256(sketch.edited(f"text {n}", nxt).encode()).hexdigest()


def test_licences(spark, docs, none):
    rows = [(1, "some words\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "a license plate of a car"), (4, None),
            (5, "All rights reserved.\nThis work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(0))
    model = licenses.learn(df.unionByName(docs.select("doc_id", "text").withColumn("licenses", F.lit(0))))
    got = {r["doc_id"]: [(f["paragraph"], f["family"]) for f in r["licenses"] if f["confirmed"]] for r in licenses.scan(df, model).collect()}
    assert got == {1: [(1, "mit")], 2: [(0, "apache-2.0")], 3: [], 4: [], 5: [(0, "all-rights-reserved"), (1, "gpl")]}
    assert licenses.scan(none, model).count() == 0


def insults(n: int, seed: int):
    rnd = random.Random(seed)
    clean = ["".join(rnd.choice(["ra", "lo", "mi", "te", "son", "dar", "el"]) for _ in range(rnd.randint(2, 4))) for _ in range(400)]
    bad = ["jerkface", "numbskull", "dimwit"]
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(bad) + rnd.choice(["", "s", "ly"])
        yield i, " ".join(words), int(toxic)


def test_toxicity_is_not_fitted_in_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("fitted in the driver")

    rows = [(i, f"quiet words of text number{i % 7}" + (" grobian" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "fit", refuse)
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert model.weights.shape == (toxicity.CODES,) and np.isfinite([model.bias, model.slope, model.middle]).all()


def test_toxicity_on_held_out_texts(spark, docs, none):
    rows = list(insults(900, 3))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels, crc_bucket(F.col("doc_id")) != 0)
    scored = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([scored[i]["predicted"] == y for i, y in held]) >= 0.98
    bent = spark.createDataFrame([(1, "lora j.e.r.k.f.a.c.e mite"), (2, "lora d i m w i t mite"), (3, "lora numbsskull"), (4, "lora mite sondar")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(bent, model).orderBy("doc_id").collect()] == [1, 1, 1, 0]
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.learn(df, labels.limit(0), F.lit(True)) is None
    assert {r["predicted"] for r in toxicity.score(docs, None).collect()} == {0}


def test_licence_notices_across_window_ends():
    model = licenses.fit([[f"word{i * 7 % 900 + j}" for j in range(30)] for i in range(300)])
    assert max(len(licenses.spoken(w)) for t in licenses.TEMPLATES.values() for w in t) <= licenses.PARAGRAPH_WORDS - licenses.STRIDE + 1
    notice, filler = "Licensed under the Apache License, Version 2.0.", [f"stone{i}" for i in range(100)]
    lines = [" ".join([*filler[:at], notice, *filler[at:]]) for at in range(101)]
    found = licenses.findings(model, lines)
    assert [i for i, f in enumerate(found) if [x["family"] for x in f if x["confirmed"]] != ["apache-2.0"]] == []
    twice = licenses.findings(model, ["\n".join([" ".join([notice, *filler, notice]), "x", notice])])[0]
    assert [(f["paragraph"], f["family"]) for f in twice if f["confirmed"]] == [(0, "apache-2.0"), (0, "apache-2.0"), (2, "apache-2.0")]


def test_language_model_probabilities(spark, docs, none):
    rows = gru.score(docs.where("doc_id is not null"), crc_bucket(F.col("doc_id")) == 1).collect()
    texts = [(i, (t or "").encode().translate(LOWER).split() + [b"\n"]) for i, t in odd_texts() if i is not None]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts}
    c = collections.Counter(w for i, ws in texts if not held[i] for w in ws)
    total, distinct = sum(c.values()), len(c)
    want = {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), total, sum(np.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)) for i, ws in texts}
    assert len(rows) == len(texts)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and abs(r["base_score"] - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert np.isfinite(r["score"]) and r["score"] <= 0
    assert gru.score(none, F.lit(False)).count() == 0
    unlearned = gru.score(docs.limit(3), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-9 for r in unlearned)


def test_language_model_learns_from_every_document(spark):
    df = spark.createDataFrame([(i, f"red w{i} green blue") for i in range(300)] + [(None, "no id"), (7, "again"), (7, None)], "doc_id long, text string").repartition(5)
    _, _, voc, model = gru.learn(df.withColumn("held_out", F.lit(False)))
    assert model.trained == voc.total == 300 * 5 + 3 + 2 + 1


def test_topics_come_from_every_document(spark):
    df = spark.createDataFrame([(i, f"the red w{i} w{i}" if i % 2 else f"of w{i} blue w{i}") for i in range(1500)], "doc_id long, text string").repartition(5)
    _, rows, voc, _ = gru.learn(df.withColumn("held_out", F.lit(False)))
    no_topic = 1 + gru.TOP // gru.TOP_CLASS + gru.TOPICS * gru.BINS
    assert len(voc.words) == 1505 and voc.klass.max() < no_topic
    vectors = gru.topic_vectors(rows)
    flat = gru.floats(vectors.toArrow().column("vector"))
    start = gru.centres(flat[:40])
    c = start
    for _ in range(15):
        near = (flat @ c.T).argmax(1)
        c = np.array([v.sum(0) / np.linalg.norm(v.sum(0)) if len(v := flat[near == i]) else c[i] for i in range(len(c))], np.float32)
    assert np.abs(gru.settled(vectors, start) - c).max() < 1e-3


def test_packed_heads_round_trip():
    head = np.array([0, -1, 65533, 65534, 65535, 65536, 131071, 98303, 32767, 5, -1], np.int32)
    start = np.array([0, 0, 3, 8, 11, 11])
    got, of = gru.unpacked(gru.packed(head, start).to_pylist())
    assert got.tolist() == head.tolist() and np.searchsorted(of, np.arange(6)).tolist() == start.tolist()


def test_weights_of_many_shards_are_summed(spark, monkeypatch):
    monkeypatch.setattr(gru, "SUM_FAN", 3)
    each = spark.createDataFrame([(at, shard, shard + 1, [float(at + i) * (shard + 1) for i in range(3)]) for at in (0, 3) for shard in range(20)],
                                 "at long, shard long, n long, w array<double>")
    got = {r["at"]: (r["n"], r["w"]) for r in gru.summed(each, 20).collect()}
    assert got == {at: (210, [210.0 * (at + i) for i in range(3)]) for at in (0, 3)}


def test_tokens_of_a_slice():
    import pyarrow as pa
    texts = pa.array(["Aé b", "c D", None, "e"] * 500)
    which, of, names = gru.tokens(texts.slice(1001, 3))
    assert [names[int(w)].as_py() for w in which] == ["c", "d", "e"] and of.tolist() == [0, 0, 2]


def test_language_model_sums_to_one_and_learns():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(1500)] + [gru.END]
    counts = np.append(rng.integers(5, 200, 1500), 400).astype(float)
    order = np.lexsort((np.arange(len(words)), -counts))
    voc = gru.Vocabulary([words[i] for i in order], counts[order], int(counts.sum()) + 300, len(words) + 250)
    by_topic = np.zeros((len(words), gru.TOPICS))
    by_topic[np.arange(len(words)), np.arange(len(words)) % gru.TOPICS] = voc.counts
    gru.classify(voc, by_topic)
    model = gru.Gru(voc)
    model.p["wc"] = rng.normal(0, 0.3, model.p["wc"].shape).astype(np.float32)
    model.p["v"] = rng.normal(0, 0.3, model.p["v"].shape).astype(np.float32)
    state = np.repeat(rng.normal(0, 1, (1, gru.HIDDEN)), len(words) + 1, 0).astype(np.float32)
    head = np.append(np.arange(len(words)), -1).astype(np.int32)
    klass, place = gru.classes_of(voc, head)
    log_p, _ = model.output(state, klass, place)
    fixed = np.where((head >= 0) & (place < 0), np.log(voc.counts[head] + 0.5) - np.log(model.size[klass]), 0)
    assert abs(np.exp(log_p + fixed).sum() - 1) < 1e-4  # the last row is all rare and unknown words together
    text = (np.arange(600) % 7).astype(np.int64)
    klass, place = gru.classes_of(voc, text.astype(np.int32))
    sample = [(np.concatenate([[6], text[:-1]]), klass, place)] * 60
    before = gru.log_likelihoods(voc, gru.Gru(voc), text.astype(np.int32), np.array([0, 600]))[0]
    learner = gru.Gru(voc)
    for _ in range(6):
        gru.train_shard(voc, learner, sample)
    assert gru.log_likelihoods(voc, learner, text.astype(np.int32), np.array([0, 600]))[0] > 0.8 * before
