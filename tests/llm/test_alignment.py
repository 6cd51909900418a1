"""Alignment against brute force over all texts with the libraries, in one chunk and in many."""

import collections
import hashlib
import random

import numpy as np
import pytest

from litgraph.llm import alignment
from litgraph.llm.bpe import byte_alphabet
from litgraph.llm.common import byte_pattern, local_tokenizer

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


def texts():
    rnd = random.Random(3)
    words = "The the and tokenization of naïve façade Bäume 中文字 \U0001f642 x9 3.14 don't <|endoftext|> </s> aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa \t\t \n é".split(" ")
    rows = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "x"), (6, "the same text"), (6, "the same text"), (None, "no id, the same"), (7, "a" * 3000 + " " + "ab" * 900),
            (8, "\x00\x01 \r\n\x7f"), (9, "  two  spaces "), (10, "é" * 50 + "中" * 300)]
    return rows + [(20 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120)))) for i in range(120)]


def brute(rows):
    a = tokenizers.Tokenizer.from_file(local_tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    own = {c: b for b, c in enumerate(byte_alphabet())}
    b = sentencepiece.SentencePieceProcessor(model_file=local_tokenizer("piece_bpe_32k.model"))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    made = []
    for key, text in rows:
        want = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        ba, bb = [bytes(own[c] for c in a.id_to_token(i)) for i in ia], [b_bytes(i) for i in ib]
        groups = []
        if text and b"".join(ba) == want == b"".join(bb):
            ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
            at = 0
            for end in sorted(set(ea) & set(eb)):
                groups.append(([i for i, e in zip(ia, ea) if at < e <= end], [i for i, e in zip(ib, eb) if at < e <= end]))
                at = end
        links = collections.Counter((x, y) for p, q in groups for x in p for y in q)
        made.append((key, groups, links))
    held = collections.Counter(pair for _, _, links in made for pair in links)
    high = collections.defaultdict(int)
    for (x, _), n in held.items():
        high[x] = max(high[x], n)
    for key, groups, links in made:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield (key, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()), said,
               sum(n for pair, n in links.items() if held[pair] == high[pair[0]]), sum(n * held[pair] for pair, n in links.items())), links


@pytest.mark.parametrize("many", [False, True])
def test_alignment_is_brute_force(spark, monkeypatch, many):
    if many:  # small chunks, encoded text by text, links in small steps
        for name, value in (("CHUNK_CHARS", 3000), ("CHUNK_DOCS", 9), ("PIECE_CHARS", 300), ("LINKS", 64), ("WIDE_GROUP", 6)):
            monkeypatch.setattr(alignment, name, value)
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, chunk string, pair int").repartition(2)
    paths = (local_tokenizer("byte_bpe_50k.tiktoken"), byte_pattern(), local_tokenizer("piece_bpe_32k.model"))
    found = alignment.align(df, *paths)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    want = list(brute(rows))
    got = [tuple(r[n] for n in names) for r in alignment.scores(found).collect()]
    assert sorted(got, key=repr) == sorted((w for w, _ in want), key=repr)
    held, linked = collections.Counter(p for _, links in want for p in links), sum((links for _, links in want), collections.Counter())
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in found.pairs.collect()} == {p: (n, linked[p]) for p, n in held.items()}
    digest = alignment.align(df.where("doc_id = 6 or doc_id = 2"), *paths, digest=True).docs.collect()
    six = next(w[5] for w, _ in want if w[0] == 6)
    assert sorted(r["groups"] for r in digest) == sorted([hashlib.sha256(six.encode()).hexdigest()] * 2 + [""])
    assert alignment.scores(alignment.align(df.limit(0), *paths)).count() == 0


def test_bitmaps_of_both_kinds_round_trip():
    rng = np.random.default_rng(2)
    sets = [np.flatnonzero(rng.random(1000) < p) for p in (0.001, 0.01, 0.2, 0.9, 1.0)]
    sets = [s for s in sets if len(s)]
    pair = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    got, n, held = alignment.bitmaps(pair, np.concatenate(sets), 1000)
    assert max(len(h) for h in held.to_pylist()) <= 125
    row, doc = alignment.unpacked(n, held.to_pylist())
    assert [sorted(doc[row == i].tolist()) for i in range(len(sets))] == [s.tolist() for s in sets] and got.tolist() == list(range(len(sets)))
