"""Scores: lexical pair similarity, forgetting, recall, confidence; claim strength and polarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .embed import ROWS, hash_vectors

TAU_DAYS = 30.0
RRF_K = 60
HELD = 8_192  # texts that a task remembers while it scores pairs


def _share(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def overlap(ta: Column, tb: Column, ga: Column, gb: Column) -> Column:
    """The best of word Jaccard, trigram Dice and 0.75 x containment of the shorter side; the
    arguments are arrays of distinct words and distinct trigrams."""
    both = F.size(F.array_intersect(ta, tb))
    na, nb = F.size(ta), F.size(tb)
    jac = F.when((na > 0) & (nb > 0), _share(both, na + nb - both)).otherwise(0.0)
    dice = _share(2 * F.size(F.array_intersect(ga, gb)), F.size(ga) + F.size(gb))
    return F.greatest(jac, dice, 0.75 * _share(both, F.least(na, nb)))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0))


def lexical(ta: Column, tb: Column, ga: Column, gb: Column, cos: Column) -> Column:
    return 0.7 * overlap(ta, tb, ga, gb) + 0.3 * cos


def _overlap(a: tuple, b: tuple) -> float:
    """``overlap`` of two texts' words and trigrams, which are None for no text."""
    (ta, ga), (tb, gb) = a, b
    if ta is None or tb is None:
        return 0.0
    both, na, nb = len(ta & tb), len(ta), len(tb)
    words = max(both / (na + nb - both), 0.75 * (both / min(na, nb))) if na and nb else 0.0
    return max(words, 2 * len(ga & gb) / (len(ga) + len(gb)))


def lexical_of_texts(dim: int) -> Callable[[Column, Column], Column]:
    """``lexical`` of two texts by their words, trigrams and ``hash_embedder`` vectors. All of these stay in the task, which
    reads each different text once while it remembers it: ``HELD`` texts at most, besides those of the rows at hand. Columns
    would carry long lists through every shuffle, and lambdas over them take several times as long."""
    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, float]] = {}
        held: dict[str | None, tuple] = {}
        for a, b in batches:
            left, right = a.to_pylist(), b.to_pylist()
            out = np.empty(len(left))
            for lo in range(0, len(left), ROWS):
                pairs = list(zip(left[lo:lo + ROWS], right[lo:lo + ROWS]))
                texts = list(dict.fromkeys(t for pair in pairs for t in pair))
                if len(held) + len(texts) > HELD:
                    held.clear()
                new = [t for t in texts if t not in held]
                if new:
                    normed = [tx.norm_like(t or "") for t in new]
                    for t, n, v in zip(new, normed, hash_vectors(normed, known, dim)):
                        held[t] = (None, None) if t is None else tx.lex_sets(n), v
                x, y = (np.stack([held[pair[side]][1] for pair in pairs]).astype(np.float64) for side in (0, 1))
                cos = np.clip(np.einsum("ij,ij->i", x, y), 0.0, 1.0)
                out[lo:lo + ROWS] = 0.7 * np.array([_overlap(held[p][0], held[q][0]) for p, q in pairs]) + 0.3 * cos
            yield pa.array(out)

    return score.asNondeterministic()


def sides(normed: Column) -> tuple[Column, Column]:
    return F.array_distinct(tx.lex_tokens(normed)), F.array_distinct(tx.char_ngrams(normed))


def rrf(rank: Column) -> Column:
    return 1.0 / (RRF_K + rank)


def forgetting(last_seen: Column, created: Column, now: Column) -> Column:
    """0 right after a look, near 1 after months; never opened counts from its creation."""
    last = F.coalesce(last_seen, created, now)
    days = F.greatest((now.cast("double") - last.cast("double")) / 86400.0, F.lit(0.0))
    return 1 - F.exp(-days / TAU_DAYS)


def recall_score(rel: Column, forget: Column, origin: Column) -> Column:
    return rel * (0.5 + 0.5 * forget) * F.when(origin == "user", 2.0).otherwise(1.0)


def clamp_confidence(c: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(0.0)))), 3)


def strength(evidence_type: Column, logic_jump: Column) -> Column:
    return (F.when(logic_jump | (evidence_type == "speculative"), "weak").when(evidence_type == "causal", "strong")
            .otherwise("medium"))


# Negation words, words that only look negative, opposite directions.
NEGATIONS = ("not", "no", "never", "none", "cannot", "without", "fails", "fail", "neither", "nor")
HAN_NEGATIONS = "并非|并不|并未|没有|不是|不能|不会|不再|未能|未曾|无法|从未|从不|毫无|不|没|未|无|非|勿"
HAN_NOT_NEGATIONS = ("不同", "不仅", "不断", "不久", "不少", "不同于", "不论", "不管", "无论", "无监督", "无标记", "无偏", "非常",
                     "非编码", "非线性", "非参数", "非模式", "非洲", "未来", "无线", "不对称")
ANTONYMS = (("increase", "decrease"), ("increases", "decreases"), ("increased", "decreased"), ("higher", "lower"),
            ("up-regulates", "down-regulates"), ("upregulates", "downregulates"), ("upregulated", "downregulated"),
            ("activates", "represses"), ("activates", "inhibits"), ("promotes", "inhibits"), ("promotes", "suppresses"),
            ("enhances", "reduces"), ("precede", "follow"), ("precedes", "follows"), ("before", "after"),
            ("positive", "negative"), ("gain", "loss"), ("more", "less"), ("增加", "减少"), ("升高", "降低"), ("上调", "下调"),
            ("促进", "抑制"), ("激活", "抑制"), ("先于", "晚于"), ("早于", "晚于"), ("高于", "低于"), ("正相关", "负相关"), ("增强", "减弱"))


def negated(c: Column) -> Column:
    """An odd number of negations. Words are read from the normal form, Han words from the raw text."""
    words = tx.tokens(tx.norm(F.replace(c, F.lit("n't"), F.lit(" not"))))
    en = F.size(F.filter(words, lambda w: w.isin(*NEGATIONS)))
    han = F.regexp_count(F.regexp_replace(c, "|".join(HAN_NOT_NEGATIONS), " "), F.lit(HAN_NEGATIONS))
    return (en + han) % 2 == 1


def directions(c: Column) -> Column:
    """Which direction words a text uses: Latin ones as words, Han ones anywhere."""
    names = list(dict.fromkeys(w for pair in ANTONYMS for w in pair))
    latin = F.array(*[F.lit(w) for w in names if w.isascii()])
    han = F.array(*[F.lit(w) for w in names if not w.isascii()])
    return F.concat(F.array_intersect(tx.tokens(tx.norm(c)), latin), F.filter(han, lambda w: F.contains(c, w)))


def opposite(neg_a: Column, dir_a: Column, neg_b: Column, dir_b: Column) -> Column:
    """Negation differs, or one side uses a direction word whose antonym only the other uses."""
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ANTONYMS])

    def crossed(p: Column) -> Column:
        ax, ay = F.array_contains(dir_a, p["x"]), F.array_contains(dir_a, p["y"])
        bx, by = F.array_contains(dir_b, p["x"]), F.array_contains(dir_b, p["y"])
        return (ax & ~ay & by & ~bx) | (ay & ~ax & bx & ~by)

    return (neg_a != neg_b) | F.exists(pairs, crossed)
