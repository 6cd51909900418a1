"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

A sentence is the set of its words: lower case, without symbols between letters, common digits read as letters, and
letters spelled one by one joined. Words are compared by a gap-weighted subsequence kernel: four characters in order
within six places, the word's start and end counting as characters, weighed by ``DECAY`` for each place skipped, normalised. An insult with a character put in, left
out or repeated, and the many forms of one stem, keep most of their subsequences.

The kernel is approximated on landmark words, ``z(x) = K(L, L)^-1/2 K(L, x)``. A linear machine on ``z`` is then one
weight for each subsequence, ``u = sum_l phi(l) (K(L, L)^-1/2 w)_l``, so that a word is scored by summing the weights
of its own subsequences. A text's score is its worst sentence's, a sentence's its worst word's, mapped to 0..1 by a
logistic curve fitted to the training texts.

Labels belong to texts, and a toxic one has clean sentences too. Training is by multiple instances: a clean text's
words are all clean; of a toxic text the word that scores worst stands for it, chosen anew after each fit. The first
choice goes by how much more often texts with a word's subsequences are toxic. A word of many toxic texts that are no
copies, and of no clean one, stands for toxic too.

The classifier is fitted on a bounded sample of labelled texts: ``MAX_TOXIC`` and ``MAX_CLEAN`` of each label, those of
least hash, and of the words that only their clean ones have on ``MAX_CLEAN_WORDS``. Scores cover every text whole, in the scan's own stage.

Cases: null and empty texts, and a table without both labels, score ``EMPTY_SCORE``, which is below one half. Null
labels are not used; several labels of a text count as toxic if one is. Repeated rows are scored each. Other columns
pass through; columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, slices

MAX_TOXIC, MAX_CLEAN, MAX_CLEAN_WORDS = 1200, 2400, 30_000
LANDMARKS = 320
DECAY = 0.5
GAPS = tuple((i, j, k) for k in range(3, 6) for j in range(2, k) for i in range(1, j))
CODES = 1 << 20
BENT = 3  # copies of a training insult with a letter put in
LONGEST = 64  # letters of a word seen at once; longer ones are seen in overlapping stretches
EMPTY_SCORE = 0.01
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"} | {c: None for c in "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~"})
SPELLED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")


def plain(text: str | None) -> str:
    """A text as the words that are compared: lower case, no symbols, spelled-out words joined."""
    return joined(text).lower().translate(LETTERS)


def joined(text: str | None) -> str:
    return SPELLED.sub(lambda m: m[0].replace(" ", ""), text or "")


def letters(words: list[str]) -> np.ndarray:
    """Character classes 1..63 of each word between a start and an end mark, 0 after it; words longer than LONGEST
    must be cut before."""
    width = max([4, *(len(w) + 2 for w in words)])
    flat = np.frombuffer("".join([f"\1{w}\2".ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width)
    latin = (flat >= 97) & (flat <= 122)
    other = 27 + (flat * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(35)
    return np.where(flat < 3, np.array([0, 62, 63], np.uint32)[np.minimum(flat, 2)], np.where(latin, flat - 96, other)).astype(np.uint32)


def subsequences(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed codes (-1 where a word has ended) and weights of the subsequences of each row."""
    codes, weights = [], []
    n, width = chars.shape
    for i, j, k in GAPS:
        if k >= width:
            continue
        m = width - k
        a, b, c, d = chars[:, :m], chars[:, i:m + i], chars[:, j:m + j], chars[:, k:]
        code = (((a << np.uint32(18)) | (b << np.uint32(12)) | (c << np.uint32(6)) | d) * np.uint32(2654435761)) >> np.uint32(12)
        codes.append(np.where(d > 0, code.astype(np.int32), -1))
        weights.append(np.full(m, DECAY ** (k - 3)))
    return np.concatenate(codes, 1), np.concatenate(weights)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised kernel features: (word, code, value) entries and the norms before."""
    codes, weights = subsequences(letters(words))
    row, at = np.nonzero(codes >= 0)
    key = row.astype(np.int64) * CODES + codes[row, at]
    key, inverse = np.unique(key, return_inverse=True)
    value = np.bincount(inverse, weights[at], len(key))
    word, code = key // CODES, key % CODES
    norm = np.sqrt(np.bincount(word, value * value, len(words)))
    return word, code, value / norm[word], norm


@dataclass
class Model:
    weights: np.ndarray  # one for each subsequence code
    bias: float
    slope: float
    middle: float

    def decisions(self, words: list[str]) -> np.ndarray:
        """Signed distance of each word: the kernel part normalised by the word's own norm."""
        out = np.full(len(words), -np.inf)
        for begin in range(0, len(words), 20_000):
            part = words[begin:begin + 20_000]
            codes, weights = subsequences(letters(part))
            raw = np.where(codes >= 0, self.weights[codes] * weights.astype(np.float32), np.float32(0)).sum(1)
            hot = np.flatnonzero(raw > 0)
            got = np.full(len(part), self.bias)
            if len(hot):
                norm = features([part[i] for i in hot.tolist()])[3]
                got[hot] += raw[hot] / np.maximum(norm, 1e-9)
            out[begin:begin + len(part)] = got
        return out

    def scores(self, worst: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            s = 1 / (1 + np.exp(-self.slope * (worst - self.middle)))
        return np.where(np.isfinite(worst), np.clip(s, EMPTY_SCORE, 1.0), EMPTY_SCORE)


def split_long(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words of at most LONGEST letters, long ones as overlapping stretches, and which word each comes from."""
    out, of = [], []
    for i, w in enumerate(words):
        for at in range(0, max(1, len(w) - 8), LONGEST - 8) if len(w) > LONGEST else (0,):
            out.append(w[at:at + LONGEST])
            of.append(i)
    return out, np.array(of, np.int64)


def worst_words(model: Model, texts: list[str | None]) -> np.ndarray:
    """Largest decision over the words of each text; -inf without a word of three letters."""
    runs = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([joined(t) for t in texts], pa.large_string())))
    coded = runs.flatten().dictionary_encode()
    words = [w.translate(LETTERS) for w in coded.dictionary.to_pylist()]
    score = np.full(len(words), -np.inf)
    at = np.array([i for i, w in enumerate(words) if len(w) >= 3], np.int64)
    if len(at):
        parts, of = split_long([words[i] for i in at.tolist()])
        best = np.full(len(at), -np.inf)
        order = np.argsort([len(p) for p in parts], kind="stable")  # words of like length side by side
        np.maximum.at(best, of[order], model.decisions([parts[i] for i in order.tolist()]))
        score[at] = best
    offsets = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    every = np.append(score[coded.indices.to_numpy(zero_copy_only=False)], -np.inf)
    out = np.maximum.reduceat(every, offsets[:-1]) if len(texts) else np.empty(0)
    return np.where(offsets[1:] > offsets[:-1], out, -np.inf)


def uncopied(bags: list[np.ndarray], bands: int = 6, rows: int = 5) -> np.ndarray:
    """Which bags share no band of minima with an earlier one."""
    seen: set[tuple] = set()
    keep = np.zeros(len(bags), bool)
    salt = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i, bag in enumerate(bags):
        if len(bag):
            least = mix64(bag.astype(np.uint64)[:, None] ^ salt).min(0).reshape(bands, rows).tolist()
            keys = {(k, *least[k]) for k in range(bands)}
            keep[i] = seen.isdisjoint(keys)
            seen |= keys
    return keep


def bend(word: str, rng: np.random.Generator) -> str:
    """The word with one letter put in between two others."""
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + chr(97 + int(rng.integers(26))) + word[at:]


def machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton's method on the active rows."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w, ridge = np.zeros(x.shape[1]), reg * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-8
    last = None
    for _ in range(steps):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if last is not None and (active == last).all():
            break
        last = active
    return w[:-1], float(w[-1])


def thinned(bags: list[np.ndarray], toxic: np.ndarray, words: list[str], rng: np.random.Generator) -> tuple[list[np.ndarray], list[str]]:
    """The bags without all but MAX_CLEAN_WORDS of the words that only clean texts have."""
    only = np.ones(len(words), bool)
    for bag, y in zip(bags, toxic, strict=True):
        if y == 1:
            only[bag] = False
    spare = rng.permutation(np.flatnonzero(only))[MAX_CLEAN_WORDS:]
    keep = np.ones(len(words), bool)
    keep[spare] = False
    number = np.cumsum(keep) - 1
    return [number[b[keep[b]]] for b in bags], [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def fit(bags: list[np.ndarray], toxic: np.ndarray, words: list[str], landmarks: int = LANDMARKS, rounds: int = 5, seed: int = 5) -> Model:
    """bags: the word numbers of each text."""
    rng = np.random.default_rng(seed)
    bags, words = thinned(bags, toxic, words, rng)
    blocks = [features(words[a:a + 3_000]) for a in range(0, len(words), 3_000)]
    word = np.concatenate([b[0].astype(np.int32) + 3_000 * i for i, b in enumerate(blocks)])
    code, value = np.concatenate([b[1].astype(np.int32) for b in blocks]), np.concatenate([b[2].astype(np.float32) for b in blocks])
    del blocks
    sizes = [len(b) for b in bags]
    bag, item = np.repeat(np.arange(len(bags)), sizes), np.concatenate(bags)
    df = np.stack([np.bincount(item[np.repeat(toxic == t, sizes)], minlength=len(words)) for t in (0, 1)]).astype(float)
    n_clean, n_toxic = max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())

    # subsequences: in how many clean and toxic texts, counted through the words that have them
    sub = [np.bincount(code, df[t][word], CODES) for t in (0, 1)]
    odds = np.log((sub[1] + 0.3) / n_toxic) - np.log((sub[0] + 0.3) / n_clean)
    own = np.bincount(word, odds[code] * value * value, len(words)) + np.log((df[1] + 0.3) / n_toxic) - np.log((df[0] + 0.3) / n_clean)
    own += 0.1 * np.minimum(df[1], 20)

    # texts with each word, copies of a toxic text counted once; so many that they would hardly be toxic ones by chance
    apart = np.bincount(np.concatenate([np.empty(0, np.int64), *(bags[i] for i in np.flatnonzero(toxic == 1)[uncopied([bags[i] for i in np.flatnonzero(toxic == 1)])])]),
                        minlength=len(words))
    sure = np.ceil(np.log(1e-7) / np.log(n_toxic / (n_toxic + n_clean)))

    def witness(score: np.ndarray) -> np.ndarray:
        """The worst word of each toxic text."""
        order = np.lexsort((-score[item], bag))
        firsts = order[np.concatenate([[True], bag[order][1:] != bag[order][:-1]])]
        return item[firsts][toxic[bag[firsts]] == 1]

    score = own
    # words of clean texts, but for those that toxic texts have much more often
    suspect = (df[1] >= 4) & ((df[1] + 0.5) * n_clean > 4 * (df[0] + 0.5) * n_toxic)
    clean = np.flatnonzero((df[0] > 0) & ~suspect)
    model = Model(np.zeros(CODES, np.float32), -1.0, 1.0, 0.0)
    hard = clean[np.argsort(-own[clean])[:4000]]
    for _ in range(rounds):
        times = np.bincount(witness(score), minlength=len(words))
        times = np.where((df[0] > 0) & ~suspect, 0, np.where((df[0] == 0) & (apart >= sure), np.maximum(times, apart), times))
        chosen = np.flatnonzero(times)
        times = times[chosen]
        if not len(chosen) or not len(clean):
            break
        negative = np.unique(np.concatenate([rng.choice(clean, min(len(clean), 4000), replace=False), hard]))
        rows = np.concatenate([chosen, negative])
        y = np.concatenate([np.ones(len(chosen)), -np.ones(len(negative))])
        top = chosen[np.argsort(-times, kind="stable")]
        marks = np.concatenate([top[:landmarks // 4], rng.permutation(top[landmarks // 4:])[:landmarks // 4], rng.permutation(hard)[:landmarks // 4], rng.permutation(negative)[:landmarks // 4]])
        marks = np.unique(marks)

        bent = [bend(words[i], rng) for i in chosen.tolist() for _ in range(BENT)]
        marked = features([words[i] for i in marks.tolist()])
        codes = np.unique(marked[1])
        column, n_codes = np.full(CODES, -1), len(codes)
        column[codes] = np.arange(n_codes)

        phi = np.zeros((n_codes, len(marks)), np.float32)
        phi[column[marked[1]], marked[0]] = marked[2]

        def kernel(which: list[str]) -> np.ndarray:
            """Kernel of words with the landmarks, a block of words at a time."""
            out = np.zeros((len(which), len(marks)), np.float32)
            for begin in range(0, len(which), 500):
                of, c, v, _ = features(which[begin:begin + 500])
                of, c, v = (x[column[c] >= 0] for x in (of, c, v))
                if len(of):
                    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                    out[begin + of[first]] = np.add.reduceat(phi[column[c]] * v[:, None].astype(np.float32), first)
            return out

        gram = (phi.T @ phi).astype(np.float64)
        val, vec = np.linalg.eigh(gram)
        good = val > 1e-6 * val.max()
        root = vec[:, good] / np.sqrt(val[good])
        z = kernel([words[i] for i in rows.tolist()] + bent) @ root
        share = np.sqrt(times) / np.sqrt(times).sum()
        weight = np.concatenate([share, np.full(len(negative), 1 / len(negative)), np.repeat(share, BENT) / (2 * BENT)])
        y = np.concatenate([y, np.ones(len(bent))])
        w, bias = machine(z, y, weight * 2000, 1.0)
        u = np.zeros(CODES, np.float32)
        u[codes] = phi @ (root @ w)
        model = Model(u, bias, 1.0, 0.0)
        score = np.bincount(word, u[code] * value, len(words)) + bias
        hard = clean[np.argsort(-score[clean])[:4000]]

    best = np.full(len(bags), -np.inf)
    np.maximum.at(best, bag, score[item])
    model.slope, model.middle = logistic(best, toxic)
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve by Newton's method, with a weak pull to a slope of 4."""
    ok = np.isfinite(x)
    x, y = x[ok], y[ok].astype(float)
    a, b = 4.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.05 * (a - 4.0), (p - y).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 0.05, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step = np.clip(step, -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a, -b / a) if a > 0.1 else (4.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | None:
    """A model from the labelled texts for which ``train`` (on the id) holds; None without both labels."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & train).groupBy(doc_id).agg(F.max(label).alias("_y"))
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(most) for y, most in ((1, max_toxic), (0, max_clean))]
    chosen = picked[0].unionByName(picked[1])  # max_toxic + max_clean rows at most, so they may be sent around

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                bags = [sorted({p for p in split_long([w for w in set(plain(t).split()) if len(w) >= 3])[0]}) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("_y").cast(pa.int32()), pa.array(bags, pa.list_(pa.string()))], ["y", "words"])

    sample = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select("_y", text).mapInArrow(run, "y int, words array<string>")
    # fitted in one task, not in the driver; in the order of the sample, as which words are drawn depends on it
    row = (sample.withColumn("at", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("at").select("y", "words")
           .mapInArrow(fitted, "weights binary, bias double, slope double, middle double").first())
    return None if row is None else Model(np.frombuffer(row["weights"], np.float32), row["bias"], row["slope"], row["middle"])


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a whole sample (y, words) as one row; no row without both labels."""
    sample = [b for b in batches if len(b)]
    if not sample:
        return
    sample = pa.Table.from_batches(sample)
    toxic, lists = np.array(sample.column("y").to_pylist()), sample.column("words").combine_chunks()
    if len(set(toxic.tolist())) < 2:
        return
    del sample
    coded = lists.flatten().dictionary_encode()
    if len(coded) == 0:
        return
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    bags = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:-1])
    model = fit(bags, toxic, coded.dictionary.to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (model.bias, model.slope, model.middle))],
                                     ["weights", "bias", "slope", "middle"])


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from a score of one half on)."""
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                s = model.scores(worst_words(model, texts)) if model is not None else np.full(len(texts), EMPTY_SCORE)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                                 [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
