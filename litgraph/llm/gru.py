"""A gated recurrent language model that scores whole documents.

Counts. Words of all training documents are counted in one shuffle. The ``HEAD`` most frequent ones form the model's
vocabulary, whose size is bounded; of the rest, a document's words meet their counts in a join, so that no table of
all words is ever in one place. A second scan writes each document as its words' numbers, two bytes for most of them;
topics, training and scoring read that table and no text.

Model. A recurrent state of ``HIDDEN`` numbers is updated by each word (the ``INPUTS`` most frequent have weights of
their own, others share their class's) and predicts the next one by a class-factored softmax: the class from the
state, then the word in its class, for the ``TOP`` most frequent words also from the state, for others by their counts.
Classes are groups of like frequency that occur in like documents. Rare and unknown words are one class that spreads
its mass by (c + 0.5), unknown ones together having c = 0, so all words' probabilities sum to 1 and the untrained
model is the base model.

Training. Topic centres are fitted on the vectors of all training documents, by rounds of distributed k-means from a
start on ``TOPIC_DOCS`` of them, and the words of all are counted by topic; a word seen once has no topic, as it would
be known in its own document only. All training documents are dealt, by hash, to ``ROUNDS`` rounds and in each to shards of about ``SHARD_DOCS`` documents, so that every one is learned from
once. Each shard runs truncated backpropagation through ``WINDOW`` words in numpy, the state carried on; the shards'
weights are averaged by Spark after each round. What is counted and trained on grows with the input.

Scoring. The documents of a batch advance side by side, longest first, the state carried across windows to each
document's end: scores are of complete documents.

Cases: null and empty texts have the end token only. Very long texts are scored whole. Repeated rows are counted and
scored each (row order does not matter). A null id is in the training part. Without training words the model has the
unknown class alone and every score is 0. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, slices, written

HEAD = 1 << 17
INPUTS = 2048
TOP, TOP_CLASS = 1024, 32
HIDDEN = 16
TOPICS, TOPIC_WORDS, TOPIC_DOCS = 6, 64, 4000
BINS = 4
SHARD_DOCS, ROUNDS, WINDOW, LANES = 2500, 2, 20, 256
SUM_FAN = 500  # shards whose weights one task adds up
TAIL, WIDE = 65534, 65535  # codes of a word outside the head, and before the two halves of a greater head number
STRETCH = 400
RATE, WARM_STEPS = 0.15, 40  # the rate grows over the first steps, so that a few of them move little
END = "\n"  # no word has white space


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word number, text number) of each word, and the distinct words; A-Z in lower case."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a slice of an array as one of its own, as the casts need it
    runs = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    coded = runs.flatten().dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(runs.offsets.to_numpy()))
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        real = which != blank
        which, of = which[real], of[real]
    return which, of, coded.dictionary


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, an end token for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in slices(batch, text, 5_000_000):
                which, _, names = tokens(part.column(text))
                n = np.bincount(which, minlength=len(names))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.take(pa.array(some)).cast(pa.string()), pa.array([END])]),
                                                  pa.array(np.append(n[some], len(part)).astype(np.int64))], ["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head words with their counts, most frequent first, and how they are spread over classes."""
    words: list[str]
    counts: np.ndarray
    total: int
    distinct: int
    klass: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # in its class, -1 where counts decide
    n_classes: int = 0

    @property
    def mass(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def tail_mass(self) -> float:
        return self.mass - float((self.counts + 0.5).sum())

    @property
    def end(self) -> int:
        """Head number of the end token, -1 if nothing was learned."""
        if not hasattr(self, "_end"):
            self._end = self.words.index(END) if END in self.words else -1
        return self._end

    def lookup(self, names: pa.Array) -> np.ndarray:
        """Head number of each word, -1 outside."""
        if not hasattr(self, "_table"):
            self._table = pa.array(self.words, pa.large_string())
        return pc.fill_null(pc.index_in(names.cast(pa.large_string()), self._table), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words whose number stays within HEAD, all words of one count or none (the end token always)."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    steps = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()
    least, held = 1 << 62, 0
    for r in steps:
        if held + r["k"] > HEAD:
            break
        held, least = held + r["k"], r["n"]
    head = counts.where((F.col("n") >= least) | (F.col("word") == END)).toArrow()
    words, n = head.column("word").to_pylist(), head.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return Vocabulary([words[i] for i in order], n[order].astype(np.float64), total, distinct)


def packed(head: np.ndarray, start: np.ndarray) -> pa.Array:
    """Head numbers of each text (``start`` has n + 1 places) as bytes: 16 bits a word, or three times 16."""
    wide = head >= TAIL
    at = np.concatenate([[0], np.cumsum(1 + 2 * wide.astype(np.int64))])
    out = np.empty(at[-1], "<u2")
    out[at[:-1]] = np.where(wide, WIDE, np.where(head < 0, TAIL, head))
    out[at[:-1][wide] + 1], out[at[:-1][wide] + 2] = head[wide] & 0x7FFF, head[wide] >> 15
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer((2 * at[start]).astype(np.int32)), pa.py_buffer(out)])


def unpacked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(head number, text number) of each word of packed texts."""
    code = np.frombuffer(b"".join(texts), "<u2").astype(np.int32)
    own = np.ones(len(code), bool)
    wide = np.flatnonzero(code == WIDE)
    own[wide + 1] = own[wide + 2] = False
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) // 2 for t in texts])[own]
    code[wide] = code[wide + 1] | code[wide + 2] << 15
    head = code[own]
    head[head == TAIL] = -1
    if len(wide):  # a head number may be the code itself
        real = np.zeros(len(code), bool)
        real[wide[code[wide] == TAIL]] = True
        head[real[own]] = TAIL
    return head, of


CODED = "doc_id long, held_out boolean, heads binary, tail array<struct<word: string, n: int>>"


def coded(docs: DataFrame, voc, text: str = "text") -> DataFrame:
    """(doc_id, held_out, heads, tail) of each document: its words' head numbers in order, packed, and its words
    outside the head with their numbers. ``voc`` is a broadcast variable."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in slices(batch, text, 5_000_000):
                n = len(part)
                which, of, names = tokens(part.column(text))
                head_of = voc.value.lookup(names)
                head = head_of[which]
                rare = np.flatnonzero(head < 0)
                pair, times = np.unique(of[rare].astype(np.int64) * max(1, len(names)) + which[rare], return_counts=True)
                owner = pair // max(1, len(names))
                tail = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()),
                    pa.StructArray.from_arrays([names.take(pa.array(pair % max(1, len(names)))).cast(pa.string()), pa.array(times, pa.int32())], ["word", "n"]))
                start = np.searchsorted(of, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), packed(head, start), tail], ["doc_id", "held_out", "heads", "tail"])

    return docs.select("doc_id", "held_out", text).mapInArrow(run, CODED)


def topic_vectors(docs: DataFrame) -> DataFrame:
    """(h, vector) of each coded document: a hash, and shares of its most frequent vocabulary words as 32-bit floats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, heads in slices(batch.select(["h", "heads"]), "heads", 4_000_000):
                flat = shares(*unpacked(heads), len(part)).astype("<f4").tobytes()
                size = 4 * TOPIC_WORDS
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(
                    np.arange(0, size * (len(part) + 1), size, dtype=np.int32)), pa.py_buffer(flat)])], ["h", "vector"])

    return docs.select(F.xxhash64("doc_id", "heads", F.lit(29)).alias("h"), "heads").mapInArrow(run, "h long, vector binary")


def shares(head: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Length-1 vectors of the frequent words of each text, square roots of their shares."""
    some = (head >= 0) & (head < TOPIC_WORDS)
    out = np.bincount(of[some] * np.int64(TOPIC_WORDS) + head[some], minlength=n * TOPIC_WORDS).reshape(n, TOPIC_WORDS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


def centres(vectors: np.ndarray, k: int = TOPICS, seed: int = 3) -> np.ndarray:
    """Spherical k-means, the first centres drawn among texts far from those drawn before."""
    rng = np.random.default_rng(seed)
    vectors = vectors[vectors.any(1)]
    if not len(vectors):
        return np.zeros((k, TOPIC_WORDS), np.float32)
    found = [vectors[rng.integers(len(vectors))]]
    while len(found) < k:
        far = np.maximum(1 - (vectors @ np.array(found).T).max(1), 1e-9) ** 2
        found.append(vectors[rng.choice(len(vectors), p=far / far.sum())])
    c = np.array(found)
    for _ in range(15):
        near = (vectors @ c.T).argmax(1)
        c = np.array([v.sum(0) / max(1e-9, np.linalg.norm(v.sum(0))) if len(v := vectors[near == i]) else c[i] for i in range(k)], np.float32)
    return c


def floats(vectors: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<f4").reshape(-1, TOPIC_WORDS)


def settled(vectors: DataFrame, c: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Centres after rounds of k-means over all vectors. Sums are of whole numbers, so that their order does not matter."""
    def run(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(c.shape, np.int64)
        for batch in batches:
            v = floats(batch.column("vector"))
            v = v[v.any(1)]
            near, whole = (v @ c.T).argmax(1), np.round(v * (1 << 20)).astype(np.int64)
            for i in range(len(c)):
                sums[i] += whole[near == i].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "n"])

    for _ in range(rounds):
        got = vectors.select("vector").mapInArrow(lambda b, c=c: run(b, c), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros(c.size)
        sums[got.column("at").to_numpy()] = got.column("n").to_numpy()
        sums = sums.reshape(c.shape)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(size > 0, sums / np.maximum(size, 1e-9), c).astype(np.float32)
        if np.array_equal(new, c):
            break
        c = new
    return c


def word_topics(docs: DataFrame, n_words: int, c: np.ndarray) -> np.ndarray:
    """Occurrences of each head word in the coded documents of each topic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words * TOPICS, np.int64)
        for batch in batches:
            for part, heads in slices(batch, "heads", 4_000_000):
                head, of = unpacked(heads)
                topic = (shares(head, of, len(part)) @ c.T).argmax(1)
                total += np.bincount(head[head >= 0] * np.int64(TOPICS) + topic[of[head >= 0]], minlength=len(total))
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(total[key], pa.int64())], ["key", "n"])

    got = docs.select("heads").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_words * TOPICS)
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(-1, TOPICS)


def classify(voc: Vocabulary, by_topic: np.ndarray) -> None:
    """Classes: the end token; small ones of frequent words; topic and frequency groups; at last the rare words."""
    n = len(voc.words)
    share = by_topic / np.maximum(by_topic.sum(0), 1)
    topic = np.where(by_topic.sum(1) > 1, share.argmax(1), TOPICS)
    voc.klass, voc.place = np.zeros(n, np.int64), np.full(n, -1)
    end = np.array([w == END for w in voc.words], bool)
    rest = np.flatnonzero(~end)
    top, other = rest[:TOP], rest[TOP:]
    order = top[np.lexsort((top, topic[top]))]
    voc.klass[order], voc.place[order] = 1 + np.arange(len(order)) // TOP_CLASS, np.arange(len(order)) % TOP_CLASS
    bin_ = np.searchsorted(np.quantile(np.log(voc.counts[other] + 1), np.arange(1, BINS) / BINS), np.log(voc.counts[other] + 1)) if len(other) else np.empty(0, np.int64)
    voc.klass[other] = 1 + TOP // TOP_CLASS + topic[other] * BINS + bin_
    voc.n_classes = 2 + TOP // TOP_CLASS + (TOPICS + 1) * BINS


class Gru:
    """Weights, their gradient, and both directions through time."""

    def __init__(self, voc: Vocabulary, seed: int = 11):
        h, c, self.n_top, self.trained = HIDDEN, voc.n_classes, TOP // TOP_CLASS, 0  # trained: tokens learned from
        rng = np.random.default_rng(seed)
        size = np.bincount(voc.klass, voc.counts + 0.5, c)
        size[c - 1] += max(voc.tail_mass, 1e-9)
        word = np.full((self.n_top, TOP_CLASS), -30.0, np.float32)
        top = voc.place >= 0
        word[voc.klass[top] - 1, voc.place[top]] = np.log((voc.counts[top] + 0.5) / size[voc.klass[top]])
        self.size = size
        self.p = {"x": rng.normal(0, 0.1, (INPUTS + c, 3 * h)), "u": rng.normal(0, 0.3, (h, 3 * h)), "wc": np.zeros((h, c)),
                  "bc": np.log(np.maximum(size, 1e-9) / max(size.sum(), 1e-9)), "v": np.zeros((self.n_top, TOP_CLASS, h)), "d": word}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].astype(np.float32).reshape(v.shape)
            at += v.size

    def step(self, x: np.ndarray, h: np.ndarray, given: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """The next state and what led to it; ``given`` are the inputs' rows if they were looked up before."""
        n = HIDDEN
        a, u = self.p["x"][x] if given is None else given, h @ self.p["u"]
        zr = a[:, :2 * n] + u[:, :2 * n]
        np.negative(zr, zr)
        np.exp(zr, zr)
        zr += 1
        np.reciprocal(zr, zr)
        z, r, un = zr[:, :n], zr[:, n:], u[:, 2 * n:]
        m = r * un
        m += a[:, 2 * n:]
        np.tanh(m, m)
        new = h - m
        new *= z
        new += m
        return new, (x, h, z, r, m, un)

    def output(self, h: np.ndarray, klass: np.ndarray, place: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-likelihood of each class and, for frequent words, place; with ``grad`` also d loss / d h. Scores
        stand class by row, so that sums over classes run along whole rows of memory."""
        rows = np.arange(len(h))
        prob = self.p["wc"].T @ h.T
        prob += self.p["bc"][:, None]
        prob -= prob.max(0)
        out = prob[klass, rows]
        np.exp(prob, prob)
        norm = prob.sum(0)
        out -= np.log(norm)
        dh = None
        if grad is not None:
            prob /= norm
            prob[klass, rows] -= 1
            grad["wc"] += (prob @ h).T
            grad["bc"] += prob.sum(1)
            dh = np.ascontiguousarray((self.p["wc"] @ prob).T)
        inner = np.flatnonzero(place >= 0)
        inner = inner[np.argsort(klass[inner].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(klass[inner], np.arange(1, self.n_top + 2))
        hi, pi, found = h[inner], place[inner], np.empty(len(inner), np.float32)
        back = np.empty_like(hi) if grad is not None else None
        for k in range(self.n_top):
            at = slice(cuts[k], cuts[k + 1])
            n = cuts[k + 1] - cuts[k]
            if not n:
                continue
            e = self.p["v"][k] @ hi[at].T
            e += self.p["d"][k][:, None]
            e -= e.max(0)
            mine = np.arange(n)
            picked = e[pi[at], mine]
            np.exp(e, e)
            total = e.sum(0)
            found[at] = picked - np.log(total)
            if grad is not None:
                e /= total
                e[pi[at], mine] -= 1
                grad["v"][k] += e @ hi[at]
                grad["d"][k] += e.sum(1)
                back[at] = e.T @ self.p["v"][k]
        out[inner] += found
        if grad is not None:
            dh[inner] += back
        return out, dh

    def back(self, kept: tuple, dh: np.ndarray, grad: dict) -> tuple[np.ndarray, np.ndarray]:
        x, h, z, r, m, un = kept
        n = HIDDEN
        da = np.empty((len(dh), 3 * n), np.float32)
        dz, dr, dm = da[:, :n], da[:, n:2 * n], da[:, 2 * n:]
        left = dh * (1 - z)  # what passes into the new part
        np.multiply(h - m, left, dz)
        dz *= z
        np.multiply(left, 1 - m * m, dm)
        np.multiply(dm, un, dr)
        dr *= r
        dr *= 1 - r
        du = da.copy()
        du[:, 2 * n:] *= r
        grad["u"] += h.T @ du
        out = du @ self.p["u"].T
        out += dh * z
        return out, da


def inputs(voc: Vocabulary, head: np.ndarray, klass: np.ndarray) -> np.ndarray:
    return np.where((head >= 0) & (head < INPUTS), head, INPUTS + klass).astype(np.int32)


def classes_of(voc: Vocabulary, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place of each token; rare and unknown ones are of the last class."""
    if not len(voc.words):
        return np.full(len(head), voc.n_classes - 1, np.int16), np.full(len(head), -1, np.int16)
    return (np.append(voc.klass, voc.n_classes - 1).astype(np.int16)[head], np.append(voc.place, -1).astype(np.int16)[head])  # -1 takes the last


def with_ends(voc: Vocabulary, head: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Head numbers with an end token after each text, and where each text starts (n + 1 places)."""
    length = np.bincount(of, minlength=n)
    start = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(start[-1], voc.end, np.int32)
    out[np.arange(len(head)) + of] = head
    return out, start


def train_shard(voc: Vocabulary, model: Gru, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> int:
    """One pass of truncated backpropagation; texts: (inputs, classes, places). Stretches of the texts are
    dealt to LANES lanes that advance side by side, each stretch starting with a new state, so that a long text does
    not train on alone when the others have ended."""
    lanes: list[list] = [[] for _ in range(LANES)]
    load = np.zeros(LANES, np.int64)
    parts = [tuple(c[a:a + STRETCH] for c in x) for x in texts for a in range(0, len(x[0]), STRETCH)]
    for x in sorted(parts, key=lambda x: -len(x[0])) if len(parts) < 8 * LANES else parts:
        at = int(load.argmin())
        lanes[at].append(x)
        load[at] += len(x[0])
    steps = int(load.max()) if texts else 0
    x, klass, place = (np.full((steps, LANES), fill, np.int32) for fill in (0, -1, -1))
    fresh = np.zeros((steps, LANES), bool)
    for i, lane in enumerate(lanes):
        if lane:
            n = load[i]
            for to, c in ((x, 0), (klass, 1), (place, 2)):
                to[:n, i] = np.concatenate([t[c] for t in lane])
            fresh[np.cumsum([0, *(len(t[0]) for t in lane[:-1])]), i] = True
    seen = {k: np.zeros_like(v) for k, v in model.p.items()}
    state = np.zeros((LANES, HIDDEN), np.float32)
    for begin in range(0, steps, WINDOW):
        on, span = np.flatnonzero(load > begin), slice(begin, min(begin + WINDOW, steps))
        xs, news, h, tapes, outs = x[span, on], fresh[span, on], state[on], [], []
        some_new = news.any(1)
        for t in range(len(xs)):
            if some_new[t]:
                h = np.where(news[t, :, None], np.float32(0), h)
            h, tape = model.step(xs[t], h)
            tapes.append(tape)
            outs.append(h)
        state[on] = h
        rows = np.flatnonzero((load[on] > np.arange(span.start, span.stop)[:, None]).ravel())
        grad = {k: np.zeros_like(v) for k, v in model.p.items() if k != "x"}
        flat = np.concatenate(outs)
        whole = len(rows) == len(flat)
        _, dout = model.output(flat if whole else flat[rows], *(c[span, on].ravel()[rows] for c in (klass, place)), grad)
        if not whole:
            dout, some = np.zeros((len(flat), HIDDEN), np.float32), dout
            dout[rows] = some
        dout = dout.reshape(len(tapes), len(on), HIDDEN)
        dh, dx = np.zeros((len(on), HIDDEN), np.float32), np.empty((len(tapes), len(on), 3 * HIDDEN), np.float32)
        for t in range(len(tapes) - 1, -1, -1):
            dh += dout[t]
            dh, dx[t] = model.back(tapes[t], dh, grad)
            if some_new[t]:
                dh = np.where(news[t, :, None], np.float32(0), dh)
        which = xs.ravel()
        order = np.argsort(which.astype(np.int16), kind="stable")  # there are less than 2^15 rows of inputs
        ordered = which[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        touched = ordered[first]
        gx = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first)
        scale = 1 / np.sqrt(LANES * WINDOW)  # the same for all windows: a few long texts left over weigh little
        rate = RATE * min(1.0, (1 + begin // WINDOW) / WARM_STEPS)
        for k, g in grad.items():
            g *= scale
            seen[k] += g * g
            model.p[k] -= rate * g / np.sqrt(seen[k] + 0.1)
        gx *= scale
        seen["x"][touched] += gx * gx
        model.p["x"][touched] -= rate * gx / np.sqrt(seen["x"][touched] + 0.1)
    return int(load.sum())


def summed(each: DataFrame, shards: int) -> DataFrame:
    """(at, n, w): weighted sums of the shards' weights (at, shard, n, w), ``SUM_FAN`` of them in a task at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = None, 0, np.empty(0)
        for batch in batches:
            for at, shard, k, w in zip(*(batch.column(c) for c in ("at", "shard", "n", "w")), strict=True):
                if (at.as_py(), shard.as_py()) != key:
                    if key is not None:
                        yield row(key, n, total)
                    key, n, total = (at.as_py(), shard.as_py()), 0, np.zeros(len(w))
                n, total = n + k.as_py(), total + w.values.to_numpy()
        if key is not None:
            yield row(key, n, total)

    def row(key: tuple, n: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([n]), pa.array([total], pa.list_(pa.float64()))], ["at", "shard", "n", "w"])

    while True:
        shards = -(-shards // SUM_FAN)
        dealt = each.withColumn("shard", F.pmod("shard", F.lit(shards))).repartition("at", "shard").sortWithinPartitions("at", "shard")
        each = dealt.mapInArrow(run, "at long, shard long, n long, w array<double>")
        if shards == 1:
            return each


def train(docs: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Gru:
    """One pass over all coded documents. A round's shards start from the same weights, train alone, and are averaged
    by their tokens; the next round goes on from there with other documents."""
    model, chunk, sc = Gru(voc), 1024, docs.sparkSession.sparkContext
    n = docs.count()
    shards = max(2, -(-n // (rounds * SHARD_DOCS)))
    shared = sc.broadcast(voc)
    docs = docs.select("doc_id", "heads", F.pmod(F.xxhash64("doc_id", "heads", F.lit(23)), F.lit(rounds)).alias("turn"))
    for turn in range(rounds if n else 0):
        start = sc.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, done = Gru(shared.value), 0
            own.load(start.value)
            for batch in batches:
                for part, heads in slices(batch, "heads", 4_000_000):
                    texts = []
                    head, begin = with_ends(shared.value, *unpacked(heads), len(part))
                    klass, place = classes_of(shared.value, head)
                    x = inputs(shared.value, head, klass)
                    for i in range(len(part)):
                        s = slice(begin[i], begin[i + 1])
                        texts.append((np.concatenate([[x[begin[i + 1] - 1]], x[s][:-1]]), klass[s], place[s]))
                    done += train_shard(shared.value, own, texts)
            if done:
                flat = own.flat().astype(np.float64) * done
                at = range(0, len(flat), chunk)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(at), pa.int64()), pa.array([done] * len(at), pa.int64()),
                                                  pa.array([flat[a:a + chunk] for a in at], pa.list_(pa.float64()))], ["at", "shard", "n", "w"])

        dealt = (docs.where(F.col("turn") == turn).repartition(shards, F.xxhash64("doc_id", "heads", F.lit(turn)))
                 .sortWithinPartitions(F.xxhash64("doc_id", "heads", F.lit(turn + 1))))
        flat = start.value.astype(np.float64)
        for r in summed(dealt.mapInArrow(run, "at long, shard long, n long, w array<double>"), shards).toLocalIterator():  # rows of one model's weights
            model.trained += r["n"] if r["at"] == 0 else 0
            flat[r["at"]:r["at"] + len(r["w"])] = np.array(r["w"]) / r["n"]
        model.load(flat)
        start.unpersist()
    shared.unpersist()
    return model


def log_likelihoods(voc: Vocabulary, model: Gru, head: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log10 probability of each text's tokens, rare words without their share (c + 0.5) of the last class."""
    klass, place = classes_of(voc, head)
    x = inputs(voc, head, klass)
    fixed = np.zeros(len(head))
    known = (head >= 0) & (place < 0)
    fixed[known] = np.log(voc.counts[head[known]] + 0.5) - np.log(model.size[klass[known]])
    fixed[head < 0] = -np.log(model.size[-1])
    length = np.diff(start)
    order = np.argsort(-length, kind="stable")
    length, begin = length[order], start[:-1][order]
    last = x[start[1:] - 1][order]  # the end token's row stands before the first word
    total = np.add.reduceat(fixed, start[:-1])[order] if len(length) else np.zeros(0)
    longest = int(length[0]) if len(length) else 0
    alive = len(length) - np.searchsorted(length[::-1], np.arange(longest), "right")  # texts that have a token at each step
    h, t = np.zeros((len(length), HIDDEN), np.float32), 0
    while t < longest:
        sizes = alive[t:t + max(8, min(2048, 40_000 // alive[t]))]
        of = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place among the texts that go on
        rows = begin[of] + np.repeat(np.arange(t, t + len(sizes)), sizes)
        before = x[rows - 1]
        if t == 0:
            before[:sizes[0]] = last[:sizes[0]]
        given, outs, at = model.p["x"][before], np.empty((len(rows), HIDDEN), np.float32), 0
        for n in sizes.tolist():
            h, _ = model.step(None, h[:n], given[at:at + n])
            outs[at:at + n] = h
            at += n
        got, _ = model.output(outs, klass[rows], place[rows])
        total[:sizes[0]] += np.bincount(of, got, sizes[0])
        t += len(sizes)
    out = np.empty(len(length))
    out[order] = total / np.log(10)
    return out


PARTS = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_score double"


def score_parts(docs: DataFrame, voc, model) -> DataFrame:
    """What the vocabulary and the model give of each coded document (row, doc_id, held_out, heads); both are broadcast
    variables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = voc.value, model.value
        for batch in batches:
            for part, heads in slices(batch, "heads", 8_000_000):
                head, start = with_ends(v, *unpacked(heads), len(part))
                known = head >= 0
                base = np.where(known, np.log10((v.counts[head] if len(v.counts) else 0) + 0.5), 0.0)
                end = 0.0 if v.end >= 0 else float(np.log10(0.5))  # unknown only if nothing was learned
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(start), pa.int64()),
                    pa.array(np.add.reduceat(known, start[:-1]).astype(np.int64)), pa.array(np.add.reduceat(base, start[:-1]) + end),
                    pa.array(log_likelihoods(v, m, head, start) + end)],
                    ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score"])

    return docs.select("row", "doc_id", "held_out", "heads").mapInArrow(run, PARTS)


def learn(docs: DataFrame) -> tuple[DataFrame, DataFrame, Vocabulary, Gru]:
    """(word counts, the coded documents, vocabulary, weights) of (doc_id, held_out, text): counts and weights come
    from every document that is not held out."""
    counts = written(count_words(docs.where(~F.col("held_out"))), "lm-counts")
    voc = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    rows = written(coded(docs, shared).withColumn("row", F.monotonically_increasing_id()), "lm-coded")
    shared.unpersist()
    own = rows.where(~F.col("held_out"))
    vectors = written(topic_vectors(own), "lm-vectors")
    # the start's documents are those of least hash; the bound lets about twice as many through to the sort
    bound = int(min(1.0, 2 * TOPIC_DOCS / max(1, vectors.count())) * (1 << 64)) - (1 << 63) - 1
    some = vectors.where(F.col("h") <= bound).orderBy("h", "vector").limit(TOPIC_DOCS).toArrow()
    c = settled(vectors, centres(floats(some.column("vector"))))
    classify(voc, word_topics(own, len(voc.words), c))
    forget(vectors)
    return counts, rows, voc, train(own, voc)


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, learned from those
    for which ``held_out`` does not hold."""
    sc = docs.sparkSession.sparkContext
    counts, rows, voc, model = learn(docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text")))

    parts = score_parts(rows, sc.broadcast(voc), sc.broadcast(model))
    rare = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", F.col("t.n").alias("times"))
    met = (rare.join(counts, "word", "left").groupBy("row")
           .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("known")))
    spread = F.coalesce("rare", F.lit(0.0))
    return parts.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + spread - F.col("n_tokens") * F.lit(float(np.log10(voc.mass)))).alias("base_score"),
        (F.col("head_score") + spread).alias("score"))
