"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Random indexing: every word and every word shape has a fixed sparse index vector (two signed places, given by its hash); the
context vector of a word is the sum of its neighbours' index vectors over the whole corpus. A document is the mean of its
words' and shapes' context vectors, the mean of its shapes' index vectors, and shares of repeated words and word triples. A
network with one hidden layer is fitted to labelled documents, and a temperature to others of them.

The network is fitted on at most ``max_train`` labelled documents (those with the least id hash); context vectors come from
all documents. Null or empty texts get the score of an empty document, documents without id are scored too, repeated rows are
scored each, repeated labels of a document count once (the largest), an empty table gives an empty result, and without usable
labels every score is 0.5. Texts are read whole; further columns are ignored, and labels, language, source and id are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import Words, combine, fold, keep_rows, load, mix, slices, text_of

MAX_TRAIN = 8192
DIMS = 32
BUCKETS = 1 << 13
SHAPES = 1 << 8
ROWS = BUCKETS + SHAPES


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.arange(ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
    place = np.stack([h % np.uint64(DIMS), (h >> np.uint64(16)) % np.uint64(DIMS)], 1).astype(np.int64)
    sign = np.stack([(h >> np.uint64(40)) & np.uint64(1), (h >> np.uint64(41)) & np.uint64(1)], 1).astype(np.float64) * 2 - 1
    return place, sign


#: Each byte as a count of one in its own 16 bits: capitals, small letters, digits, marks.
_KINDS = np.zeros(256, np.uint64)
_KINDS[33:] = np.uint64(1) << np.uint64(48)
_KINDS[65:91] = np.uint64(1)
_KINDS[97:123] = _KINDS[128:] = np.uint64(1) << np.uint64(16)
_KINDS[48:58] = np.uint64(1) << np.uint64(32)
#: Words that are summed in single precision; longer texts are summed part by part.
PART = 1024


def shapes(words: Words) -> np.ndarray:
    """A small number for each word's look: capitals, small letters, digits, marks inside and at the end, length."""
    sums = np.zeros(len(words.buf) + 1, np.uint64)
    np.cumsum(_KINDS[words.buf], out=sums[1:])
    held = sums[words.ends] - sums[words.starts]
    nu, nl, nd, nm = ((held >> np.uint64(k)).astype(np.int64) & 0xFFFF for k in (0, 16, 32, 48))
    caps = np.where(nu == 0, 0, np.where(nl == 0, 2, 1))
    return (np.minimum(nm, 3) * 48 + caps * 16 + (nd > 0) * 8 + np.minimum(np.log2(words.ends - words.starts + 1).astype(np.int64), 7)) % SHAPES


def shape_index() -> np.ndarray:
    """Index vectors of the shapes, a row each."""
    place, sign = _index_vectors()
    out = np.zeros((SHAPES, DIMS))
    for k in range(2):
        np.add.at(out, (np.arange(SHAPES), place[BUCKETS:, k]), sign[BUCKETS:, k])
    return out


def text_sums(words: Words, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each text the sum over its words of table[index of the word], of all (table, index), whose rows are of one length."""
    count = words.counts
    many = -(-count // PART)
    bounds = np.concatenate([[0], np.cumsum(many)])
    starts = (np.arange(bounds[-1]) - np.repeat(bounds[:-1], many)) * PART + np.repeat(words.first[:-1], many)
    out = np.zeros((len(count), tables[0][0].shape[1]))
    text = np.repeat(np.arange(len(count)), many)
    step = 128  # parts at a time
    for lo in range(0, len(starts), step):
        a, z = int(starts[lo]), int(starts[lo + step]) if lo + step < len(starts) else len(words)
        rows = tables[0][0].take(tables[0][1][a:z], axis=0)
        for table, index in tables[1:]:
            rows += table.take(index[a:z], axis=0)
        np.add.at(out, text[lo : lo + step], np.add.reduceat(rows, starts[lo : lo + step] - a, axis=0, dtype=np.float32))
    return out


def repeats(words: Words, own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each text the words whose bucket is that of the word before, and the runs of three words that stood in it before."""
    n, doc = len(words.first) - 1, words.doc
    out = np.zeros((n, 2))
    if len(words) > 1:
        out[:, 0] = np.bincount(doc[1:][(own[1:] == own[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    if len(words) > 2:
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        triple = combine([h[whole], h[whole + 1], h[whole + 2]]) >> np.uint64(17)
        both = np.sort((doc[whole].astype(np.uint64) << np.uint64(47)) | triple)
        again = both[1:][both[1:] == both[:-1]] >> np.uint64(47)
        out[:, 1] = np.bincount(again.astype(np.int64), minlength=n)
    return out


@dataclass
class Model:
    context: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    _folded: tuple | None = None

    def _words(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and shape of each word; for each text the shares of repeated words and triples, and its length."""
        h = words.hashes()
        own = (h % np.uint64(BUCKETS)).astype(np.int64)
        rest = np.hstack([repeats(words, own, h) / np.maximum(words.counts, 1)[:, None], np.log1p(words.counts)[:, None] / 10])
        return own, shapes(words), rest

    def pool(self, words: Words) -> np.ndarray:
        """One row of features for each text: means of its words' and shapes' context vectors and of its shapes' index vectors, and the rest."""
        own, look, rest = self._words(words)
        count = np.maximum(words.counts, 1)[:, None]
        context = self.context.astype(np.float32)
        means = [text_sums(words, [part]) / count for part in ((context[:BUCKETS], own), (context[BUCKETS:], look), (shape_index().astype(np.float32), look))]
        return np.hstack([*means, rest])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        if self.w1 is None:
            return np.full(len(x), 0.5)
        return self._out((x - self.mean) / self.scale @ self.w1 + self.b1)

    def _out(self, hidden: np.ndarray) -> np.ndarray:
        z = np.tanh(hidden) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))

    def folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first layer applied to the rows that are pooled, for it is linear: tables of words and shapes, weights of the rest, and offset."""
        if self._folded is None:
            w = self.w1 / self.scale[:, None]
            word = self.context[:BUCKETS] @ w[:DIMS]
            shape = self.context[BUCKETS:] @ w[DIMS : 2 * DIMS] + shape_index() @ w[2 * DIMS : 3 * DIMS]
            self._folded = word.astype(np.float32), shape.astype(np.float32), w[3 * DIMS :], self.b1 - self.mean @ w
        return self._folded

    def score_texts(self, words: Words) -> np.ndarray:
        """``score(pool(words))``, with the first layer folded into the tables."""
        if self.w1 is None:
            return np.full(len(words.first) - 1, 0.5)
        own, look, rest = self._words(words)
        word, shape, more, offset = self.folded()
        return self._out(text_sums(words, [(word, own), (shape, look)]) / np.maximum(words.counts, 1)[:, None] + rest @ more + offset)


def context_vectors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Unit context vectors of all word and shape buckets, from every document. A fixed number of rows comes to the driver."""

    def run(batches):
        place, sign = _index_vectors()
        total = np.zeros(ROWS * DIMS)
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column("body")):
                words = Words(buf, offsets)
                if len(words) < 2:
                    continue
                own, look, doc = (words.hashes() % np.uint64(BUCKETS)).astype(np.int64), shapes(words) + BUCKETS, words.doc
                near = doc[1:] == doc[:-1]
                pairs = [(own[:-1][near], own[1:][near]), (own[1:][near], own[:-1][near]), (look[:-1][near], look[1:][near]), (look[1:][near], look[:-1][near]), (own, look)]
                for a, b in pairs:
                    for k in range(2):
                        total += np.bincount(a * DIMS + place[b, k], weights=sign[b, k], minlength=ROWS * DIMS)
        total = total.reshape(ROWS, DIMS)
        some = np.flatnonzero(np.abs(total).sum(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, j]) for j in range(DIMS))], names=["bucket", *(f"c{j}" for j in range(DIMS))])

    parts = text_of(docs, key, text).mapInArrow(run, "bucket long, " + ", ".join(f"c{j} double" for j in range(DIMS)))
    sums = parts.groupBy("bucket").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(DIMS)))
    out = np.zeros((ROWS, DIMS))
    got = sums.toPandas()
    if len(got):
        out[got["bucket"].to_numpy()] = got[[f"c{j}" for j in range(DIMS)]].to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def labelled(docs: DataFrame, labels: DataFrame, label: str, n_folds: int, out_fold: int, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, y, part and body of at most ``limit`` labelled documents outside the held-out fold: those with the least id hash; of several rows with one id, the largest text."""
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key, n_folds) != out_fold)).groupBy(F.col(key).alias("lab_key")).agg(F.max(label).cast("int").alias("y"))
    chosen = marks.withColumn("rank", F.xxhash64("lab_key")).orderBy("rank", "lab_key").limit(limit)
    rows = text_of(docs, key, text).join(F.broadcast(chosen), F.col("key") == F.col("lab_key")).groupBy("key", "y").agg(F.max("body").alias("body"))
    return rows.select("key", "y", F.pmod(F.xxhash64(F.col("key") + 1), F.lit(4)).cast("int").alias("part"), "body")


def fit_network(x: np.ndarray, y: np.ndarray, part: np.ndarray, model: Model, hidden: int = 24, steps: int = 400, seed: int = 7) -> Model:
    """Adam on the rows whose part is not 0; the temperature is the one that gives the others the least log loss."""
    learn = part != 0
    if learn.sum() < 4 or len(np.unique(y[learn])) < 2:
        return model
    model.mean, model.scale = x[learn].mean(0), x[learn].std(0) + 1e-6
    z = (x - model.mean) / model.scale
    a, t = z[learn], y[learn].astype(float)
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(a.shape[1]), (a.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        h = np.tanh(a @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) * weight / len(t)
        g = np.outer(d, p[2]) * (1 - h * h)
        grads = [a.T @ g + 1e-4 * p[0], g.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3][0])
    if (~learn).sum() >= 4:
        logit = np.tanh(z[~learn] @ p[0] + p[1]) @ p[2] + p[3]
        losses = [(np.mean(np.logaddexp(0, np.where(y[~learn] == 1, -1, 1) * logit / temp)), temp) for temp in np.geomspace(0.25, 16, 49)]
        model.temperature = float(min(losses)[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, key: str = "doc_id", text: str = "text") -> Model:
    model = Model(context_vectors(docs, text, key))

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                x = model.pool(Words(buf, offsets)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("y")[lo:hi], batch.column("part")[lo:hi], pa.array(list(x), pa.list_(pa.float32()))], names=["y", "part", "x"])

    got = labelled(docs, labels, "quality", 4, 2, max_train, key, text).mapInArrow(run, "y int, part int, x array<float>").toPandas()
    if not len(got):
        return model
    return fit_network(np.stack(got["x"].to_numpy()).astype(float), got["y"].to_numpy(), got["part"].to_numpy(), model)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every document."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo:hi].cast(pa.int64()), pa.array(model.score_texts(Words(buf, offsets)))], names=["key", "score"])

    scored = text_of(docs, key, text).mapInArrow(run, "key long, score double")
    return scored.select(F.col("key").alias(key), F.coalesce(fold("key", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    return keep_rows(docs, lambda words: model.score_texts(words) >= threshold, text)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return classify(docs, fit(docs, labels))
