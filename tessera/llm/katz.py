"""Katz backoff: Good-Turing discounted bigram counts, exactly normalised backoff weights, evaluated token by token.

P(w | h) = d(c) c(h, w) / c(h) where the pair was seen, else alpha(h) P(w); P(w) = d(c) c(w) / N where the word was seen, else
what the discounts left over. alpha(h) makes the probabilities of all known words and the unknown one add up to 1; where a
history's discounts leave nothing over, its count is taken one higher. Discounts are Good-Turing's up to ``K`` with Katz's
correction, or an absolute one for each count where the counts of counts don't allow that.

Tokens are read once into chunks of ``CHUNK_TOKENS``. A chunk asks for each of its distinct words, then for each distinct pair,
once: sorted 48-bit keys are dealt into slices of the key space, every slice adds up what all chunks sent, and answers each
chunk in the order it asked. So a frequent word or pair is one entry in each chunk, no matter how often it occurs, and only
distinct keys are shuffled. The slices' counts are the model: partitioned tables in the shared folder.

Null texts are one end token; rows without id are scored and not learned from; repeated rows are learned from and scored
each time; an empty table gives an empty result; further columns are ignored. Without any training token the scores are those of
a lone unknown word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import Words, fold, load, materialise, mix, open_folder, shared_path, slices, text_of

K = 5
CHUNK_TOKENS = 1 << 21
KEY_BITS = 48
#: Text bytes for each slice of the key space.
SLICE_OF = 16 << 20
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0x0FEDCBA987654321)
_TOP = np.uint64(64 - KEY_BITS)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, in 4 bytes each if they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    if len(steps) and int(steps[1:].max(initial=0)) < 2**32:
        return b"4" + keys[:1].tobytes() + steps[1:].astype(np.uint32).tobytes()
    return b"8" + steps.tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    if raw[:1] == b"8":
        return np.cumsum(np.frombuffer(raw, np.uint64, offset=1), dtype=np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.uint64, 1, 1), np.frombuffer(raw, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(raw: bytes, kind=np.uint32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _cut(keys: np.ndarray, n_slices: int) -> np.ndarray:
    """Bounds of the slices among sorted keys."""
    edges = (np.arange(n_slices + 1, dtype=np.float64) * (2.0**KEY_BITS / n_slices)).astype(np.uint64)
    edges[-1] = np.uint64(1 << KEY_BITS)
    return np.searchsorted(keys, edges)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0), ..., d(K) from the counts of counts n[1..K+1]; d(0) is not used."""
    d = np.ones(K + 1)
    if n[1] <= 0:
        return d
    part = n[1] / (n[1] + 2 * n[2]) if n[2] > 0 else 0.5
    r = np.arange(1, K + 1)
    d[1:] = (r - part) / r
    a = (K + 1) * n[K + 1] / n[1]
    if (n[1 : K + 2] > 0).all() and a < 1:
        good = ((r + 1) * n[2 : K + 2] / n[1 : K + 1] / r - a) / (1 - a)
        d[1:] = np.where((good > 0) & (good <= 1), good, d[1:])
    return d


class Unigrams:
    def __init__(self, n: np.ndarray, total: int, distinct: int):
        self.d, self.total, self.distinct = discounts(n), total, distinct
        lost = float((n[1 : K + 1] * np.arange(1, K + 1) * (1 - self.d[1:])).sum())
        self.scale, self.unknown = (total, lost / total) if total and lost > 0 else (total + 1, 1 / (total + 1))
        if lost <= 0:
            self.d = np.ones(K + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts."""
        return np.where(c > 0, self.d[np.minimum(c, K)] ** (c <= K) * c / self.scale, self.unknown)


def _pairs(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + w) >> _TOP




ROWS = "kind string, chunk long, slice int, keys binary, a binary, b binary, c binary"


def _row(kind, chunk, part, keys=b"", a=b"", b=b"", c=b"") -> pa.RecordBatch:
    names = [("kind", pa.string()), ("chunk", pa.int64()), ("slice", pa.int32()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((kind, chunk, part, keys, a, b, c), names, strict=True)], names=[n for n, _ in names])


def read_tokens(docs: DataFrame, n_slices: int, key: str, text: str) -> DataFrame:
    """Chunks of whole documents: their ids, folds, bounds and tokens (as places among the chunk's sorted distinct words), and requests."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        hashes, ids, marks, sizes, held = [], [], [], [], 0

        def close():
            word = np.concatenate(hashes) >> _TOP
            count, train = np.concatenate(sizes), np.concatenate(marks)
            keys, token = np.unique(np.append(word, START >> _TOP), return_inverse=True)
            token = token[:-1]
            learned = np.repeat(train == 1, count)
            seen = np.bincount(token[learned], minlength=len(keys))
            chunk = (part << 24) + number
            yield _row("chunk", chunk, -1, pack_keys(keys), pack(token.astype(np.uint32)), pack(np.concatenate(ids)), pack(np.stack([count, train], 1).astype(np.int64).reshape(-1)))
            cuts = _cut(keys, n_slices)
            for s in range(n_slices):
                lo, hi = cuts[s], cuts[s + 1]
                if hi > lo:
                    yield _row("word", chunk, s, pack_keys(keys[lo:hi]), pack(seen[lo:hi].astype(np.uint32)))

        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                words = Words(buf, offsets)
                n = words.counts + 1
                h = np.full(n.sum(), END, np.uint64)
                inner = np.ones(len(h), bool)
                inner[np.cumsum(n) - 1] = False
                h[inner] = words.hashes()
                hashes.append(h)
                own = batch.column("key")[lo:hi]
                ids.append(np.stack([own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False).astype(np.int64)], 1).reshape(-1))
                marks.append(batch.column("mark")[lo:hi].to_numpy().astype(np.int64))
                sizes.append(n)
                held += len(h)
                if held >= CHUNK_TOKENS:
                    yield from close()
                    number += 1
                    hashes, ids, marks, sizes, held = [], [], [], [], 0
        if held:
            yield from close()

    mark = F.when(fold(key, 10) == 0, 2).when(F.col(key).isNotNull(), 1).otherwise(0)  # 1: learned from, 2: held out
    return text_of(docs.withColumn("mark", mark), key, text, "mark").withColumn("key", F.col("key").cast("long")).mapInArrow(run, ROWS)


def _add_up(parts: list[tuple[int, np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys of several requests, sums of their columns, each request's places among the keys, and the requests' bounds."""
    keys, place = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
    sums = [np.bincount(place, weights=np.concatenate([c[i] for _, _, c in parts]).astype(np.float64), minlength=len(keys)) for i in range(len(parts[0][2]))]
    return keys, sums, place, np.cumsum([0, *(len(k) for _, k, _ in parts)])


def _of_counts(c: np.ndarray) -> np.ndarray:
    """Counts of counts 0..K+1, the sum, and the number of keys that occur."""
    return np.concatenate([np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2], [c.sum(), (c > 0).sum()]]).astype(np.int64)


def count_words(requests: DataFrame) -> DataFrame:
    """Answers to chunks (kind word: counts in the order asked), and statistics (kind stat)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [(r["chunk"], unpack_keys(r["keys"]), [unpack(r["a"])]) for r in rows]
        _, (c,), place, at = _add_up(parts)
        c = c.astype(np.int64)
        out = [_row("stat", 0, rows[0]["slice"], a=_of_counts(c).tobytes())]
        for i, (chunk, _, _) in enumerate(parts):
            out.append(_row("word", chunk, rows[0]["slice"], a=pack(c[place[at[i] : at[i + 1]]].astype(np.uint32))))
        return pa.Table.from_batches(out)

    return requests.groupBy("slice").applyInArrow(run, ROWS)


def statistics(table: DataFrame) -> np.ndarray:
    """Sums of the slices' statistics; one row of sums comes to the driver."""
    names = [f"s{i}" for i in range(K + 4)]

    def run(batches):
        for batch in batches:
            sums = sum((np.frombuffer(a, np.int64) for a in batch.column("a").to_pylist()), np.zeros(K + 4, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in sums], names=names)

    parts = table.where("kind = 'stat'").select("a").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return np.array([x or 0 for x in parts.agg(*(F.sum(n).alias(n) for n in names)).first()], np.int64)


def publish(answers: DataFrame, name: str) -> str:
    """Writes answers by chunk into the shared folder, for ``answer``."""
    path = shared_path(answers.sparkSession, name)
    answers.select("chunk", "slice", "a", "b").repartition("chunk").write.partitionBy("chunk").option("compression", "zstd").parquet(path)
    return path


def answer(path: str, chunk: int) -> list[dict]:
    """A chunk's answers in the order of the key space."""
    store, folder = open_folder(path)
    files = [f.path for f in store.get_file_info(_selector(f"{folder}/chunk={chunk}")) if f.path.endswith(".parquet")]
    rows = [r for f in files for r in pq.ParquetFile(store.open_input_file(f)).read().to_pylist()]
    return sorted(rows, key=lambda r: r["slice"])


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


class Chunk:
    """A chunk's documents and tokens, with counts of its distinct words."""

    def __init__(self, row: dict, words: str):
        self.number = row["chunk"]
        self.keys, self.token = unpack_keys(row["keys"]), unpack(row["a"])
        ids = unpack(row["b"], np.int64).reshape(-1, 2)
        self.ids, self.no_id = ids[:, 0], ids[:, 1] > 0
        self.size, self.mark = unpack(row["c"], np.int64).reshape(-1, 2).T
        self.count = np.concatenate([unpack(r["a"]) for r in answer(words, self.number)]).astype(np.int64)
        start = np.searchsorted(self.keys, START >> _TOP)
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        self.before[np.cumsum(self.size) - self.size] = start
        self.learned = np.repeat(self.mark == 1, self.size)

    def pairs(self):
        """Distinct pairs, the first token of each, and each token's pair."""
        return np.unique(_pairs(self.keys[self.before], self.keys[self.token]), return_index=True, return_inverse=True)


def ask_pairs(chunks: DataFrame, words: str, n_slices: int) -> DataFrame:
    """Requests for pairs: keys, how often learned, the word's count, and the history's key."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k = Chunk(row, words)
                keys, first, pair = k.pairs()
                seen = np.bincount(pair[k.learned], minlength=len(keys))
                second, history = k.count[k.token[first]], k.keys[k.before[first]]
                cuts = _cut(keys, n_slices)
                for s in range(n_slices):
                    lo, hi = cuts[s], cuts[s + 1]
                    if hi > lo:
                        # A history is named by its place among the slice's distinct ones, for it recurs.
                        names, at = np.unique(history[lo:hi], return_inverse=True)
                        yield _row("pair", k.number, s, pack_keys(keys[lo:hi]), pack(seen[lo:hi].astype(np.uint32)), pack(second[lo:hi].astype(np.uint32)), pack_keys(names) + b"|" + pack(at.astype(np.uint32)) + len(names).to_bytes(4, "little"))

    return chunks.mapInArrow(run, ROWS)


def _histories(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[-4:], "little")
    size = 1 + (8 * n if raw[:1] == b"8" else 8 + 4 * (n - 1))
    return unpack_keys(raw[:size])[unpack(raw[size + 1 : -4])]


def count_pairs(requests: DataFrame, unigrams: Unigrams, n_slices: int) -> DataFrame:
    """Answers to chunks (kind pair), statistics, and what each history's seen words come to (kind history: sums by key)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [(r["chunk"], unpack_keys(r["keys"]), [unpack(r["a"])]) for r in rows]
        keys, (c,), place, at = _add_up(parts)
        c = c.astype(np.int64)
        one = np.empty(len(keys), np.int64)
        one[place] = np.arange(len(place))
        second = np.concatenate([unpack(r["b"]) for r in rows])[one].astype(np.int64)
        history = np.concatenate([_histories(r["c"]) for r in rows])[one]
        number = rows[0]["slice"]
        out = [_row("stat", 0, number, a=_of_counts(c).tobytes())]
        for i, (chunk, _, _) in enumerate(parts):
            out.append(_row("pair", chunk, number, a=pack(c[place[at[i] : at[i + 1]]].astype(np.uint32))))
        seen = c > 0
        names, h = np.unique(history[seen], return_inverse=True)
        held, p = c[seen], unigrams.p(second[seen])
        of = np.stack([np.bincount(h[held == r], minlength=len(names)) for r in range(1, K + 1)] + [np.bincount(h, weights=np.where(held > K, held, 0), minlength=len(names))], 1).astype(np.uint32)
        mass = np.bincount(h, weights=p, minlength=len(names))
        cuts = _cut(names, n_slices)
        for s in range(n_slices):
            lo, hi = cuts[s], cuts[s + 1]
            if hi > lo:
                out.append(_row("history", -1, s, pack_keys(names[lo:hi]), pack(of[lo:hi].reshape(-1)), pack(mass[lo:hi])))
        return pa.Table.from_batches(out)

    return requests.groupBy("slice").applyInArrow(run, ROWS)


def weigh(requests: DataFrame, d: np.ndarray) -> DataFrame:
    """Answers to chunks (kind weight): each word's denominator and backoff weight as a history. requests: kinds word and history."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sent = [r for r in rows if r["kind"] == "history"]
        asked = [r for r in rows if r["kind"] == "word"]
        if sent:
            parts = [(0, unpack_keys(r["keys"]), [*unpack(r["a"]).reshape(-1, K + 1).T, unpack(r["b"], np.float64)]) for r in sent]
            keys, sums, _, _ = _add_up(parts)
            of, mass = np.stack(sums[: K + 1], 1), sums[K + 1]
            r = np.arange(1, K + 1)
            total = of[:, :K] @ r + of[:, K]
            kept = of[:, :K] @ (r * d[1:]) + of[:, K]
            full = total - kept <= 1e-12 * total
            below = np.where(full, total + 1, total)
            alpha = np.where(full, 1, total - kept) / below / np.maximum(1 - mass, 1e-300)
        out = [_row("none", -1, rows[0]["slice"])]
        for q in asked:
            want = unpack_keys(q["keys"])
            den, weight = np.zeros(len(want)), np.ones(len(want))
            if sent:
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                den[hit], weight[hit] = below[at[hit]], alpha[at[hit]]
            out.append(_row("weight", q["chunk"], q["slice"], a=pack(den), b=pack(weight)))
        return pa.Table.from_batches(out)

    return requests.groupBy("slice").applyInArrow(run, ROWS)


RESULT = "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def evaluate(chunks: DataFrame, words: str, pairs: str, weights: str, unigrams: Unigrams, d: np.ndarray) -> DataFrame:
    """Scores of each chunk's documents: a token's pair if it was seen, else its history's weight times its word."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k = Chunk(row, words)
                _, _, pair = k.pairs()
                c2 = np.concatenate([unpack(r["a"]) for r in answer(pairs, k.number)]).astype(np.int64)[pair]
                got = answer(weights, k.number)
                den, alpha = (np.concatenate([unpack(r[x], np.float64) for r in got])[k.before] for x in ("a", "b"))
                c1 = k.count[k.token]
                p = np.where(c2 > 0, d[np.minimum(c2, K)] ** (c2 <= K) * c2 / np.maximum(den, 1), alpha * unigrams.p(c1))
                base = np.log10((c1 + 0.1) / (unigrams.total + 0.1 * (unigrams.distinct + 1)))
                at = np.cumsum(k.size) - k.size
                columns = [pa.array(k.ids, mask=k.no_id), pa.array(k.mark == 2), pa.array(k.size), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return chunks.mapInArrow(run, RESULT)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b")).first()["b"]
    n = int(max(8, size // SLICE_OF))
    tokens = materialise(read_tokens(docs, n, key, text), "lm-tokens")
    chunks, asked = tokens.where("kind = 'chunk'"), tokens.where("kind = 'word'")
    counted = materialise(count_words(asked), "lm-words")
    s = statistics(counted)
    unigrams = Unigrams(s, int(s[K + 2]), int(s[K + 3]))
    words = publish(counted.where("kind = 'word'"), "lm-words-by-chunk")
    paired = materialise(count_pairs(ask_pairs(chunks, words, n), unigrams, n), "lm-pairs")
    d = discounts(statistics(paired))
    pairs = publish(paired.where("kind = 'pair'"), "lm-pairs-by-chunk")
    weighed = weigh(asked.select("kind", "chunk", "slice", "keys", "a", "b").union(paired.where("kind = 'history'").select("kind", "chunk", "slice", "keys", "a", "b")), d)
    weights = publish(weighed.where("kind = 'weight'"), "lm-weights-by-chunk")
    out = evaluate(chunks, words, pairs, weights, unigrams, d)
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(unigrams.total).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
