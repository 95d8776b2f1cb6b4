"""N-gram Jaccard self-join, size-aware: light sets by fixed-size subsets, heavy sets by inverted lists.

Equal sets are first collapsed into one representative each. Two different sets with Jaccard t or more have sizes within a
factor t, and differ in at most d = (1 - t) / (1 + t) * (sum of sizes) elements. Sizes fall into classes, each 1/t times the one
before; a set takes part in its own class and the next, so that any two sets that may link meet in one class at least.

- Light sets (classes up to the boundary): all subsets that leave out few enough elements to be shared by any partner, one
  size for each class and set size, are enumerated; linked sets share one of them.
- Heavy sets: elements are dealt by hash into d + 1 + e parts; linked sets agree in 1 + e parts whole at least. A part's content
  is the key of an inverted list, which is scanned for candidates; each set leaves out its e - 1 smallest parts, which is safe,
  for the two largest parts in which two sets agree are never among them: linked sets meet in two lists at least. (Lists of
  single elements would hold a tenth of all documents wherever a passage is shared; lists of whole parts hold mostly near copies.)
- The boundary is the class where enumerating subsets, by the count of sets of each size, stops being cheaper than parts.

In each list, members are paired with the first and with the one before them in the order of names, and linked ones are joined in
components. Lists of more than three members that are still in several components hold all links that are left. Their sets are
scanned by inverted lists of single elements, rare ones first: only elements that several components hold can bring a link, so
a set's other elements come first in its order, and of the rest the one that fewer sets hold. Linked sets share an element
among their first s - ceil(t s) + 1, and how far down it stands bounds what they can have in common; lists are joined by element and
class of size, and only pairs in different components that pass this bound leave the join. Candidates are
verified on their whole sets. Elements are 46-bit hashes and sets are named by 64-bit hashes. No list is gathered: the sorted
keys are read as a stream, the join of a long list may be split over tasks, and each task gives the keys of equal sets once.

A document without words (null and empty texts too) has an empty set and links with nothing. Ids should be unique; rows that
repeat an id and text are one member of the group twice. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import Words, combine, load, materialise, mix, ragged_bytes, slices, text_of
from tessera.llm.components import connected_components

N = 3
#: Jaccard threshold in hundredths.
THRESHOLD = 90
#: Bits of an element's hash.
BITS = 46
#: Cost of a key of an inverted list, with the candidates it brings, against that of a subset.
LIST_COST = 6
#: Names of sets that a task remembers.
SEEN = 1_000_000
#: At most so many ids are broadcast (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000
#: Longs of a parity sketch.
PARITY = 4


def shingle_sets(words: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts one after another, sorted within each, and their bounds."""
    h, first, count = words.hashes(), words.first, words.counts
    size = np.where(count >= n, count - n + 1, (count > 0).astype(int))
    doc = np.repeat(np.arange(len(count)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1], size)
    left = np.minimum(np.repeat(first[1:], size) - at, n)  # words of the shingle
    g = np.full(len(at), 0x51ED270B, np.uint64)
    for k in range(n):
        step = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + k, max(len(h) - 1, 0))]) if len(h) else g
        g = np.where(left > k, step, g)
    g ^= left.astype(np.uint64)
    both = np.sort((doc.astype(np.uint64) << np.uint64(BITS)) | (g >> np.uint64(64 - BITS)))
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    both = both[keep]
    return both & np.uint64((1 << BITS) - 1), np.searchsorted(both, np.arange(len(count) + 1, dtype=np.uint64) << np.uint64(BITS))


def set_names(g: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g ^ np.uint64(salt)))])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


class Scheme:
    """Size classes, and for each whether it is light. t: the threshold in hundredths."""

    def __init__(self, t: int, sizes: dict[int, int]):
        self.t = t
        top = max(sizes, default=1)
        self.upper = [1]
        while self.upper[-1] < top:
            self.upper.append(max(self.upper[-1] + 1, floor(self.upper[-1] * 100 / t)))
        self.upper.append(max(self.upper[-1] + 1, floor(self.upper[-1] * 100 / t)))
        self.boundary = 0
        # Keys that a class's sets would give either way; the boundary is where subsets first cost more.
        for c in range(1, len(self.upper)):
            held = {s: k for s, k in sizes.items() if self.lower(c) < s <= self.upper[c]}
            subsets = sum(k * self.subsets(s, c) for s, k in held.items())
            if subsets > sum(k * (self.differ(c) + 1) for k in held.values()) * LIST_COST:
                break
            self.boundary = c

    def lower(self, c: int) -> int:
        """Sizes of class c and of the one before lie above this."""
        return self.upper[c - 2] if c > 1 else 0

    def differ(self, c: int) -> int:
        """Elements in which two linked sets that meet in class c differ, at most."""
        return floor((100 - self.t) * 2 * self.upper[c] / (100 + self.t))

    def spare(self, c: int) -> int:
        """Parts beyond those that d differences can touch, and one."""
        return max(1, (self.differ(c) + 1) // 4)

    def parts(self, c: int) -> int:
        return self.differ(c) + 1 + self.spare(c)

    def common(self, s: int) -> int:
        """Elements that a set of this size shares with any linked set, at least."""
        return ceil(self.t * s / 100)

    def subset_size(self, c: int) -> int:
        """What any two linked sets of class c share at least: the share of the class's least size."""
        return self.common(self.lower(c) + 1)

    def subsets(self, s: int, c: int) -> int:
        return comb(s, min(s, self.subset_size(c)))

    def class_of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.upper), size)

    def keys(self, g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all sets, odd for subsets and even for parts, and the set of each."""
        size = np.diff(bounds)
        out, who = [], []
        own = self.class_of(size)
        for c in np.unique(np.concatenate([own, own + 1])):
            c = int(c)
            if c < 1 or c >= len(self.upper) or self.differ(c) < 1:
                continue
            sets = np.flatnonzero(((own == c) | (own == c - 1)) & (size > 0))
            if not len(sets):
                continue
            if c <= self.boundary:
                k = self.subset_size(c)
                for i in sets:
                    row = g[bounds[i] : bounds[i + 1]]
                    if len(row) < k:
                        continue
                    chosen = np.array(list(combinations(range(len(row)), k)))
                    out.append((combine([np.full(len(chosen), c, np.uint64), *row[chosen].T]) << np.uint64(1)) | np.uint64(1))
                    who.append(np.full(len(chosen), i))
                continue
            p = self.parts(c)
            index = np.repeat(bounds[sets] - np.cumsum(size[sets]) + size[sets], size[sets]) + np.arange(size[sets].sum())
            row, element = np.repeat(np.arange(len(sets)), size[sets]), g[index]
            part = (mix(element + np.uint64(c)) % np.uint64(p)).astype(np.int64)
            slot = row * p + part
            # Sums over a part are its content: order doesn't matter, and 64 mixed bits of each element are added up.
            sums = np.zeros(len(sets) * p, np.uint64)
            np.add.at(sums, slot, mix(element ^ np.uint64(0xA5A5A5A5DEADBEEF)))
            number = np.tile(np.arange(p), len(sets))
            held = np.bincount(slot, minlength=len(sets) * p).reshape(len(sets), p)
            rank = np.argsort(np.argsort(held * p + np.arange(p), axis=1), axis=1).reshape(-1)
            keep = rank >= self.spare(c) - 1
            out.append(combine([np.full(int(keep.sum()), c + (1 << 20), np.uint64), number[keep].astype(np.uint64), sums[keep]]) << np.uint64(1))
            who.append(np.repeat(sets, p)[keep])
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(who)


def members(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """key, n_shingles and the hash of the whole set, for each document."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("body")):
                g, bounds = shingle_sets(Words(buf, offsets), n)
                names = [pa.array(set_names(g, bounds, salt)) for salt in (0x1234567F, 0x77777)]
                yield pa.RecordBatch.from_arrays([batch.column("key")[lo:hi].cast(pa.int64()), pa.array(np.diff(bounds)), *names], names=["key", "n_shingles", "set_a", "set_b"])

    return text_of(docs, key, text).mapInArrow(run, "key long, n_shingles long, set_a long, set_b long")


def _keyed(docs: DataFrame, scheme: Scheme, n: int) -> DataFrame:
    """sig, node: the keys of each set; equal sets of a task give theirs once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column("body")):
                g, bounds = shingle_sets(Words(buf, offsets), n)
                nodes = set_names(g, bounds, 0x1234567F)
                new = np.zeros(len(nodes), bool)
                for i, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        new[i] = True
                        seen.add(node)
                if len(seen) > SEEN:
                    seen.clear()
                if not new.all():
                    keep = np.repeat(new, np.diff(bounds))
                    g, bounds, nodes = g[keep], np.concatenate([[0], np.cumsum(np.diff(bounds)[new])]), nodes[new]
                keys, who = scheme.keys(g, bounds)
                for a in range(0, len(keys), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 200_000].view(np.int64)), pa.array(nodes[who[a : a + 200_000]])], names=["sig", "node"])

    return docs.mapInArrow(run, "sig long, node long")


def scan_lists(keyed: DataFrame) -> DataFrame:
    """sig, node, lead (the least node) and prev (the node before) for lists with two different nodes or more, from one pass over the sorted keys."""

    def run(batches):
        sig = node = lead = None  # of the last row
        told = True
        for batch in batches:
            s, x = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
            if sig is not None:
                s, x = np.concatenate([[sig], s]), np.concatenate([[node], x])
            if not len(s):
                continue
            head = np.ones(len(s), bool)
            head[1:] = s[1:] != s[:-1]
            again = np.zeros(len(s), bool)
            again[1:] = ~head[1:] & (x[1:] == x[:-1])
            place = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
            leads = x[place]
            if sig is not None:
                leads[place == 0] = lead
            member = ~head & ~again & (x != leads)
            first = np.zeros(len(s), bool)  # leads whose list turns out to have others
            first[np.unique(place[member])] = True
            if sig is not None:
                member[0] = False
                first[0] = first[0] and not told
            told = bool((told and place[-1] == 0 and sig is not None) or first[place[-1]])
            prev = np.concatenate([x[:1], x[:-1]])
            out = [np.concatenate(c) for c in ((s[first], s[member]), (leads[first], x[member]), (leads[first], leads[member]), (leads[first], prev[member]))]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["sig", "node", "lead", "prev"])
            sig, node, lead = s[-1], x[-1], leads[-1]

    return keyed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "sig long, node long, lead long, prev long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """node, size, parity sketch, and the set as sorted 64-bit numbers. docs: key and body."""

    def run(batches):
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column("body")):
                g, bounds = shingle_sets(Words(buf, offsets), n)
                size = np.diff(bounds)
                slot = np.repeat(np.arange(len(size)), size) * (64 * PARITY) + (mix(g ^ np.uint64(0x0DD)) % np.uint64(64 * PARITY)).astype(np.int64)
                odd = (np.bincount(slot, minlength=len(size) * 64 * PARITY) & 1).astype(np.uint8).reshape(len(size), PARITY, 64)
                sketch = np.packbits(odd, axis=-1).view(np.int64).reshape(len(size), PARITY)
                yield pa.RecordBatch.from_arrays([pa.array(set_names(g, bounds, 0x1234567F)), pa.array(size), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(PARITY)), ragged_bytes(g, bounds)], names=["node", "size", *(f"p{i}" for i in range(PARITY)), "grams"])

    return docs.mapInArrow(run, "node long, size long, " + ", ".join(f"p{i} long" for i in range(PARITY)) + ", grams binary")


def _verify(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link."""

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(p, q)
                shared = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                good[i] = 100 * shared >= t * (len(p) + len(q) - shared)
            keep = np.flatnonzero(good)
            if len(keep):
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], names=["a", "b"])

    # Sketches first, for they are short; few pairs that don't link get past them.
    names = ["size", *(f"p{i}" for i in range(PARITY))]
    p, q = (sets.select(F.col("node").alias(c), F.struct(*names).alias(s)) for c, s in (("a", "p"), ("b", "q")))
    able = pairs.join(p, "a").join(q, "b").where(_near(t)).select("a", "b")
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return able.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near(t: int) -> str:
    """Whether the sketches p and q differ in no more bits than linked sets of their sizes differ in elements."""
    bits = " + ".join(f"bit_count(p.p{i} ^ q.p{i})" for i in range(PARITY))
    return f"({bits}) * {100 + t} <= {100 - t} * (p.size + q.size)"


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """key, n_shingles, class_id (least id with an equal set) and component_id (least id that links reach)."""
    base = materialise(members(docs, key, text, n), "members")
    full = base.where("n_shingles > 0 and key is not null")
    # One row for each distinct set.
    classes = materialise(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "classes")
    sizes = {r["n_shingles"]: r["count"] for r in classes.groupBy("n_shingles").count().collect()}  # a histogram of sizes
    lists = materialise(scan_lists(_keyed(text_of(docs, key, text).where("key is not null"), Scheme(threshold, sizes), n)), "lists")
    return _result(base, classes, _links(lists, classes, text_of(docs, key, text), n, threshold), key)


def _links(lists: DataFrame, classes: DataFrame, docs: DataFrame, n: int, t: int) -> DataFrame | None:
    """node, component over the sets that have links; None if no list holds two sets."""
    near = lists.select(F.col("node").alias("set_a")).distinct()
    ids = materialise(classes.join(near, "set_a", "left_semi").select(F.col("rep").alias("key")), "near")
    many = ids.count()
    if not many:
        return None
    sets = materialise(_sets(docs.join(F.broadcast(ids) if many <= BROADCAST_IDS else ids, "key", "left_semi"), n).dropDuplicates(["node"]), "sets")
    pairs = lists.where("node != lead").select(F.inline(F.array(F.struct(F.col("lead").alias("a"), F.col("node").alias("b")), F.struct(F.col("prev").alias("a"), F.col("node").alias("b")))))
    tested = materialise(pairs.distinct(), "pairs")
    links = materialise(_verify(tested, sets, t), "links")
    found = materialise(connected_components(links), "found")
    rest = materialise(_crossing(_open(lists, found), sets, t).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = materialise(_verify(rest, sets, t), "links")
    if more.isEmpty():
        return found
    # Components so far stand for their links.
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """node, component of the members of lists of more than three (of others all pairs were tested) that are in several components."""
    labelled = lists.select("sig", "node").join(found, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo != hi and m > 3")
    return materialise(labelled.join(several.select("sig"), "sig").select("node", "component").distinct(), "open")


def _elements(owners: DataFrame) -> DataFrame:
    """element, node, component, size: one row for each element of each set."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column("grams")):
                n = np.diff(offsets) // 8
                same = [pa.array(np.repeat(batch.column(c)[lo:hi].to_numpy(), n)) for c in ("node", "component", "size")]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(buf.tobytes(), np.int64)), *same], names=["element", "node", "component", "size"])

    return owners.mapInArrow(run, "element long, node long, component long, size long")


def _crossing(unsettled: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that may link, from inverted lists of elements in rare-first order."""
    owners = unsettled.join(sets.select("node", "size", "grams"), "node")
    elements = _elements(owners)
    held = elements.groupBy("element").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("f")).where("lo != hi").select("element", "f")
    first = f"size - ceil({t} * size / 100) + 1"
    ordered = elements.join(held, "element").groupBy("node", "component", "size").agg(F.array_sort(F.collect_list(F.struct("f", "element"))).alias("own"))
    # Elements of one component alone stand before all others, so place j among the others is place size - size(own) + j of the set.
    placed = ordered.withColumn("before", F.expr("size - size(own)")).where(f"before < {first}")
    entries = placed.select("node", "component", "size", "before", F.posexplode(F.expr(f"slice(own, 1, cast({first} - before as int))")).alias("j", "e"))
    entries = materialise(entries.select(F.col("e.element").alias("element"), "node", "component", "size", F.expr("before + j").alias("place")), "entries")
    # Of two linked sets, the smaller one shares an element among its first size - ceil(2 t size / (100 + t)) + 1. Sizes that link are a class apart at most.
    step = f"cast(floor(ln(size) / ln({100 / t!r}) + 1e-9) as int)"
    p = entries.where(f"place < size - ceil({2 * t} * size / {100 + t}) + 1").withColumn("class", F.explode(F.expr(f"array({step}, {step} + 1, {step} + 2)"))).alias("p")
    q = entries.withColumn("class", F.expr(step)).alias("q")
    able = f"""p.element = q.element and p.class = q.class and p.component != q.component and (p.size < q.size or p.size = q.size and p.node < q.node)
        and 100 * p.size >= {t} * q.size and least(p.size - p.place, q.size - q.place) * {100 + t} >= {t} * (p.size + q.size)"""
    both = p.join(q, F.expr(able)).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
    return both.distinct()


def _result(base: DataFrame, classes: DataFrame, found: DataFrame | None, key: str) -> DataFrame:
    grouped = classes.withColumn("least", F.col("rep"))
    if found is not None:
        named = classes.join(found, classes["set_a"] == found["node"]).select("set_a", "set_b", "rep", "component")
        least = named.groupBy("component").agg(F.min("rep").alias("least"))
        linked = named.join(least, "component").select("set_a", "set_b", F.col("least").alias("reached"))
        grouped = classes.join(linked, ["set_a", "set_b"], "left").withColumn("least", F.coalesce("reached", "rep")).drop("reached")
    # Only sets that stand for several documents, or are linked, need the join; a set's copies may be split over tasks (AQE).
    wanted = grouped.where("copies > 1 or least != rep").select("set_a", "set_b", "n_shingles", "rep", "least")
    out = base.join(wanted, ["set_a", "set_b", "n_shingles"], "left")
    some = F.col("n_shingles") > 0
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce(F.when(some, F.col("rep")), "key").alias("class_id"), F.coalesce(F.when(some, F.col("least")), "key").alias("component_id"))


def keep(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group that links reach: that with the least id, rows without id last; of equal rows any one. Rows without words all stay.

    Rows go by a 64-bit hash of id and text, so rows without id, or with one id and different texts, are judged like others.
    """
    name, columns = "row_name", docs.columns
    while any(c.startswith(name) for c in columns):
        name += "_"
    named = docs.withColumn(name, F.xxhash64(key, text))
    groups = components(named, name, text, n, threshold).where("n_shingles > 0")
    rows = materialise(groups.groupBy(F.col(name).alias("row"), "component_id").agg(F.count("*").alias("copies")), "group-rows")
    # A group's head stands for it by name; whether it has others is asked by row, so no large group meets in one task.
    heads = rows.where("row != component_id").select(F.col("component_id").alias("row")).distinct()
    members = materialise(rows.where("row != component_id or copies > 1").unionByName(rows.where("row = component_id and copies = 1").join(heads, "row", "left_semi")), "group-members")
    ids = named.select(F.col(name).alias("row"), F.col(key).alias("id")).join(members.select("row"), "row", "left_semi").groupBy("row").agg(F.min("id").alias("id"))
    first = members.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("best"))
    kept = materialise(first.select(F.col("best.row").alias("row")).join(members, "row").select("row", "copies"), "group-heads")
    gone = materialise(members.select("row").join(kept.select("row"), "row", "left_anti"), "group-rest")
    out = _at(named, name, gone, "left_anti")
    again = materialise(kept.where("copies > 1").select("row"), "group-copies")
    if not again.isEmpty():
        out = _at(out, name, again, "left_anti").unionByName(_at(named, name, again, "left_semi").dropDuplicates([name]))
    return out.select(columns)


def _at(docs: DataFrame, name: str, rows: DataFrame, how: str) -> DataFrame:
    """The docs whose name is (left_semi) or isn't (left_anti) among rows."""
    rows = rows.select(F.col("row").alias(f"{name}_wanted"))
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, F.col(name) == F.col(f"{name}_wanted"), how)


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
