from collections import defaultdict

import numpy as np
import pytest
from tessera.llm import jaccard_join
from tessera.llm.common import Words


def sets(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, n, t):
    own = sets(rows, n)
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in own if own[i] and i is not None]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(own[a] & own[b]) >= t * len(own[a] | own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in own}


@pytest.mark.parametrize(("n", "t"), [(3, 90), (5, 80)])
def test_components_are_exact(make, words, odd, n, t):
    rng = np.random.default_rng(5)
    rows, number = list(odd), 1000
    for size in (4, 8, 11, 12, 13, 14, 22, 40, 90, 200):
        for copy in range(3):
            base = words(size, size * 10 + copy).split()
            for _ in range(9):
                w = list(base)
                for _ in range(rng.integers(0, max(2, size // 30) + 1)):
                    w[rng.integers(len(w))] = f"new{rng.integers(10**6)}"
                cut = int(rng.integers(0, 3))
                rows.append((number, " ".join(w[cut:])))
                number += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(make(rows), n=n, threshold=t).collect()}
    assert got == brute(rows, n, t)


def test_chain_of_near_copies(make, words):
    """Each links with the next only: one long list of different sets, joined by many links."""
    w = words(300, 1).split()
    rows = [(i, " ".join([f"x{j}" for j in range(i)] + w[i:])) for i in range(60)]
    got = {r.doc_id: r.component_id for r in jaccard_join.components(make(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 90).items()} and set(got.values()) == {0}


@pytest.mark.parametrize(("n", "t", "most"), [(3, 90, 5), (5, 80, 6)])
def test_dense_group_with_few_links(make, words, n, t, most):
    """Many sets that share most of their elements, of which some link: lists that stay in several components."""
    rng, base, rows = np.random.default_rng(11), words(150, 5).split(), []
    for i in range(140):
        w = list(base)
        for at in rng.choice(len(w), rng.integers(1, most), replace=False):
            w[at] = f"new{rng.integers(10**6)}"
        rows.append((i, " ".join(w[int(rng.integers(0, 4)) :])))
    got = {r.doc_id: r.component_id for r in jaccard_join.components(make(rows), n=n, threshold=t).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, n, t).items()} and 1 < len(set(got.values())) < 140


def test_empty(make):
    assert jaccard_join.components(make([])).count() == 0
    assert [tuple(r) for r in jaccard_join.components(make([(5, None), (6, "")])).select("doc_id", "n_shingles", "component_id").orderBy("doc_id").collect()] == [(5, 0, 5), (6, 0, 6)]


def test_any_linked_pair_shares_a_key():
    rng = np.random.default_rng(1)
    for t in (80, 90):
        scheme = jaccard_join.Scheme(t, {s: 10 for s in range(1, 400)})
        for _ in range(300):
            a = int(rng.integers(5, 300))
            both = int(rng.integers(max(1, a * t // 100), a + 1))
            most = both * 100 // t - a
            b = both + int(rng.integers(0, max(0, most) + 1))
            pool = np.unique(rng.integers(0, 1 << 46, a + b, dtype=np.uint64))[: a + b - both]
            rng.shuffle(pool)
            x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:both], pool[a:]]))
            if 100 * both < t * (len(x) + len(y) - both) or np.array_equal(x, y):
                continue
            keys, who = scheme.keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_words_split_like_bytes():
    texts = ["", " ", "a", "a b\tc\x0bd", "é x", "ab", "\x1cnot\x1fspace", "tail "]
    raw = [x.encode() for x in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert list(w.counts) == [len(r.split()) for r in raw]
    flat = [(x, int(h)) for x, h in zip((y for r in raw for y in r.lower().split()), w.hashes(), strict=True)]
    by = defaultdict(set)
    for x, h in flat:
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({h for _, h in flat}) == len(by)
