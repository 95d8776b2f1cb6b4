"""Windows of the decontamination's search: their products with the items, and the checks that their candidates pass."""

import numpy as np
import pytest
from tessera.llm import decontamination as D


def _made(texts):
    raw = [t.encode() for t in texts]
    return D._words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_few_candidates_are_counted_word_by_word(words, monkeypatch):
    """All windows are alike to all items here; those without the item's words are put aside before that count."""
    items = D.benchmark_items([(i, words(30, 90_000 + i), None) for i in range(20)], np.ones((D.TERMS, D.RANK), np.float32))
    leak = words(30, 90_003)
    text, h = _made([words(3000, 91_000), words(300, 91_001) + " " + leak + " " + words(300, 91_002)])
    counted, plain = [], D._bounds
    monkeypatch.setattr(D, "_bounds", lambda h, lo, *rest: (counted.append(len(lo)), plain(h, lo, *rest))[1])
    got = D.matches(text, h, items, np.ones((D.TERMS, D.RANK), np.float32))
    assert {(t, items.ids[i]) for t, i in got} == {(1, 3)}
    assert sum(counted) < 200  # of more than 10,000 windows and items


def test_no_region_holds_more_than_its_marks(words, monkeypatch):
    monkeypatch.setattr(D, "MARKS", 7)
    items = D.benchmark_items([(i, words(12 + i, 92_000 + i), None) for i in range(9)], np.ones((D.TERMS, D.RANK), np.float32))
    _, h = _made([" ".join(words(12 + i, 92_000 + i) for i in range(9)) + " " + words(200, 93_000)])
    place, rng = items.places(h), np.random.default_rng(3)
    lo = rng.integers(0, len(h) - 1, 300)
    hi, item = np.minimum(lo + rng.integers(1, 60, 300), len(h)), rng.integers(0, 9, 300)
    assert (D._held(place, lo, hi, item, items) >= D._bounds(place, lo, hi, item, items)).all()


@pytest.mark.parametrize("many", [5, 64, 4096])
def test_windows_are_those_of_the_plain_products(monkeypatch, many):
    monkeypatch.setattr(D, "WINDOWS", many)
    rng = np.random.default_rng(4)
    blocks, vectors = rng.standard_normal((150, D.RANK)).astype(np.float32), rng.standard_normal((30, D.RANK)).astype(np.float32)
    vectors[3], vectors[20] = blocks[10:15].sum(0), blocks[145:150].sum(0)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    of = {1: (0, 6), 4: (2, 18), 5: (0, 30)}
    starts = {1: np.arange(150), 4: np.arange(0, 147, 3), 5: np.arange(146)}
    got = {(size, int(b), int(i)) for size, block, item in D._alike(blocks, starts, of, vectors) for b, i in zip(block, item)}
    want = set()
    for size, (lo, hi) in of.items():
        for b in starts[size]:
            own = blocks[b : b + size].sum(0)
            want |= {(size, int(b), i) for i in range(lo, hi) if vectors[i] @ own >= D.COSINE * np.linalg.norm(own)}
    assert got == want and {(5, 10, 3), (5, 145, 20)} <= got
