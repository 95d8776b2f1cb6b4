import zlib
from collections import Counter

import numpy as np
import pytest
from tessera.llm import packing, token_counts
from tessera.llm.tokens import tokenizer_path
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(tokenizer_path())


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def rows(words, odd):
    return [(i, words(20 * i + 1, i)) for i in range(25)] + odd + [(30, words(12_000, 99)), (31, "A <|endoftext|> b<|ENDOFTEXT|>c"), (3, words(61, 3))]


def test_pieces_hold_every_id_once(make, rows):
    got = packing.digest(packing.pack(make(rows), window=256)).collect()
    want = Counter((i, len(ids(t)) + 1) for i, t in rows)
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    at = sorted((r.sequence_id, r.offset, r.length) for r in got)
    place = 0
    for s, o, n in at:
        assert s * 256 + o == place and o + n <= 256
        place += n
    assert place == sum(len(ids(t)) + 1 for _, t in rows)
    for i, t in rows:
        if sum(x == i for x, _ in rows) == 1:
            own = [*ids(t), 2]
            pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
            for r in pieces:
                assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())


def test_nothing_to_pack(make):
    assert packing.pack(make([])).count() == 0
    assert token_counts.histogram(token_counts.lengths(make([]))).count() == 0


def test_histogram(make, rows):
    n = [len(ids(t)) for _, t in rows]
    hist = token_counts.histogram(token_counts.lengths(make(rows))).cache()
    got = {r.n_tokens: r for r in hist.collect()}
    assert set(got) == set(n)
    for x, r in got.items():
        assert r.n_docs == n.count(x) and r.docs_at_least == sum(v >= x for v in n) and r.tokens_at_least == sum(v for v in n if v >= x)
        assert r.docs_below == sum(v < x for v in n) and r.truncated_tokens == sum(min(v, x) for v in n)
        assert r.share_not_longer == pytest.approx(sum(v <= x for v in n) / len(n))
    for r in token_counts.at_limit(hist, [1, 100, 10**6]).collect():
        assert (r.docs, r.tokens, r.docs_cut, r.truncated_tokens) == (len(n), sum(n), sum(v > r.context_limit for v in n), sum(min(v, r.context_limit) for v in n))
    half = token_counts.quantile(hist, [0.5, 1.0]).collect()
    assert half[0].n_tokens == sorted(n)[-(-len(n) // 2) - 1] and half[1].n_tokens == max(n)
