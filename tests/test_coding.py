"""Arithmetic coder, bit streams, tag trees, blocks and packet headers, on their own."""

import random

import numpy as np
import pytest
from tessera.operators import blocks as B, wavelet
from tessera.operators.coding import BitReader, BitWriter, Contexts, MqDecoder, MqEncoder, TagTree, mq_decode, mq_encode
from tessera.sources import markers, rasterfiles as RF


def test_published_sequence():
    """The test sequence of ITU-T T.88, annex H.2."""
    raw, coded = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF"), bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
    bits = [b >> k & 1 for b in raw for k in range(7, -1, -1)]
    coder = MqEncoder(Contexts(1))
    for b in bits:
        coder.put(b, 0)
    assert coder.flush() + b"\xff\xac" == coded
    back = MqDecoder(coded, Contexts(1))
    assert [back.get(0) for _ in bits] == bits


@pytest.mark.parametrize("p", [0.02, 0.5, 0.98])
def test_mq_round_trip(p):
    rng = random.Random(2)
    for n in (0, 1, 2, 17, 3000):
        contexts, bits = [rng.randrange(19) for _ in range(n)], [int(rng.random() < p) for _ in range(n)]
        assert mq_decode(mq_encode(bits, contexts), contexts) == bits


def test_bits_are_stuffed():
    rng = random.Random(3)
    for _ in range(200):
        values = [(rng.choice([0, (1 << k) - 1, rng.randrange(1 << k)]), k) for k in (rng.randrange(1, 12) for _ in range(rng.randrange(40)))]
        out = BitWriter()
        for v, k in values:
            out.put(v, k)
        data = out.flush()
        back = BitReader(data)
        assert [back.get(k) for _, k in values] == [v for v, _ in values]
        assert not any(a == 255 and b > 127 for a, b in zip(data, data[1:])) and data[-1:] != b"\xff"


def test_tag_trees():
    rng = random.Random(4)
    for _ in range(100):
        w, h = rng.randrange(1, 9), rng.randrange(1, 9)
        values = [rng.randrange(6) for _ in range(w * h)]
        tree, out = TagTree(w, h, values), BitWriter()
        for i, v in enumerate(values):
            for t in range(1, v + 2):
                tree.put(out, i % w, i // w, t)
        back, bits = TagTree(w, h), BitReader(out.flush())
        assert [back.leaf(bits, i % w, i // w) for i in range(w * h)] == values


@pytest.mark.parametrize("band", ["LL", "LH", "HL", "HH"])
def test_blocks(band):
    rng = np.random.default_rng(5)
    for k in range(40):
        h, w = rng.integers(1, 20, 2)
        v = np.rint(rng.normal(0, (0.3, 3, 40, 900)[k % 4], (h, w))).astype(np.int64)
        data, planes, passes = B.encode_block(v, band)
        assert np.array_equal(B.decode_block(data, w, h, band, planes, passes), v)
        for drop in range(3, passes, 3):  # whole planes left out
            got = B.decode_block(data, w, h, band, planes, passes - drop)
            assert np.array_equal(np.abs(got), np.abs(v) >> drop // 3 << drop // 3)


def test_norms():
    assert abs(wavelet.basis_norm("5/3", "LL", 1) - 1.5) < 1e-12 and abs(wavelet.basis_norm("5/3", "LL", 2) - 2.75) < 1e-12
    assert abs(wavelet.basis_norm("5/3", "HH", 0) - 0.71875) < 1e-12


def test_cut_off_files():
    whole = markers.write_jp2(b"\xff\x4f\xff\x51", {"w": 3, "h": 2, "depths": [7, 8, 7], "colour_space": 16, "palette": [(1, 2, 3)], "mapping": [(0, 1, c) for c in range(3)], "channels": [(0, 0, 1)]}, [("xml ", b"<a/>")])
    assert markers.codestream_of(whole) == b"\xff\x4f\xff\x51" and {n for n, *_ in markers.box_fields(whole)} == {"ftyp", "ihdr", "bpcc", "colr", "pclr", "cmap", "cdef"}
    for n in range(len(whole)):
        list(markers.box_fields(whole[:n])), list(markers.marker_fields(whole[:n]))
    assert markers.codestream_of(b"") == b"" and list(markers.marker_fields(b"")) == []


@pytest.mark.parametrize(("n", "w", "h"), [(1, 5, 3), (3, 7, 2), (3, 1, 1), (1, 4, 1)])
def test_bmp_and_pam(n, w, h):
    planes = np.random.default_rng(6).integers(0, 256, (n, h, w))
    assert np.array_equal(RF.decode_bmp(RF.encode_bmp(planes))[0], planes) and np.array_equal(RF.decode_pam(RF.encode_pam(planes, 8))[0], planes)
    assert np.array_equal(RF.decode_pam(RF.encode_pam(planes * 16, 12))[0], planes * 16)


def test_reduced_and_truncated_images(spark):
    """Sides of tiles are halved; leaving passes out costs little; every tile size with odd edges comes back."""
    from tessera.operators import codec

    rng = np.random.default_rng(8)
    h, w = 37, 45
    base = (np.add.outer(np.arange(h) * 3, np.arange(w) * 2) + rng.integers(0, 9, (h, w))) % 256
    rows = [(x, y, int(base[y, x]), int(255 - base[y, x]), int(base[y, x] // 2)) for y in range(h) for x in range(w)]
    coded = codec.compress(spark.createDataFrame(rows, "x long, y long, r long, g long, b long"), 8, 16, 2, 8).cache()
    assert sorted(tuple(r) for r in codec.expand(coded, 8).collect()) == sorted(rows)
    for r in (1, 2):
        small = codec.expand(coded, 8, reduce=r)
        assert {(a.x, a.y) for a in small.collect()} == {(x, y) for y in range(-(-h // (1 << r))) for x in range(-(-w // (1 << r)))}
    near = {(a.x, a.y): a.g for a in codec.expand(coded, 8, drop=3).collect()}
    assert 0 < np.mean([abs(near[x, y] - g) for x, y, _, g, _ in rows]) < 6


def test_many_tag_trees_at_once(spark):
    """The same bytes and values as tree by tree; sides of any size, gaps, equal values (bytes of ones)."""
    from tessera.operators import coding

    rng = random.Random(11)
    rows, sizes = [], {}
    for t in range(150):
        w, h, top = rng.randrange(1, 12), rng.randrange(1, 12), rng.choice([1, 2, 9, 40])
        own = [(t, y, x, rng.randrange(top)) for y in range(h) for x in range(w) if rng.random() < rng.choice([0.5, 1, 1])] or [(t, 0, 0, 3)]
        w, h = max(r[2] for r in own) + 1, max(r[1] for r in own) + 1
        grid = [0] * (w * h)
        for _, y, x, v in own:
            grid[y * w + x] = v
        out, tree = coding.BitWriter(), TagTree(w, h, grid)
        for _, y, x, v in own:
            for k in range(1, v + 2):
                tree.put(out, x, y, k)
        sizes[t] = len(out.flush())
        rows += own
    tree, y, x, v = np.array(rows).T
    back, n = coding.code_tag_trees(tree, y, x, v)
    assert np.array_equal(back, v) and n.tolist() == [sizes[t] for t in tree]
    # Groups that end within a batch, at its end and beyond it.
    import pyarrow as pa

    batches = [pa.record_batch({"tree": tree[i : i + 50]}) for i in range(0, len(tree), 50)]
    tables = list(coding.whole_groups(iter(batches), "tree", 120))
    assert len(tables) > 3 and np.array_equal(np.concatenate([a.column("tree").to_numpy() for a in tables]), tree)
    assert all(a.column("tree")[-1] != b.column("tree")[0] for a, b in zip(tables, tables[1:]))


def test_stuffed_at_once():
    from tessera.operators import coding

    rng = random.Random(12)
    strings = [[int(rng.random() < p) for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 90]))] for p in (0.5, 0.95, 1.0) for _ in range(60)]
    data, sizes = coding.stuff(np.array(sum(strings, []), np.uint8), np.array([len(s) for s in strings]))
    at = 0
    for s, n in zip(strings, sizes):
        out = BitWriter()
        for b in s:
            out.put(b)
        assert bytes(data[at : at + n]) == out.flush()
        at += n
    bits, counts, _ = coding.unstuff(data, sizes)
    for s, end, n in zip(strings, np.cumsum(counts), counts):
        assert bits[end - n : end][: len(s)].tolist() == s


def test_many_headers_at_once():
    """The same bytes and fields as precinct by precinct; any number of blocks and layers, empty packets, all lengths of passes."""
    rng = random.Random(13)
    rows, want, sizes = [], [], 0
    for t in range(80):
        n, layers = rng.choice([1, 2, 3, 4, 5, 8, 9, 12, 23]), rng.randrange(1, 7)
        zero = [rng.randrange(12) for _ in range(n)]
        own = [(t, k, i, zero[i], rng.choice([0, 1, 2, 4, 20, 36, 37, 120]) if rng.random() < 0.6 else 0) for k in range(layers) for i in range(n) if rng.random() < 0.9] or [(t, 0, 0, 3, 1)]
        own = [(*r, rng.choice([0, 1, 255, 65535, 400_000]) if r[4] else 0) for r in own]
        rows += own
        n, layers = max(r[2] for r in own) + 1, max(r[1] for r in own) + 1
        w, h = min(n, 4), -(-n // 4)
        grid = [[(0, 0)] * (w * h) for _ in range(layers)]
        planes, first = [0] * (w * h), [layers] * (w * h)
        for _, k, i, z, p, s in own:
            grid[k][i], planes[i] = (p, s), z
            if p:
                first[i] = min(first[i], k)
        out, back = B.Precinct.new(w, h, first, planes), B.Precinct.new(w, h)
        for k in range(layers):
            data = B.write_packet_header(out, k, grid[k])
            sizes += len(data)
            want += [(t, k, i, *f) for i, f in enumerate(B.read_packet_header(back, k, data)[0]) if f[1]]
    written = []
    stuff, B.stuff = B.stuff, lambda *a: written.append(stuff(*a)) or written[-1]
    try:
        got = B.code_headers(*np.array(rows).T)
    finally:
        B.stuff = stuff
    assert sorted(zip(*(c.tolist() for c in got))) == sorted(want)
    assert sum(len(data) for data, _ in written) == sizes


def test_block_coder_in_one_loop():
    """The same bytes and bits as the coder that goes symbol by symbol, and beyond the end of data that is cut off."""
    from tessera.operators import coding

    rng = random.Random(14)
    for n in (0, 1, 2, 300, 5000):
        for p in (0.02, 0.5, 0.98):
            contexts, bits = [rng.randrange(19) for _ in range(n)], [int(rng.random() < p) for _ in range(n)]
            data = coding.block_encode([2 * c + b for c, b in zip(contexts, bits)])
            assert data == mq_encode(bits, contexts)
            for cut in (data, data[: len(data) // 2], b""):
                get = coding.block_reader(cut)
                assert [get(c) for c in contexts] == mq_decode(cut, contexts)


def test_tiles_keep_their_tasks(spark):
    """Tiles are few bytes and long work: both sides of the codec keep all shuffle partitions, where Spark would put small ones together."""
    from tessera.operators import codec

    px = spark.range(64 * 64).selectExpr("id % 64 as x", "id div 64 as y", "id % 251 as r", "id % 7 as g", "id % 13 as b")
    assert codec.expand(codec.compress(px, 8, 16, 2, 8), 8).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
