import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import compare, packets, point, select, tiles, wavelet
from tessera.plans.profiles import EncoderParameters, cinema
from tessera.sources import codestream, rasterfiles


def grid(spark, a):
    h, w = a.shape
    return spark.createDataFrame([(0, 0, y, x, int(a[y, x])) for y in range(h) for x in range(w)], "image_id long, comp int, y long, x long, v long")


@pytest.mark.parametrize(("src", "dst", "values", "want"), [
    ((1000, 5000), (0, 255), [1000, 3000, 5000, 9000], [0, 128, 255, 255]), ((0, 1000), (-128, 127), [0, 1000], [-128, 127]), ((0, 255), (255, 0), [0, 255, 100], [255, 0, 155]),
])
def test_rescale(spark, src, dst, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long")
    assert [r.v for r in point.rescale(df, src, dst).orderBy("i").collect()] == want
    with pytest.raises(ValueError):
        point.rescale(df, (5, 5), dst)


def test_rescaled_precision():
    assert point.rescaled_precision(-128, 127) == (8, True) and point.rescaled_precision(0, 255) == (8, False)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (8, 1), (2, 2), (7, 5), (16, 13)])
def test_wavelets_invert(spark, shape):
    a = np.random.default_rng(sum(shape)).integers(-500, 500, shape)
    df, keys = grid(spark, a), ["image_id", "comp"]
    low = wavelet.forward_2d(df, keys)
    coded = {(r.y, r.x): r.v for r in low.collect()}
    block = wavelet.block_dwt53(a.astype(np.int64))
    assert all(block[y, x] == v for (y, x), v in coded.items())
    assert {(r.y, r.x): r.v for r in wavelet.inverse_2d(low, keys).collect()} == {(y, x): int(a[y, x]) for y in range(shape[0]) for x in range(shape[1])}
    back = wavelet.inverse_2d(wavelet.forward_2d(df.withColumn("v", F.col("v").cast("double")), keys, wavelet.dwt97), keys, wavelet.idwt97)
    assert all(abs(r.v - a[r.y, r.x]) < 1e-6 for r in back.collect())


def test_region_of_inverse_is_crop(spark):
    a = np.random.default_rng(1).integers(0, 255, (61, 67))
    keys = ["image_id", "comp"]
    got = wavelet.inverse_region(wavelet.forward_2d(grid(spark, a), keys), keys, (14, 15, 40, 61), (67, 61))
    assert {(r.y, r.x): r.v for r in got.collect()} == {(y, x): int(a[y, x]) for y in range(15, 61) for x in range(14, 40)}


def test_regions():
    assert select.region_bounds((0, 0, 1, 1), 100, 50) == (0, 0, 100, 50)
    assert select.region_bounds((0.25, 0.25, 0.3, 0.3), 10, 10) == (2, 2, 3, 3)
    assert select.region_bounds((3, 4, 500, 20), 100, 50) == (3, 4, 100, 20)
    with pytest.raises(ValueError):
        select.region_bounds((100, 0, 120, 10), 100, 50)


def test_every_progression_holds_every_packet_once(spark):
    p = spark.createDataFrame([(0, i, i % 3, i // 3 % 4, i // 12 % 2, i // 24, 64 * (i // 96), 64 * (i // 24 % 4), 10 + i) for i in range(240)], "tile long, k long, comp long, res long, layer long, precinct long, py long, px long, length long")
    for order in packets.ORDERS:
        out = packets.transcode(p, order).orderBy("seq").collect()
        assert [r.seq for r in out] == list(range(240)) and sorted(r.k for r in out) == list(range(240))
        assert [r.offset for r in out] == list(np.cumsum([0, *(r.length for r in out)])[:-1])
        assert sorted(tuple(r[c] for c in packets.ORDERS[order]) for r in out) == [tuple(r[c] for c in packets.ORDERS[order]) for r in out]


def test_swath_spacing(spark):
    a = np.arange(12).reshape(3, 4) * 40
    got = {r.place: r.v for r in tiles.swath(grid(spark, a), (1, 0, 3, 2), [1, 1], "u8", (2, 4, 1)).collect()}
    assert got == {0: 40, 1: 40, 2: 80, 3: 80, 4: 200, 5: 200, 6: 240, 7: 240}


def test_compare_sees_missing(spark):
    a = np.arange(9).reshape(3, 3)
    r = compare.compare(grid(spark, a), grid(spark, a + (a == 4)).where("y < 2")).first()
    assert (r.differ, r.peak, r.unmatched) == (1, 1, 3) and r.mse == pytest.approx(1 / 6)


def test_channel_swap(spark):
    df = spark.createDataFrame([(c, c * 10) for c in range(3)], "comp int, v long")
    assert sorted((r.comp, r.v) for r in point.swap_channels(df, [(0, 3), (1, 2), (2, 1)]).collect()) == [(0, 20), (1, 10), (2, 0)]


def test_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    for n, prec in ((1, 8), (3, 8), (3, 12), (1, 16)):
        planes = rng.integers(0, 1 << prec, (n, 5, 7))
        assert (rasterfiles.decode_pnm(rasterfiles.encode_pnm(planes, prec))[0] == planes).all()
        assert (rasterfiles.unpack_bits(rasterfiles.pack_bits(planes.reshape(-1), prec), prec, planes.size) == planes.reshape(-1)).all()
        assert (rasterfiles.decode_raw(rasterfiles.encode_raw(planes, prec, False, False), n, 7, 5, prec, False, False) == planes).all()
    plane = rng.integers(-2000, 2000, (4, 6))
    back, prec, signed = rasterfiles.decode_pgx(rasterfiles.encode_pgx(plane, 12, True))
    assert (back == plane).all() and (prec, signed) == (12, True)
    spark.dataSource.register(rasterfiles.FileSink)
    from tessera.functions.workers import ship

    ship(spark)
    df = grid(spark, np.arange(20).reshape(4, 5))
    rasterfiles.to_files(df, 8).write.format("files").mode("append").save(str(tmp_path / "out"))
    again = rasterfiles.read_samples(codestream.read_files(spark, str(tmp_path / "out"), "*.pgm"))
    assert sorted((r.y, r.x, r.v) for r in again.collect()) == [(y, x, y * 5 + x) for y in range(4) for x in range(5)]


def test_headers():
    info = {"x0": 3, "y0": 1, "x1": 103, "y1": 51, "tx0": 0, "ty0": 0, "tw": 64, "th": 64, "order": "RPCL", "layers": 4, "mct": 1, "numres": 6, "irreversible": True, "sop": True, "eph": False, "cblkw": 64, "cblkh": 32, "numcomps": 2}
    info["components"] = [{"prec": 8, "sgnd": False, "dx": 1, "dy": 1}, {"prec": 12, "sgnd": True, "dx": 2, "dy": 2}]
    data = codestream.write_header(info)
    assert codestream.header(data) == info
    assert codestream.header(data[:30]) is None and list(codestream.scan(b"")) == []
    tree = codestream.box("jp2h", codestream.box("ihdr", b"12345678") + codestream.box("colr", b"x")) + codestream.box("jp2c", data)
    assert [(lv, k) for lv, k, _, _ in codestream.boxes(tree)] == [(0, "jp2h"), (1, "ihdr"), (1, "colr"), (0, "jp2c")]
    assert list(codestream.boxes(tree[:5])) == []


def test_profiles():
    assert EncoderParameters().problems() == [] and EncoderParameters(cblkw=48, layers=300).problems()
    good = EncoderParameters(numres=6, cblkw=32, cblkh=32, order="CPRL", irreversible=True, max_bytes=1_000_000)
    assert cinema(good, 2048, 1080, 3, 12) == [] and "12 bits" in cinema(good, 2048, 1080, 3, 8)


def test_stream_equals_batch(spark, tmp_path):
    from tessera.functions.workers import ship
    from tessera.streaming.bands import completed_rows, in_order

    ship(spark)
    rows = [(i % 4, (i // 4 * 3) % 5, i) for i in range(20)] + [(0, 0, 50), (9, 1, 51)]
    for n in range(0, len(rows), 6):
        spark.createDataFrame(rows[n : n + 6], "row long, tile long, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got: dict[int, int] = {}
    order: list[int] = []
    drain = in_order(lambda row, at: order.append(row))

    def take(batch, number):
        batch = batch.persist()
        for r in batch.collect():
            assert r.row not in got
            got[r.row] = r.at
        drain(batch, number)

    stream = spark.readStream.schema("row long, tile long, at long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = completed_rows(stream, 5).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = {r.row: r.at for r in tiles.row_completion(spark.createDataFrame(rows, "row long, tile long, at long"), 5).collect()}
    assert set(got) == set(want) and order == sorted(order) == [0, 1, 2, 3]
