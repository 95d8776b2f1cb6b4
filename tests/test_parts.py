"""Files in parts of a fixed size: the parts are the whole file, each is small, and each can be read alone."""

import os

import numpy as np
import pytest
from tessera import catalog
from tessera.sources import codestream, rasterfiles as RF

DATA = os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001")
WHOLE = {"pnm": RF.encode_pnm, "pam": RF.encode_pam, "bmp": lambda planes, prec: RF.encode_bmp(planes)}


def samples(spark, planes, image=0):
    n, h, w = planes.shape
    return spark.createDataFrame([(image, c, y, x, int(planes[c, y, x])) for c in range(n) for y in range(h) for x in range(w) if planes[c, y, x]], "image_id long, comp int, y long, x long, v long")


def check(spark, kind, n, prec):
    planes = np.random.default_rng(n).integers(0, 1 << prec, (n, 9, 7))
    planes[:, 2:6] = 0  # lines without samples: whole parts have none
    planes[-1, -1, -1] = 1
    parts = RF.to_parts(samples(spark, planes), prec, kind=kind)
    rows = sorted(parts.collect(), key=lambda r: r.start)
    assert b"".join(bytes(r.content) for r in rows) == WHOLE[kind](planes, prec)
    assert len(rows) > 3 and max(len(r.content) - (len(r.head) if not r.start else 0) for r in rows) <= RF.PART
    got = RF.read_samples(parts.withColumnRenamed("name", "path")).collect()
    assert sorted((r.comp, r.y, r.x, r.v) for r in got) == [(c, y, x, planes[c, y, x]) for c in range(n) for y in range(9) for x in range(7)]


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(RF, "PART", 16)


@pytest.mark.parametrize(("n", "prec"), [(1, 8), (3, 8), (3, 12)])
def test_pnm(spark, small_parts, n, prec):
    check(spark, "pnm", n, prec)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_pam(spark, small_parts, n):
    check(spark, "pam", n, 8)


@pytest.mark.parametrize("n", [1, 3])
def test_bmp(spark, small_parts, n):
    check(spark, "bmp", n, 8)


@pytest.mark.parametrize("name", ["pnm_roundtrip", "pam_roundtrip", "bmp_roundtrip", "split_components"])
def test_no_task_holds_an_image(spark, small_parts, name):
    """The query's file is cut, so it isn't one group's work."""
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def test_sink_takes_parts(spark, small_parts, tmp_path):
    spark.dataSource.register(RF.FileSink)
    a, b = (np.random.default_rng(i).integers(1, 256, (1 + 2 * i, 6, 5)) for i in (0, 1))
    both = samples(spark, a).unionByName(samples(spark, b, 7))
    RF.to_files(both, 8).write.format("files").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "0.pgm").read_bytes() == RF.encode_pnm(a, 8) and (tmp_path / "out" / "7.ppm").read_bytes() == RF.encode_pnm(b, 8)
    again = RF.read_samples(codestream.read_files(spark, str(tmp_path / "out"), "*.p?m")).collect()
    assert len(again) == a.size + b.size and sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["0.pgm", "7.ppm"]


def test_many_images(spark, small_parts, monkeypatch):
    """Sizes of more images than come to the driver."""
    monkeypatch.setattr(RF, "MANY_IMAGES", 1)
    a, b = (np.random.default_rng(i).integers(1, 256, (1, 6, 5 + i)) for i in (0, 1))
    parts = RF.to_parts(samples(spark, a).unionByName(samples(spark, b, 7)), 8).withColumnRenamed("name", "path")
    got = RF.read_samples(parts).collect()
    assert sorted((r.path, r.y, r.x, r.v) for r in got) == sorted((f"{k}.pgm", y, x, p[0, y, x]) for k, p in ((0, a), (7, b)) for y in range(6) for x in range(p.shape[2]))
