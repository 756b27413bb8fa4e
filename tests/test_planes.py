"""Raw planes as a data source: ranges of one file, writes that happen whole or not at all."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid.sources import planes, raw
from tests.test_tracking import texture


def test_a_file_is_read_in_ranges_of_columns(spark, tmp_path):
    v = texture(70, 90, 1).astype("<f4")
    v[3, 4], v[60, 89] = np.nan, np.inf
    for name in ("a", "b"):
        (tmp_path / f"{name}.bin").write_bytes((v if name == "a" else v + 1).tobytes(order="F"))
    got = planes.scan_planes(spark, str(tmp_path), 70, 90, range_bytes=4 * 70 * 7)
    assert got.rdd.getNumPartitions() == 2 * 13
    largest = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert largest == 7 * 70  # a task holds its range, not the file
    rows = got.collect()
    assert len(rows) == 2 * v.size and {r.image_id for r in rows} == {"a", "b"}
    for r in rows:
        x = float(v[r.r - 1, r.c - 1]) if r.image_id == "a" else float((v + 1)[r.r - 1, r.c - 1])
        assert r.valid == bool(np.isfinite(x)) and (r.v == x if r.valid else r.v is None)
    one = planes.scan_planes(spark, str(tmp_path / "a.bin"), 70, 90, "own")
    key = lambda df: {(r.r, r.c): (r.v, r.valid) for r in df.collect()}
    assert key(one) == key(raw.read_raw(spark, str(tmp_path / "a.bin"), 70, 90)) and one.first().image_id == "own"


def test_other_sizes_and_paths_are_errors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\0" * 40)
    for path, ny, nx in ((tmp_path / "a.bin", 3, 3), (tmp_path / "none.bin", 2, 5)):
        with pytest.raises(Exception, match="bytes|no "):
            planes.scan_planes(spark, str(path), ny, nx).count()
    (tmp_path / "b.bin").write_bytes(b"\0" * 40)
    with pytest.raises(Exception, match="image_id"):
        planes.scan_planes(spark, str(tmp_path), 2, 5, "x").count()
    assert planes.scan_planes(spark, str(tmp_path), 2, 5).count() == 20


def rows(spark, n, bad=None):
    names = [(f"p{k}" if k != bad else "no/name", bytes([k]) * 8, bytes([k + 1]) * 4) for k in range(n)]
    return spark.createDataFrame(names, "pair_id string, dx binary, dy binary").repartition(n)


def test_a_write_is_whole_or_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    planes.write_planes(rows(spark, 4), out)
    assert sorted(os.listdir(out)) == [f"p{k}.bin" for k in range(4)] and (tmp_path / "out/p2.bin").read_bytes() == b"\2" * 8 + b"\3" * 4
    with pytest.raises(Exception, match="name of a file"):
        planes.write_planes(rows(spark, 8, bad=5), str(tmp_path / "failed"))
    assert not (tmp_path / "failed").exists() or os.listdir(tmp_path / "failed") == []
    with pytest.raises(Exception, match="several rows"):
        planes.write_planes(rows(spark, 3).union(rows(spark, 2)), str(tmp_path / "twice"))
    assert not (tmp_path / "twice").exists() or os.listdir(tmp_path / "twice") == []
    planes.write_planes(rows(spark, 2), out, overwrite=True)
    assert sorted(os.listdir(out)) == ["p0.bin", "p1.bin"]


def test_results_are_laid_out_by_pair(spark, tmp_path):
    field = spark.createDataFrame([("a", i, j, float(i), None if i == j else float(j), 0.5) for i in (1, 2) for j in (1, 2, 3)], "pair_id string, gi int, gj int, dx double, dy double, correlation double")
    names = raw.write_raw(field, (2, 3), str(tmp_path)).collect()
    got = np.frombuffer(open(names[0].path, "rb").read(), "<f4").reshape(3, 3, 2).transpose(0, 2, 1)
    assert [r.pair_id for r in names] == ["a"] and got[0].tolist() == [[1, 1, 1], [2, 2, 2]] and np.isnan(got[1][0, 0]) and got[1][0, 1] == 2


def test_a_pair_is_laid_out_in_parts(spark, tmp_path, monkeypatch):
    """No task holds a pair's planes: parts of bounded size, NaN where a part or a place is missing, whatever order rows come in."""
    monkeypatch.setattr(raw, "PART", 16)
    grid = (7, 12)
    v = texture(*grid, 2).astype("<f4")
    held = lambda p, i, j: (i + 5 * j) % 7 > 0 and not (p == "a" and 2 <= j <= 8)
    rows = [(p, i + 1, j + 1, float(v[i, j]), float(-v[i, j]), 0.5) for p in "ab" for i in range(7) for j in range(12) if held(p, i, j)]
    field = spark.createDataFrame(rows, "pair_id string, gi int, gj int, dx double, dy double, correlation double")
    parts = raw.plane_parts(field, grid)
    assert max(len(r.data) for r in parts.collect()) == 4 * 16 and parts.count() > 3 * 6
    assert {r.pair_id for r in raw.write_raw(field.repartition(5), grid, str(tmp_path)).collect()} == {"a", "b"}
    for p in "ab":
        got = np.fromfile(tmp_path / f"{p}.bin", "<f4").reshape(3, 12, 7).transpose(0, 2, 1)
        ok = np.array([[held(p, i, j) for j in range(12)] for i in range(7)])
        for plane, want in zip(got, (v, -v, np.full(grid, 0.5, "<f4")), strict=True):
            assert np.array_equal(plane, np.where(ok, want, np.nan), equal_nan=True)
    with pytest.raises(Exception, match="beyond the grid"):
        raw.write_raw(field, (6, 12), str(tmp_path / "beyond"))
    part = spark.createDataFrame([("a", 0, b"\0" * 8), ("a", 1, b"\0" * 8)], "pair_id string, first long, data binary")
    with pytest.raises(Exception, match="overlap"):
        planes.write_parts(part, str(tmp_path / "overlap"), 8)
    assert os.listdir(tmp_path / "overlap") == []
