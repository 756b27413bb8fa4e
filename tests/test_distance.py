"""Distance transforms against brute force, by blocks; dilation at any radius."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid.operators import resample


def brute(m):
    at = np.argwhere(m)
    i, j = np.mgrid[0 : m.shape[0], 0 : m.shape[1]]
    return ((i[..., None] - at[:, 0]) ** 2 + (j[..., None] - at[:, 1]) ** 2).min(-1)


@pytest.mark.parametrize("part", [0.002, 0.02, 0.3, 1.0])
def test_envelopes_of_many_lines(part):
    rng = np.random.default_rng(int(part * 1000))
    for _ in range(20):
        h, w = rng.integers(1, 40, 2)
        m = rng.random((h, w)) < part
        m[rng.integers(h), rng.integers(w)] = True
        rows = np.arange(h)[:, None]
        g = np.full((h, w), resample.FAR)
        for c in range(w):
            at = np.flatnonzero(m[:, c])
            if len(at):
                g[:, c] = np.abs(rows - at).min(1)
        assert (resample.envelope(g) == brute(m)).all()


def table(spark, masks):
    rows = [(k, int(r) + 1, int(c) + 1, bool(m[r, c])) for k, m in masks.items() for r, c in np.ndindex(*m.shape)]
    return spark.createDataFrame(rows, "image_id string, r int, c int, m boolean")


def test_distances_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    masks = {"few": rng.random((50, 37)) < 0.004, "many": rng.random((50, 37)) < 0.2, "one": np.zeros((50, 37), bool), "none": np.zeros((50, 37), bool)}
    masks["one"][49, 0] = masks["few"][3, 3] = True
    grid = table(spark, masks)
    got = {(r.image_id, r.r, r.c): r.d2 for r in resample.distance_transform(grid, (50, 37)).collect()}
    assert len(got) == 4 * 50 * 37
    for k, m in masks.items():
        want = brute(m) if m.any() else None
        assert all(got[k, r + 1, c + 1] == (None if want is None else want[r, c]) for r, c in np.ndindex(*m.shape))
    for radius in (0.5, 1.5, 3.0, 9.0, 12.5, 100.0):
        near = {(r.image_id, r.r, r.c) for r in resample.dilate_within(grid, radius, (50, 37)).where("m").collect()}
        assert near == {k for k, d in got.items() if d is not None and d <= radius * radius}


def test_no_grid_and_gaps(spark):
    none = spark.createDataFrame([], "image_id string, r int, c int, m boolean")
    assert resample.distance_transform(none, (5, 5)).count() == 0
    holed = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 2, None), ("a", 3, 3, False)], "image_id string, r int, c int, m boolean")
    got = {(r.r, r.c): r.d2 for r in resample.distance_transform(holed, (3, 3)).collect()}
    assert got[3, 3] == 8 and got[1, 1] == 0 and len(got) == 9
    assert holed.join(resample.dilate_within(holed, 20, (3, 3)).where("m"), ["r", "c"]).agg(F.count("*")).first()[0] == 3
