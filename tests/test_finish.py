"""Rejection and filling in Arrow against the relational forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid.operators.finish_arrow import finish
from shiftgrid.operators.outliers import reject_outliers
from shiftgrid.operators.resample import fill_holes
from shiftgrid.params import Gardner

FIELD = "pair_id string, pt_id long, gi int, gj int, dx double, dy double, correlation double, radius_x int, radius_y int"


def drawn(spark, shape, pairs=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(pairs):
        for i in range(shape[0]):
            for j in range(shape[1]):
                wild = rng.random() < 0.2
                dx, dy = (float(rng.uniform(-6, 6)) if wild else float(2 + i / 9 + rng.normal() / 8) for _ in "xy")
                gone = rng.random() < 0.15
                radius = 0 if rng.random() < 0.05 else 6
                rows.append((f"p{p}", i * shape[1] + j, i + 1, j + 1, None if gone else dx, None if gone else dy, None if gone else 0.5, radius, radius))
    return spark.createDataFrame(rows, FIELD)


def plain(field, f, shape, w):
    fine = reject_outliers(field, f, 64, shape)
    kept = fine.withColumns({k: F.when(F.col("keep"), F.col(k)) for k in ("dx", "dy", "correlation")})
    return fill_holes(kept, w, shape)


def rows(df):
    names = ["pair_id", "pt_id", "dx", "dy", "correlation", "radius_x", "keep", "filled"]
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).orderBy("pair_id", "pt_id").collect()]


@pytest.mark.parametrize(("shape", "side"), [((23, 31), 128), ((23, 31), 7), ((3, 12), 5), ((1, 1), 4)])
def test_blocks_equal_frames(spark, shape, side):
    field, f = drawn(spark, shape), Gardner()
    assert rows(finish(field, f, 64, shape, 3, side=side)) == rows(plain(field, f, shape, 3))


def test_no_filter_and_no_filling(spark):
    field, shape = drawn(spark, (9, 8)), (9, 8)
    got = finish(field, None, 64, shape)
    assert got.columns == [*field.columns, "keep"]
    assert sorted(got.collect()) == sorted(reject_outliers(field, None, 64, shape).collect())
    assert finish(field.limit(0), Gardner(), 64, shape, 3).count() == 0


def test_rejection_shuffles_once_and_is_that_of_single_windows(spark):
    """Two fields beyond a block's side, under other names, against windows of one place at a time."""
    shape, f = (19, 140), Gardner()
    field = drawn(spark, shape).withColumnsRenamed({"pair_id": "site", "gi": "a", "gj": "b"})
    got = reject_outliers(field, f, 64, shape, ("site",), "a", "b")
    assert got.columns == [*field.columns, "keep"]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    x = {(r.site, r.a, r.b): (r.dx / r.radius_x, r.dy / r.radius_y) for r in field.collect() if r.dx is not None and r.dy is not None and r.radius_x > 0}
    around = lambda k, kept: np.array([x[p] for p in ((k[0], k[1] + i, k[2] + j) for i in range(-2, 3) for j in range(-2, 3)) if p in kept])
    kept = set(x)
    for _ in range(3):
        kept = {k for k in kept if ((np.abs(around(k, kept) - x[k]) < f.agree_tolerance).sum(0) >= f.min_agree_fraction * 25 - 1e-9).all()}
    for _ in range(2):
        near = {k: around(k, kept) for k in kept}
        mid = {k: np.median(v, 0) for k, v in near.items()}
        kept = {k for k, v in near.items() if (np.abs(x[k] - mid[k]) <= np.maximum(f.mad_scale * np.median(np.abs(v - mid[k]), 0), 2 / (64 * 6)) + 1e-12).all()}
    assert {(r.site, r.a, r.b) for r in got.collect() if r.keep} == kept and 100 < len(kept) < len(x)
