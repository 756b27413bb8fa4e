"""Rotation in both forms, and methods of one's own in both forms without a change to the library."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid import registry
from shiftgrid.operators import kernels, multichip, points
from shiftgrid.operators.finish_arrow import finish
from shiftgrid.operators.outliers import reject_outliers
from shiftgrid.params import Rotation, params
from shiftgrid.plans import api
from shiftgrid.registry import Filter, OutlierFilter, Quantize, Similarity
from tests.test_tracking import pixels, shifted, texture


def test_rotation_of_many_points_is_that_of_each():
    a, b = texture(90, 90, 5), texture(90, 90, 6)
    b = 0.7 * kernels.rotate((a - a.mean())[None], 5.0)[0] + 0.1 * b
    rng = np.random.default_rng(2)
    n = 40
    pts = {"x": rng.integers(30, 60, n).astype(float), "y": rng.integers(30, 60, n).astype(float), "radius_x": np.where(np.arange(n) % 2, 4.0, 5.0), "radius_y": np.full(n, 4.0),
           "dx_prior": np.zeros(n), "dy_prior": np.zeros(n), "chip_x": np.where(np.arange(n) % 2, 16.0, 12.0), "chip_y": np.full(n, 16.0)}
    ok = np.ones_like(a, bool)
    angles = (-6.0, -3.0, 0.0, 3.0, 6.0)
    every = kernels.track(a, b, ok, pts, 1, 1, 8, angles=angles)
    for k in range(n):
        one = kernels.track(a, b, ok, {name: v[k : k + 1] for name, v in pts.items()}, 1, 1, 8, angles=angles)
        for name in ("dx", "dy", "correlation"):
            assert np.isclose(one[name][0], every[name][k], atol=1e-5, equal_nan=True)


def _pair(spark, a, b):
    both = pixels(spark, a, "a").select("r", "c", F.col("v").alias("ref")).join(pixels(spark, b, "b").select("r", "c", F.col("v").alias("sec")), ["r", "c"])
    return multichip.Images(both.select(F.lit("p").alias("pair_id"), "r", "c", "ref", "sec", F.lit(True).alias("valid")), a.shape)


def test_rotation_in_both_tiers(spark):
    a = texture(60, 60, 5)
    a = a - a.mean()
    images = _pair(spark, a, kernels.rotate(a[None], 6.0)[0])
    at = spark.createDataFrame([(k, 18.0 + k % 6 * 4, 18.0 + k // 6 * 4) for k in range(36)], "pt_id long, x double, y double")
    pts = points.pointset(at, 20, search_radius=4)
    p = params(chip_size=12, chip_size_max=12, search_radius=4, rotation=Rotation((-6.0, 0.0, 6.0)))
    rows, arrow = ({r.pt_id: r for r in multichip.track(images, pts, p, "zncc", 1, t).collect()} for t in ("rows", "arrow"))
    still = {r.pt_id: r for r in multichip.track(images, pts, params(chip_size=12, chip_size_max=12, search_radius=4), "zncc", 1, "rows").collect()}
    assert all((rows[k].dx, rows[k].dy) == (arrow[k].dx, arrow[k].dy) and abs(rows[k].correlation - arrow[k].correlation) < 1e-4 for k in rows)
    assert all(rows[k].correlation >= still[k].correlation - 1e-9 for k in rows) and sum(rows[k].correlation > still[k].correlation + 0.003 for k in rows) > 10


@pytest.fixture
def own():
    """A similarity (nearness of squares), a filter (difference from the row above), a quantization and an outlier filter."""
    def above(px, pre, shape):
        from pyspark.sql import Window as W

        up = F.lag("v").over(W.partitionBy("image_id", "c").orderBy("r"))
        return px.withColumn("v", F.col("v") - up).withColumn("valid", F.col("valid") & F.col("v").isNotNull()).withColumn("v", F.coalesce("v", F.lit(0.0)))

    def above_arrays(v, ok, pre):
        out, good = np.zeros_like(v), ok.copy()
        out[1:] = v[1:] - v[:-1]
        good[0] = False
        return out, good

    def near(sums, least):
        w = sums["s2"] - sums["s1"] * sums["s1"] / sums["n"]  # of the window less its mean
        return 1.0 - (sums["tt"] + w - 2 * sums["num"]) / least(sums["tt"] + w)

    methods = [
        ("similarity", Similarity("nearness", lambda s: near(s, lambda x: F.greatest(x, F.lit(1e-9))), lambda s: near(s, lambda x: np.maximum(x, 1e-9)))),
        ("preprocess", Filter("above", above, above_arrays)),
        ("quantize", Quantize("thousandths", lambda px: px.withColumn("v", F.rint(F.col("v") * 1000)), lambda v, ok: np.rint(v * 1000))),
        ("outliers", OutlierFilter("short", lambda f, up, shape: f.withColumn("keep", F.abs("dx") + F.abs("dy") < 6), lambda dx, dy, rx, ry, up, shape: np.abs(dx) + np.abs(dy) < 6)),
    ]
    for kind, m in methods:
        registry.register(kind, m)
    yield
    for kind, m in methods:
        registry.unregister(kind, m.name)


def test_own_methods_run_in_both_tiers(spark, own):
    a, b = shifted(80, 80, 2, 1)
    keywords = dict(chip_size=8, chip_size_max=16, grid_spacing=8, search_radius=5, min_search_radius=4, similarity="nearness", preprocess="above", quantize="thousandths", outliers="short", upsampling=8)
    got = {t: {(r.gi, r.gj): r for r in api.track_pair(pixels(spark, a, "a"), pixels(spark, b, "b"), (80, 80), tier=t, **keywords).collect()} for t in ("rows", "arrow")}
    known = [r for r in got["rows"].values() if r.dx is not None]
    assert len(known) > 10 and all(abs(r.dx + 2) <= 0.5 and abs(r.dy + 1) <= 0.5 for r in known if r.chip_size == 8)
    for k, r in got["rows"].items():
        other = got["arrow"][k]
        assert (r.dx is None) == (other.dx is None) and r.chip_size == other.chip_size
        assert r.dx is None or abs(r.dx - other.dx) <= 0.25 and abs(r.dy - other.dy) <= 0.25
    planes = spark.createDataFrame([(k, 80, 80, v.astype("<f4").tobytes()) for k, v in (("a", a), ("b", b))], "image_id string, ny int, nx int, data binary")
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, ref_id string, sec_id string")
    whole = api.Session((80, 80), **keywords).add_planes(planes).track(pairs)
    assert {(r.gi, r.gj): (r.dx, r.dy) for r in whole.collect()} == {k: (r.dx, r.dy) for k, r in got["arrow"].items()}


def test_own_outlier_filter_in_both_forms(spark, own):
    f = registry.own("outliers", "short")
    field = spark.range(400).selectExpr("'p' pair_id", "cast(id div 20 as int) + 1 gi", "cast(id % 20 as int) + 1 gj", "if(id % 7 = 0, null, cast(id % 5 as double)) dx", "cast(id % 4 as double) dy", "0.5D correlation", "4 radius_x", "4 radius_y")
    a = {(r.gi, r.gj): r.keep for r in reject_outliers(field, f, 64, (20, 20)).collect()}
    assert a == {(r.gi, r.gj): r.keep for r in finish(field, f, 64, (20, 20), side=8).collect()} and len(set(a.values())) == 2


def test_names_are_checked(own):
    with pytest.raises(ValueError, match="similarity"):
        registry.register("similarity", Similarity("zncc", lambda s: None))
    with pytest.raises(ValueError, match="nearness"):
        registry.register("similarity", Similarity("nearness", lambda s: None))
    with pytest.raises(ValueError, match="nearness"):
        params(similarity="furness")
    with pytest.raises(ValueError, match="window"):
        params(outliers="short", outlier_window=7)
    with pytest.raises(ValueError, match="kind"):
        registry.register("colour", Similarity("x", lambda s: None))
