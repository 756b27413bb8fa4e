"""Corners, descriptors and first guesses from pixels alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid import registry
from shiftgrid.operators import detect
from shiftgrid.operators.correlate_arrow import pack
from shiftgrid.plans import api
from tests.test_tracking import pixels, texture


def found(px, tile, shape, most=None):
    got = detect.keypoints(pack(px, tile, detect.REACH, shape=shape), detect.REACH, shape[1], most=most).collect()
    return {(r.image_id, int(r.r), int(r.c)): (r.k_id, r.score, r.angle, tuple(r.desc)) for r in got}


def test_corners_do_not_depend_on_tiles(spark):
    v = texture(150, 180, 3)
    px = pixels(spark, v, "a").withColumn("valid", ~(F.col("r").between(70, 72) & F.col("c").between(90, 93)))
    small, large = found(px, 64, v.shape), found(px, 256, v.shape)
    assert small == large and len(large) > 100
    clear = 150 - 2 * 20
    assert all(20 < r <= 20 + clear and 20 < c <= 160 for _, r, c in large)
    assert not any(50 <= r <= 92 and 70 <= c <= 113 for _, r, c in large)  # patches keep clear of what is not valid
    best = sorted(large.values(), key=lambda k: (-k[1], k[0]))[:20]
    assert sorted(found(px, 64, v.shape, 20).values()) == sorted(best)


def test_scores_and_suppression_are_brute_force():
    v = np.round(texture(60, 60, 1), 2)
    r, c, s = detect.corners(v, np.ones_like(v, bool), (slice(5, 55), slice(5, 55)), 3)
    score = detect.scores(v)
    p = np.pad(v, 3)
    gy, gx = (p[1:, :][1:] - p[:-2])[:, 1:-1] / 2, ((p[:, 2:] - p[:, :-2]) / 2)[1:-1]
    for i, j in ((10, 12), (30, 41), (55, 20)):
        a, b = gx[i : i + 5, j : j + 5], gy[i : i + 5, j : j + 5]
        xx, xy, yy = (a * a).sum(), (a * b).sum(), (b * b).sum()
        assert np.isclose(score[i, j], xx * yy - xy * xy - 0.04 * (xx + yy) ** 2)
    for i, j in zip(r, c, strict=True):
        near = score[max(i - 3, 0) : i + 4, max(j - 3, 0) : j + 4]
        assert score[i, j] == near.max()
    assert len(r) and set(s) == set(score[r, c])


def test_descriptors_turn_with_the_image():
    v = texture(121, 121, 9)
    turned = np.rot90(v).copy()
    at = np.array([[60, 60], [50, 64], [66, 48]])
    a, da = detect.describe(v, at[:, 0], at[:, 1])
    b, db = detect.describe(turned, 120 - at[:, 1], at[:, 0])
    far = np.bitwise_count(da.view(np.uint64) ^ db.view(np.uint64)).sum(1)
    assert (far < 60).all() and (np.bitwise_count(da[0].view(np.uint64) ^ da[1].view(np.uint64)).sum() > 70)
    assert ((b - a) % detect.TURNS != 0).all()


def test_first_guess_from_pixels(spark):
    """A scene whose left half moved one way and its right half another, further than any search radius."""
    v = texture(240, 320, 4)
    w = v.copy()
    w[:, :160], w[:, 160:] = np.roll(v, (17, 31), (0, 1))[:, :160], np.roll(v, (-12, 22), (0, 1))[:, 160:]
    s = api.Session(v.shape, chip_size=16, chip_size_max=16, search_radius=6, preprocess="none", quantize="none", upsampling=8)
    s.add(pixels(spark, v, "a").unionByName(pixels(spark, w, "b")))
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, ref_id string, sec_id string")
    pts = s.first_guess(pairs)
    got = pts.collect()
    left = [p for p in got if p.x < 110]
    moved = sum((p.dx_prior, p.dy_prior) == (-31.0, -17.0) for p in left)
    assert moved > 50 and moved >= 0.95 * len(left)
    field = s.track(pairs, pts).collect()
    assert len(field) == len(got) and sum((r.dx, r.dy) == (-31.0, -17.0) for r in field) >= moved


def test_flat_images_and_own_matches(spark):
    flat = pixels(spark, np.zeros((80, 80)), "a").unionByName(pixels(spark, np.zeros((80, 80)), "b"))
    s = api.Session((80, 80), chip_size=8, chip_size_max=8, search_radius=4, preprocess="none", quantize="none").add(flat)
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, ref_id string, sec_id string")
    assert s.first_guess(pairs).count() == 0
    grid = lambda session, of, step=20: of.select("pair_id").crossJoin(spark.range(9)).selectExpr("pair_id", "id m_id", f"double(id div 3 * {step} + 20) r", f"double(id % 3 * {step} + 20) c", "1.0D dx", "2.0D dy")
    registry.register("matches", registry.Matches("given", grid))
    try:
        assert {(p.x, p.dx_prior) for p in s.first_guess(pairs, "given", step=10).collect()} == {(x, 1.0) for x in (20.0, 30.0, 40.0)}
        with pytest.raises(ValueError, match="given"):
            s.first_guess(pairs, "taken")
    finally:
        registry.unregister("matches", "given")
    with pytest.raises(ValueError, match="halo"):
        detect.keypoints(s.packs, 4, 80)
