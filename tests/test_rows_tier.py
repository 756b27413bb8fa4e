"""The relational tier's plans and odd shapes: products of pixels and shifts are never rows."""

import re

import pytest

from shiftgrid.operators import correlate, peak
from shiftgrid.plans.queries import QUERIES, as_pair, grid, reference, secondary

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["subpixel_peak", "rotation_search", "rotation_track_rows", "track", "track_scattered"])
def test_no_shuffle_by_place_or_shift(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\((.*)\)", plan)
    assert keys
    assert not [k for k in keys if re.search(r"\b(wi|wj|sy|sx|si|sj|u|x)#", k)]


@pytest.mark.parametrize("name", ["subpixel_peak", "peak_offset", "rotation_search", "track", "track_scattered", "zncc"])
def test_points_are_not_broadcast(spark, name):
    """Points and their lines are estimated by the file they come from, so a join that Spark is left to choose builds them in the driver."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastExchange" not in plan


def test_window_over_several_blocks_and_outside(spark):
    """A wide window over blocks of lines and beyond the image's edge has the sums of its pixels, zero outside."""
    px = spark.createDataFrame([("p", r, c, float((r * 37 + c * 11) % 17), True) for r in range(1, 41) for c in range(1, 131)], "pair_id string, r int, c int, v double, valid boolean")
    pts = spark.createDataFrame([("p", 1, 1, 1, 66.0, 20.0, 30, 5, 0.0, 0.0, 8, 8), ("p", 2, 1, 2, 3.0, 4.0, 4, 4, 0.0, 0.0, 8, 8)],
                                "pair_id string, pt_id bigint, gi int, gj int, x double, y double, radius_x int, radius_y int, dx_prior double, dy_prior double, chip_x int, chip_y int")
    at = {(r.r, r.c): r.v for r in px.collect()}
    got = {(r.pt_id, r.sy, r.sx): r.score for r in correlate.surfaces(px, px, pts).collect()}
    assert len(got) == 60 * 10 + 8 * 8
    for (k, sy, sx), score in got.items():
        x, y, rx, ry = (66, 20, 30, 5) if k == 1 else (3, 4, 4, 4)
        t = [at.get((y - 4 + i, x - 4 + j), 0.0) for i in range(8) for j in range(8)]
        w = [at.get((y - 4 - ry + i + sy, x - 4 - rx + j + sx), 0.0) for i in range(8) for j in range(8)]
        m, n = sum(t) / 64, sum(w) / 64
        num = sum((a - m) * (b - n) for a, b in zip(t, w, strict=True))
        den = (sum((a - m) ** 2 for a in t) * sum((b - n) ** 2 for b in w)) ** 0.5
        assert score == pytest.approx(num / den if den else 0.0, abs=1e-9)


def test_missing_scores_take_no_part(spark):
    """Fine samples of a patch with gaps are sums of the scores that are there."""
    pts = grid(spark, SF).where("pt_id = 0")
    surf = correlate.surfaces(as_pair(reference(spark, SF)), as_pair(secondary(spark, SF)), pts)
    top = peak.peak(surf).first()
    one = surf.where(f"sy = {top.sy} and sx = {top.sx}")
    got = peak.subpixel_peak(one, pts, 8).first()
    m = peak.refinement_matrix(5, 8)
    a, b = (k - min(max(k - 2, 0), 3) for k in (top.sy, top.sx))
    assert got.correlation == pytest.approx(top.correlation * m[:, a].max() * m[:, b].max(), rel=1e-9)
