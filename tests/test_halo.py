"""Points that bring their own priors, chips and radii, on tiles smaller than what they reach."""

from shiftgrid.operators import multichip, points
from shiftgrid.operators import preprocess as pre
from shiftgrid.params import params
from tests.test_tracking import pixels, shifted


def test_tiles_hold_what_scattered_points_reach(spark):
    ref, sec = shifted(90, 90, -30, 25)
    p = params(chip_size=8, chip_size_max=8, search_radius=4, min_search_radius=4, grid_spacing=6, preprocess="none", quantize="none", upsampling=8)
    met = pre.valid_both(pre.image_pair(pixels(spark, ref, "a"), pixels(spark, sec, "b")))
    im = multichip.Images(met.select("pair_id", "r", "c", "ref", "sec", "valid"), ref.shape)
    rows = [(10 * i + j, 10.0 + 8 * i, 10.0 + 8 * j, px, py, 12 if i % 2 else 16, 12 if i % 2 else 16) for i in range(9) for j in range(9) for px, py in [((-30.0, 25.0) if j < 5 else (28.0, -33.0))]]
    coords = spark.createDataFrame(rows, "pt_id long, x double, y double, dx_prior double, dy_prior double, chip_x int, chip_y int")
    pts = points.pointset(coords, 8, search_radius=6)
    a, b = (sorted((r.pt_id, r.dx, r.dy) for r in multichip.track(im, pts, p, tile=t).collect()) for t in (16, 256))
    assert a == b and any(r[1] is not None for r in a)
