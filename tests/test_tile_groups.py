"""Tracking by tiles: Python gets a tile at a time, and fields do not depend on how tiles are dealt."""

from shiftgrid.plans import api
from tests.test_tracking import pixels, texture


def test_a_tile_is_a_group_of_its_own(spark):
    ref = texture(120, 60, 1)
    sec = texture(120, 60, 1)
    sec[1:, 2:] = ref[:-1, :-2]
    both = pixels(spark, ref, "a").unionByName(pixels(spark, sec, "b"))
    pairs = spark.createDataFrame([("p", "a", "b"), ("q", "b", "a")], "pair_id string, ref_id string, sec_id string")
    own = dict(chip_size=8, chip_size_max=8, grid_spacing=8, search_radius=4, min_search_radius=4, preprocess="none", quantize="none", upsampling=8)
    got = {}
    for tile in (256, 32):
        s = api.Session((120, 60), tile=tile, **own).add(both)
        pts = api.build_grid(spark, (120, 60), s.params, pairs)
        found = api.M.track_packs(s.packs, pairs, pts, tile, (120, 60), 8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "MapInPandas" not in plan  # a batch of rows would hold many tiles
        got[tile] = {(r.pair_id, r.pt_id): (r.dx, r.dy, r.searched) for r in found.collect()}
    assert got[256] == got[32] and len(got[32]) == pts.count()
    known = [v[:2] for (p, _), v in got[32].items() if p == "p" and v[0] is not None]
    assert len(known) > 20 and sum(abs(x + 2) <= 0.25 and abs(y + 1) <= 0.25 for x, y in known) > 0.9 * len(known)
