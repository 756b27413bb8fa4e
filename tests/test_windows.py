import random
from statistics import median

import pytest

from shiftgrid.operators import window2d as W


def brute(grid, ny, nx, w, f):
    wx, wy = (w, w) if isinstance(w, int) else w
    wx, wy = min(wx, nx), min(wy, ny)
    out = {}
    for r in range(1, ny + 1):
        for c in range(1, nx + 1):
            vals = [grid[a, b] for a in range(r - wy // 2, r + wy - wy // 2) for b in range(c - wx // 2, c + wx - wx // 2) if (a, b) in grid and grid[a, b] is not None]
            out[r, c] = f(vals, grid[r, c])
    return out


CASES = {
    "max": (W.windowmax, lambda v, m: max(v, default=None)), "min": (W.windowmin, lambda v, m: min(v, default=None)),
    "range": (W.windowrange, lambda v, m: max(v) - min(v) if v else None), "mean": (W.windowmean, lambda v, m: sum(v) / len(v) if v else None),
    "median": (W.windowmedian, lambda v, m: median(v) if v else None), "mad": (W.windowmad, lambda v, m: median([abs(x - median(v)) for x in v]) if v else None),
    "agree": (lambda df, w, s: W.count_agreeing(df, w, s, 0.3), lambda v, m: 0 if m is None else sum(abs(x - m) < 0.3 for x in v)),
}


@pytest.mark.parametrize("w", [1, 3, 4, (5, 2), 48])
@pytest.mark.parametrize("share", [0.0, 0.6, 1.0])
def test_windows_against_brute_force(spark, w, share):
    rng = random.Random(str((w, share)))
    ny, nx = 6, 9
    grid = {(r, c): None if rng.random() < share else round(rng.random(), 3) for r in range(1, ny + 1) for c in range(1, nx + 1)}
    df = spark.createDataFrame([("i", r, c, v) for (r, c), v in grid.items()], "image_id string, r int, c int, v double")
    for name, (f, g) in CASES.items():
        got = {(x.r, x.c): x.out for x in f(df, w, (ny, nx)).collect()}
        want = brute(grid, ny, nx, w, g)
        for k in want:
            assert (got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9), (name, k)


def test_window_of_nothing(spark):
    empty = spark.createDataFrame([], "image_id string, r int, c int, v double")
    assert W.windowmedian(empty, 3, (5, 5)).count() == 0
    with pytest.raises(ValueError):
        W.extent(0, (5, 5))


def test_gaps_need_no_frame_to_the_end(spark):
    """Spark makes a frame from the current row to the end again for each row: a column's square in time."""
    from shiftgrid.plans.queries import QUERIES

    plan = QUERIES["wallis_gapfill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "windowspecdefinition" in plan
    assert "currentrow$(), unboundedfollowing" not in plan


def test_gaps_lie_between_valid_pixels(spark):
    """A gap has valid pixels on either side along its row and its column; a line without any has none."""
    from shiftgrid.operators import preprocess as pre

    bad = {(1, 1), (2, 3), (3, 3), (5, 2)} | {(4, c) for c in range(1, 6)}
    px = spark.createDataFrame([("a", r, c, float(r * 3 + c * c), (r, c) not in bad) for r in range(1, 6) for c in range(1, 6)], "image_id string, r int, c int, v double, valid boolean")
    got = {(r.r, r.c): r.valid for r in pre.wallis_gapfill(px, 3, (5, 5)).collect()}
    ok = {(r, c) for r in range(1, 6) for c in range(1, 6)} - bad
    between = lambda k, of: of and min(of) <= k <= max(of)
    for r, c in bad:
        assert got[r, c] == bool(between(c, [q for p, q in ok if p == r]) and between(r, [p for p, q in ok if q == c]))
