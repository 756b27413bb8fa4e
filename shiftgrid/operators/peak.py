"""Correlation peaks: top-1 a point with row-major ties, and refinement by one composite matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftgrid.functions.scalar import refinement_matrix

PT = ["pair_id", "pt_id"]
PATCH = 5


def _key(digits: int):
    return F.struct(F.round("score", digits).alias("k"), (-F.col("sy")).alias("y"), (-F.col("sx")).alias("x"), F.col("score").alias("s"))


def peak(surfaces: DataFrame, digits: int = 9) -> DataFrame:
    """Per point the highest score and its place; of equal ones (to ``digits`` places) the first row by row.

    One aggregate of a struct: partial maxima before the shuffle, no sort. Nulls are never taken.
    """
    best = surfaces.where("score is not null").groupBy(*PT).agg(F.max(_key(digits)).alias("b"))
    return best.select(*PT, (-F.col("b.y")).alias("sy"), (-F.col("b.x")).alias("sx"), F.col("b.s").alias("correlation"))


def peak_offset(surfaces: DataFrame, pts: DataFrame, digits: int = 9) -> DataFrame:
    """Peaks as displacements about zero shift, plus the prior."""
    got = peak(surfaces, digits).join(pts.hint("merge"), PT)
    return got.select(*PT, (F.col("sx") - F.col("radius_x") + F.col("dx_prior")).alias("dx"), (F.col("sy") - F.col("radius_y") + F.col("dy_prior")).alias("dy"), "correlation")


def _doubled(i: Column, n: int) -> Column:
    """Array of (place, weight): where sample ``i`` (1-based) of an axis of ``n`` goes when it is doubled, and how much of it.

    Even places (from 0) take 1/8, 3/4, 1/8 of the samples around, odd ones half of two; beyond an edge stand the samples
    that :func:`shiftgrid.functions.scalar.reflect101` gives in the doubled axis: the second at the start, the last at the end.
    """
    k = i - 1
    goes = [(k * 2, 0.75, None), (k * 2 + 2, 0.125, k + 1 < n), (k * 2 - 2, 0.125, k > 0), (k * 2 + 1, 0.5, None), (k * 2 - 1, 0.5, k > 0),
            (F.lit(0), 0.125, k == min(1, n - 1)), (F.lit(2 * n - 2), 0.125, k == n - 1), (F.lit(2 * n - 1), 0.5, k == n - 1)]
    taps = [F.struct((p + 1).cast("int").alias("p"), F.lit(w).alias("w")) for p, w, _ in goes]
    return F.filter(F.array(*(t if on is None else F.when(on, t) for t, (_, _, on) in zip(taps, goes, strict=True))), lambda t: t.isNotNull())


def pyrup(grid: DataFrame, shape: tuple[int, int], keys=("image_id",), value: str = "v") -> DataFrame:
    """Twofold Gaussian upsampling of grids of ``shape``: every sample goes to the few places that take of it, along rows and
    then along columns. No table of weights, whatever the grid's size."""
    keys = list(keys)
    rows = grid.select(*keys, "c", F.col(value).alias("_v"), F.explode(_doubled(F.col("r"), shape[0])).alias("t"))
    rows = rows.groupBy(*keys, F.col("t.p").alias("r"), "c").agg(F.sum(F.col("t.w") * F.col("_v")).alias("_v"))
    both = rows.select(*keys, "r", "_v", F.explode(_doubled(F.col("c"), shape[1])).alias("t"))
    return both.groupBy(*keys, "r", F.col("t.p").alias("c")).agg(F.sum(F.col("t.w") * F.col("_v")).alias(value))


def subpixel_peak(surfaces: DataFrame, pts: DataFrame, upsampling: int, digits: int = 9) -> DataFrame:
    """Peaks refined to 1/upsampling: the 5 x 5 patch about the peak, clamped to the surface, upsampled by
    one composite matrix C as C P C', and its first maximum. Surfaces under 5 x 5 keep the integer peak.

    The matrix is a literal of upsampling * 5 rows and 5 columns, whatever the data; a point's samples stay in its row.
    """
    if upsampling == 1:
        return peak_offset(surfaces, pts, digits)
    # Weights that are zero take no part, as null: a fine sample with none of its samples there has no value.
    m = F.array(*(F.array(*(F.lit(float(w) if w else None).cast("double") for w in row)) for row in refinement_matrix(PATCH, upsampling)))
    # One pass over the surfaces: each point's samples travel with its peak, the patch is cut from them.
    top = surfaces.where("score is not null").groupBy(*PT).agg(F.max(_key(digits)).alias("b"), F.collect_list(F.struct("sy", "sx", "score")).alias("s"))
    at = top.join(pts.select(*PT, "radius_x", "radius_y", "dx_prior", "dy_prior").hint("merge"), PT)
    at = at.withColumns({"sy": -F.col("b.y"), "sx": -F.col("b.x"), "correlation": F.col("b.s")})
    first = lambda s, n: F.greatest(F.least(F.col(s) - PATCH // 2, n - PATCH), F.lit(0)).cast("int")
    at = at.withColumns({"i0": first("sy", 2 * F.col("radius_y")), "j0": first("sx", 2 * F.col("radius_x"))})
    held = (2 * F.col("radius_x") >= PATCH) & (2 * F.col("radius_y") >= PATCH)
    got = at.withColumn("f", F.when(held, _finest(F.col("s"), m, digits)))
    row = F.coalesce(-F.col("f.y") / upsampling + F.col("i0"), F.col("sy").cast("double"))
    col = F.coalesce(-F.col("f.x") / upsampling + F.col("j0"), F.col("sx").cast("double"))
    return got.select(*PT, (col - F.col("radius_x") + F.col("dx_prior")).alias("dx"), (row - F.col("radius_y") + F.col("dy_prior")).alias("dy"), F.coalesce("f.s", "correlation").alias("correlation"))


def _total(terms: list[Column]) -> Column:
    """The sum of the terms that are there; null if none is."""
    total = None
    for t in terms:
        t = F.coalesce(t, F.lit(0.0))
        total = t if total is None else total + t
    return F.when(F.coalesce(*terms).isNotNull(), total)


def _finest(samples: Column, m: Column, digits: int) -> Column:
    """(k, y, x, s) of the first maximum of C P C', where P is the patch of ``samples(sy, sx, score)`` from (i0, j0)."""
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    near = lambda e: (e["sy"] - F.col("i0")).between(0, PATCH - 1) & (e["sx"] - F.col("j0")).between(0, PATCH - 1)
    placed = F.transform(F.filter(samples, near), lambda e: F.struct(((e["sy"] - F.col("i0")) * PATCH + e["sx"] - F.col("j0")).alias("p"), e["score"].alias("v")))
    there = lambda es: F.transform(F.sequence(F.lit(0), F.lit(PATCH * PATCH - 1)), lambda p: F.get(F.filter(es, lambda e: e["p"] == p), F.lit(0))["v"])
    axis = F.sequence(F.lit(0), F.lit(PATCH - 1))
    rows = lambda patch: F.transform(m, lambda w: F.transform(axis, lambda j: _total([F.get(w, F.lit(i)) * F.get(patch, j + i * PATCH) for i in range(PATCH)])))
    fine = lambda half: F.flatten(F.transform(half, lambda h, u: F.transform(m, lambda w, x: F.struct(_total([F.get(w, F.lit(j)) * F.get(h, F.lit(j)) for j in range(PATCH)]).alias("s"), (-u).alias("y"), (-x).alias("x")))))
    key = lambda e: F.struct(F.round(e["s"], digits).alias("k"), e["y"].alias("y"), e["x"].alias("x"), e["s"].alias("s"))
    # Only what may equal the maximum to ``digits`` places is rounded.
    close = lambda up, most: F.array_max(F.transform(F.filter(up, lambda e: e["s"] >= most - 2 * 10.0**-digits), key))
    best = lambda up: let(F.array_max(F.transform(up, lambda e: e["s"])), lambda most: close(up, most))
    return let(placed, lambda es: let(there(es), lambda patch: let(fine(rows(patch)), best)))


def best_rotation(by_angle: DataFrame, digits: int = 9) -> DataFrame:
    """Of surfaces with a column ``angle_idx``, each point's surface of the highest peak; ties to the first angle."""
    # Over the point's rows where they are, so that surfaces are made once.
    score = F.when(F.col("score").isNotNull(), F.struct(F.round("score", digits).alias("p"), (-F.col("angle_idx")).alias("a")))
    best = by_angle.withColumn("_b", F.max(score).over(W.partitionBy(*PT)))
    return best.where(F.col("angle_idx") == -F.col("_b.a")).drop("_b")
