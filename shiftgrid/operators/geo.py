"""Map geometry: axes, alignment checks, coordinates of grid points, velocities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.functions.scalar import YEAR_SECONDS


def check_aligned(axes: DataFrame, ref_id: str, sec_id: str) -> None:
    """Both images have the same axes (and coordinate system), or an error names the difference. Metadata only."""
    names = ["axis", "origin", "step", "ascending", "regular"]
    a, b = (axes.where(F.col("image_id") == i).select(*names) for i in (ref_id, sec_id))
    if a.exceptAll(b).union(b.exceptAll(a)).limit(1).count():
        raise ValueError(f"images {ref_id} and {sec_id} are not on one grid: their axes differ")
    crs = [{r[0] for r in axes.where(F.col("image_id") == i).select("crs").distinct().limit(3).collect()} for i in (ref_id, sec_id)]
    if crs[0] != crs[1]:
        raise ValueError(f"images {ref_id} and {sec_id} have different coordinate systems: {crs[0]} and {crs[1]}")


def grid_coords(pts: DataFrame, axes: DataFrame) -> DataFrame:
    """``map_x``, ``map_y``: the axes sampled at the points. ``axes`` is of one image: a row an axis."""
    one = axes.groupBy().agg(*(F.max(F.when(F.col("axis") == a, F.col(k))).alias(f"_{a}_{k}") for a in ("X", "Y") for k in ("origin", "step")))
    met = pts.crossJoin(F.broadcast(one))  # one row
    out = met.withColumns({"map_x": F.col("_X_origin") + (F.col("x") - 1) * F.col("_X_step"), "map_y": F.col("_Y_origin") + (F.col("y") - 1) * F.col("_Y_step")})
    return out.select(*pts.columns, "map_x", "map_y")


def pair_axes(pairs: DataFrame, axes: DataFrame) -> DataFrame:
    """``pairs(pair_id, ref_id, sec_id, ...)`` with the axes that a pair's images share: ``x0, x_step, y0, y_step, y_ascending, regular,
    crs``. In the plan a pair is an error whose images lack an axis, have unequal ones, or other coordinate systems."""
    names = ["origin", "step", "ascending", "regular", "crs"]
    one = lambda a: F.max(F.when(F.col("axis") == a, F.struct(*names)))
    own = axes.groupBy("image_id").agg(one("X").alias("X"), one("Y").alias("Y"), F.count(F.lit(1)).alias("n"))
    side = lambda k: own.select(F.col("image_id").alias(f"{k}_id"), *(F.col(c).alias(f"_{k}_{c}") for c in ("X", "Y", "n")))
    met = pairs.join(side("ref"), "ref_id", "left").join(side("sec"), "sec_id", "left")
    a, b = ({c: F.col(f"_{k}_{c}") for c in ("X", "Y", "n")} for k in ("ref", "sec"))
    told = lambda *words: F.raise_error(F.concat(F.lit("images "), "ref_id", F.lit(" and "), "sec_id", *(F.lit(w) for w in words)))
    whole = lambda s: (F.coalesce(s["n"], F.lit(0)) == 2) & s["X"].isNotNull() & s["Y"].isNotNull()
    grid = lambda s: F.struct(*(s[c][k] for c in ("X", "Y") for k in names if k != "crs"))
    crs = lambda s: F.struct(s["X"]["crs"], s["Y"]["crs"])
    wrong = F.when(~(whole(a) & whole(b)), told(": each needs one axis X and one axis Y").cast("string")).when(~grid(a).eqNullSafe(grid(b)), told(" are not on one grid: their axes differ").cast("string")).when(
        ~crs(a).eqNullSafe(crs(b)), told(" have different coordinate systems").cast("string"))
    ok = lambda c: F.when(wrong.isNull(), c)  # noqa: E731 - read with every value, so that no plan leaves the check out
    return met.select(*pairs.columns, ok(a["X"]["origin"]).alias("x0"), ok(a["X"]["step"]).alias("x_step"), ok(a["Y"]["origin"]).alias("y0"), ok(a["Y"]["step"]).alias("y_step"),
                      ok(a["Y"]["ascending"]).alias("y_ascending"), ok(a["X"]["regular"] & a["Y"]["regular"]).alias("regular"), ok(a["X"]["crs"]).alias("crs"))


def on_axes(result: DataFrame, bound: DataFrame) -> DataFrame:
    """A result with ``map_x``, ``map_y`` of its points and ``crs``; ``bound``: pairs of :func:`pair_axes`."""
    met = result.join(bound.select("pair_id", "x0", "x_step", "y0", "y_step", "crs"), "pair_id")
    at = {"map_x": F.col("x0") + (F.col("x") - 1) * F.col("x_step"), "map_y": F.col("y0") + (F.col("y") - 1) * F.col("y_step")}
    return met.withColumns(at).select(*result.columns, "map_x", "map_y", "crs")


def pair_velocity(result: DataFrame, bound: DataFrame) -> DataFrame:
    """``vx``, ``vy`` in map orientation for ``dx``, ``dy``: units of the map a year where a pair has ``years`` (which needs
    regular axes, or is an error), pixels where it is null."""
    size = lambda a: F.when(F.col("years").isNull(), 1.0).when(F.col("regular"), F.abs(F.col(f"{a}_step")) / F.col("years")).otherwise(
        F.raise_error(F.concat(F.lit("pair "), "pair_id", F.lit(": `dt` needs regular axes, whose pixel size is known"))).cast("double"))
    positive = F.when(F.col("years").isNull() | (F.col("years") > 0), F.col("years")).otherwise(F.raise_error(F.concat(F.lit("pair "), "pair_id", F.lit(": `dt` must be positive"))).cast("double"))
    by = bound.withColumn("years", positive).select("pair_id", size("x").alias("_fx"), (size("y") * F.when(F.col("y_ascending"), -1.0).otherwise(1.0)).alias("_fy"))
    out = result.join(by, "pair_id").withColumns({"vx": -F.col("dx") * F.col("_fx"), "vy": F.col("dy") * F.col("_fy")})
    return out.drop("dx", "dy", "_fx", "_fy")


def pixel_size(axes: DataFrame) -> DataFrame:
    """Per image and axis the absolute step of a regular axis, null otherwise."""
    return axes.select("image_id", "axis", F.when(F.col("regular"), F.abs("step")).alias("pixel_size"))


def interval_years(dt) -> float | None:
    """Julian years of a timedelta or of a positive number of years; calendar months have no length."""
    if dt is None:
        return None
    years = dt.total_seconds() / YEAR_SECONDS if hasattr(dt, "total_seconds") else float(dt)
    if not years > 0:
        raise ValueError(f"`dt` must be positive, got {dt}")
    return years


def velocity(result: DataFrame, north_up: bool, dx_size: float | None = None, dy_size: float | None = None, years: float | None = None) -> DataFrame:
    """Feature motion in map orientation: displacements point from secondary to reference, so x is negated, and y
    is too where map y grows down rows. With ``years`` in units of the map a year, which needs regular axes."""
    if years is not None and (dx_size is None or dy_size is None):
        raise ValueError("`dt` needs regular axes, whose pixel size is known")
    fx = 1.0 if years is None else dx_size / years
    fy = 1.0 if years is None else dy_size / years
    return result.withColumns({"vx": -F.col("dx") * fx, "vy": (F.col("dy") if north_up else -F.col("dy")) * fy}).drop("dx", "dy")


LAYERS = {"vx": None, "vy": None, "correlation": None, "chip_size": 0, "interpolated": False}


def layers(result: DataFrame) -> DataFrame:
    """The five layers a raster has, long: (pair_id, layer, gi, gj, value), missing values null or 0."""
    stack = F.expr("stack(5, 'vx', vx, 'vy', vy, 'correlation', correlation, 'chip_size', cast(chip_size as double), 'interpolated', cast(interpolated as double)) as (layer, value)")
    return result.select("pair_id", "gi", "gj", stack)
