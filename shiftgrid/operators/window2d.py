"""Two-dimensional sliding reductions over grids stored as rows (keys, r, c, value).

Windows are clamped to the grid's extent, left-biased when even, and skip nulls; an all-null window is
null. They are separable: one pass of frames along columns, one along rows, each a shuffle on a row
(column) of one image, so no task holds more than a line of an image and its frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def extent(w: int | tuple[int, int], shape: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
    """(before, after) along rows' direction (y) and along columns' (x), of a width or (width, height)."""
    wx, wy = (w, w) if isinstance(w, int) else w
    if wx < 1 or wy < 1:
        raise ValueError(f"window {w} must be at least 1 in each direction")
    wy, wx = min(wy, shape[0]), min(wx, shape[1])
    return (wy // 2, wy - 1 - wy // 2), (wx // 2, wx - 1 - wx // 2)


def frames(keys: Sequence[str], w, shape, r: str = "r", c: str = "c") -> tuple[WindowSpec, WindowSpec]:
    """Frames along a row of the image, and along a column. RANGE frames are right across gaps."""
    (up, down), (left, right) = extent(w, shape)
    along_row = W.partitionBy(*keys, r).orderBy(c).rangeBetween(-left, right)
    along_col = W.partitionBy(*keys, c).orderBy(r).rangeBetween(-up, down)
    return along_row, along_col


def _separable(df: DataFrame, step, merge, w, shape, keys, value, out, r, c) -> DataFrame:
    across, down = frames(keys, w, shape, r, c)
    return df.withColumn("_w", step(F.col(value)).over(across)).withColumn(out, merge("_w").over(down)).drop("_w")


def windowmax(df: DataFrame, w, shape, keys=("image_id",), value="v", out="out", r="r", c="c") -> DataFrame:
    return _separable(df, F.max, F.max, w, shape, keys, value, out, r, c)


def windowmin(df: DataFrame, w, shape, keys=("image_id",), value="v", out="out", r="r", c="c") -> DataFrame:
    return _separable(df, F.min, F.min, w, shape, keys, value, out, r, c)


def windowrange(df: DataFrame, w, shape, keys=("image_id",), value="v", out="out", r="r", c="c") -> DataFrame:
    """Maximum less minimum; both share the two sorts."""
    across, down = frames(keys, w, shape, r, c)
    got = df.withColumns({"_hi": F.max(value).over(across), "_lo": F.min(value).over(across)})
    got = got.withColumns({"_hi2": F.max("_hi").over(down), "_lo2": F.min("_lo").over(down)})
    return got.withColumn(out, F.col("_hi2") - F.col("_lo2")).drop("_hi", "_lo", "_hi2", "_lo2")


def windowmean(df: DataFrame, w, shape, keys=("image_id",), value="v", out="out", r="r", c="c") -> DataFrame:
    across, down = frames(keys, w, shape, r, c)
    got = df.withColumns({"_s": F.sum(value).over(across), "_n": F.count(value).over(across)})
    got = got.withColumns({"_s2": F.sum("_s").over(down), "_n2": F.sum("_n").over(down)})
    return got.withColumn(out, F.try_divide("_s2", F.nullif("_n2", F.lit(0)))).drop("_s", "_n", "_s2", "_n2")


def gathered(df: DataFrame, w, shape, keys=("image_id",), value="v", out="vals", r="r", c="c") -> DataFrame:
    """All values in each window, as an array without nulls: w * w values a row, for small windows."""
    across, down = frames(keys, w, shape, r, c)
    return df.withColumn("_l", F.collect_list(value).over(across)).withColumn(out, F.flatten(F.collect_list("_l").over(down))).drop("_l")


def array_median(values: Column) -> Column:
    """Middle value, or the mean of the two middle ones; null if empty."""
    a = F.array_sort(values)
    n = F.size(a)
    low, high = F.get(a, ((n - 1) / 2).cast("int")), F.get(a, (n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def windowmedian(df: DataFrame, w, shape, keys=("image_id",), value="v", out="out", r="r", c="c") -> DataFrame:
    got = gathered(df, w, shape, keys, value, "_g", r, c)
    return got.withColumn(out, array_median(F.col("_g"))).drop("_g")


def windowmedmad(df: DataFrame, w, shape, keys=("image_id",), value="v", med="med", mad="mad", r="r", c="c") -> DataFrame:
    """Median and median absolute deviation from one gathering."""
    got = gathered(df, w, shape, keys, value, "_g", r, c).withColumn(med, array_median(F.col("_g")))
    return got.withColumn(mad, array_median(F.transform("_g", lambda x: F.abs(x - F.col(med))))).drop("_g")


def windowmad(df: DataFrame, w, shape, keys=("image_id",), value="v", out="out", r="r", c="c") -> DataFrame:
    return windowmedmad(df, w, shape, keys, value, "_med", out, r, c).drop("_med")


def count_agreeing(df: DataFrame, w, shape, tolerance: float, keys=("image_id",), value="v", out="out", r="r", c="c") -> DataFrame:
    """How many values in the window are nearer to the centre's than ``tolerance``, itself included; 0 for a null centre."""
    got = gathered(df, w, shape, keys, value, "_g", r, c)
    near = F.size(F.filter("_g", lambda x: F.abs(x - F.col(value)) < tolerance))
    return got.withColumn(out, F.when(F.col(value).isNull(), 0).otherwise(near)).drop("_g")


def integral(df: DataFrame, keys=("image_id",), value: str | Column = "v", out="out", r="r", c="c") -> DataFrame:
    """Summed-area table: the sum over all rows up to r and columns up to c; nulls count as zero."""
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0.0))
    upto = lambda part, order: W.partitionBy(*keys, part).orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    return df.withColumn("_s", F.sum(v).over(upto(r, c))).withColumn(out, F.sum("_s").over(upto(c, r))).drop("_s")


def boxsum(table: DataFrame, h: int, w: int, keys=("image_id",), value="out", out="box", r="r", c="c") -> DataFrame:
    """Sums of h x w boxes whose top left corner is (r, c), from four corners of a summed-area table.

    Boxes that leave the grid give no row. Corners left of or above the grid are zero.
    """
    keys = list(keys)
    corner = table.select(*keys, r, c, F.col(value).alias("_i"))
    parts = []
    for sign, dr, dc in ((1, h - 1, w - 1), (-1, -1, w - 1), (-1, h - 1, -1), (1, -1, -1)):
        parts.append(corner.select(*keys, (F.col(r) - dr).alias(r), (F.col(c) - dc).alias(c), (sign * F.col("_i")).alias("_p"), F.lit(int(dr >= 0 and dc >= 0)).alias("_full")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = every.groupBy(*keys, r, c).agg(F.sum("_p").alias(out), F.max("_full").alias("_f")).where("_f = 1")
    return got.where((F.col(r) >= 1) & (F.col(c) >= 1)).drop("_f")
