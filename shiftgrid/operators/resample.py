"""Grid resampling, mask dilation and hole filling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftgrid.functions.scalar import cubic_weights
from shiftgrid.operators.window2d import array_median, gathered


def _axis(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias(name))


def _taps(spark: SparkSession, src: int, dst: int, method: str, to: str, at: str, w: str) -> DataFrame:
    """(to, at, w): which source samples of one axis make each destination sample, and their weights."""
    s = src / dst
    k = _axis(spark, dst, to)
    if method == "nearest":
        one = F.least(F.greatest(F.floor((F.col(to) - 0.5) * s) + 1, F.lit(1)), F.lit(src)).cast("int")
        return k.select(to, one.alias(at), F.lit(1.0).alias(w))
    if method == "area":
        lo, hi = (F.col(to) - 1) * s, F.col(to) * s
        got = k.withColumn(at, F.explode(F.sequence(F.greatest(F.floor(lo) + 1, F.lit(1)).cast("int"), F.least(F.ceil(hi), F.lit(src)).cast("int"))))
        return got.withColumn(w, F.least(hi, F.col(at).cast("double")) - F.greatest(lo, (F.col(at) - 1).cast("double"))).where(F.col(w) > 0)
    if method == "bicubic":
        x = (F.col(to) - 0.5) * s - 0.5
        ws = cubic_weights(x - F.floor(x))
        taps = F.array(*(F.struct(F.least(F.greatest(F.floor(x) + d, F.lit(1)), F.lit(src)).cast("int").alias(at), ws[d].alias(w)) for d in range(4)))
        return k.select(to, F.explode(taps).alias("t")).select(to, f"t.{at}", f"t.{w}")
    raise ValueError(f"method: {method!r} is none of nearest, area, bicubic")


def resample(grid: DataFrame, src: tuple[int, int], dst: tuple[int, int], method: str, keys=("image_id",), value: str = "v") -> DataFrame:
    """Grids of shape ``src`` to shape ``dst``. Missing samples are skipped and weights renormalised; a bicubic
    sample needs half of its weight. Axis tables (a few rows a destination row) are the broadcast sides."""
    keys = list(keys)
    spark = grid.sparkSession
    rows, cols = _taps(spark, src[0], dst[0], method, "r2", "r", "wr"), _taps(spark, src[1], dst[1], method, "c2", "c", "wc")
    met = grid.select(*keys, "r", "c", F.col(value).alias("_v")).join(rows, "r").join(cols, "c")
    w = F.col("wr") * F.col("wc")
    got = met.groupBy(*keys, "r2", "c2").agg(F.sum(w * F.col("_v")).alias("_a"), F.sum(F.when(F.col("_v").isNotNull(), w)).alias("_w"))
    enough = F.col("_w") >= 0.5 if method == "bicubic" else F.col("_w") > 0
    return got.select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c"), F.when(enough, F.col("_a") / F.col("_w")).alias(value))


#: Rows of a block whose envelopes one task builds together.
BLOCK_ROWS = 64


def distance_transform(grid: DataFrame, shape: tuple[int, int], keys=("image_id",), value: str = "m") -> DataFrame:
    """``(keys, r, c, d2)``: of every place of the grids' ``shape`` the exact squared Euclidean distance to the nearest
    true cell of ``value``, null where a grid has none.

    Along columns the nearest true rows above and below are two ordered windows over the rows that columns have; along rows
    the distances are the lower envelope of one parabola a column, built in whole numbers for a block of rows a task.
    """
    keys = list(keys)
    n, m = shape
    true = grid.where(F.col(value)).select(*keys, "r", "c").distinct()
    # A line of each block of rows tells what is nearest outside of it; within a block the task sees its own cells.
    blocks = -(-n // BLOCK_ROWS)
    own = true.withColumn("_b", F.floor((F.col("r") - 1) / BLOCK_ROWS).cast("int"))
    cells = own.groupBy(*keys, "_b", "c").agg(F.sort_array(F.collect_list("r")).alias("rows"), F.min("r").alias("low"), F.max("r").alias("high"))
    every = true.select(*keys, "c").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    up, down = (W.partitionBy(*keys, "c").orderBy("_b").rowsBetween(*s) for s in ((W.unboundedPreceding, -1), (1, W.unboundedFollowing)))
    near = every.join(cells, [*keys, "_b", "c"], "left").withColumns({"above": F.last("high", True).over(up), "below": F.first("low", True).over(down)})
    near = near.select(*keys, "_b", "c", "rows", "above", "below")
    empty = grid.select(*keys).distinct().join(true.select(*keys).distinct(), keys, "left_anti") if keys else None

    def enveloped(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        top = int(key[-1]) * BLOCK_ROWS + 1
        h = min(BLOCK_ROWS, n - top + 1)
        line = np.arange(top, top + h)
        g = np.full((h, m), FAR, np.int64)
        for c, rows, above, below in zip(df["c"], df["rows"], df["above"], df["below"], strict=True):
            at = [x for x in (above, *(rows if rows is not None else ()), below) if x is not None and x == x]
            at = np.array(at, np.int64)
            k = np.searchsorted(at, line)
            up, down = at[np.maximum(k - 1, 0)], at[np.minimum(k, len(at) - 1)]
            g[:, int(c) - 1] = np.minimum(np.abs(line - up), np.abs(line - down))
        d2 = envelope(g)
        i, j = np.mgrid[0:h, 0:m]
        out = {k: [v] * d2.size for k, v in zip(keys, key, strict=False)}
        return pd.DataFrame(out | {"r": i.ravel() + top, "c": j.ravel() + 1, "d2": d2.ravel()})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.select(*keys).schema)
    got = near.groupBy(*keys, "_b").applyInPandas(enveloped, f"{kinds}{', ' if kinds else ''}r int, c int, d2 bigint")
    if empty is None:
        return got
    places = empty.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(m))))
    return got.unionByName(places.withColumn("d2", F.lit(None).cast("bigint")))


#: A distance along a column that has no true cell.
FAR = 1 << 30


def envelope(g: np.ndarray) -> np.ndarray:
    """Of each line the least (x - u)^2 + g(u)^2 over all u, whole numbers: all lines' parabolas are stacked in step."""
    h, m = g.shape
    f = g * g
    rows = np.arange(h)
    who, since, depth = np.zeros((h, m + 1), np.int64), np.zeros((h, m + 1), np.int64), np.full(h, -1)
    for u in range(m):
        add = np.flatnonzero(g[:, u] < FAR)
        if not len(add):
            continue
        left = add
        while len(left):  # parabolas that lie above this one where they begin are taken off
            left = left[depth[left] >= 0]
            w, s = who[left, depth[left]], since[left, depth[left]]
            under = (s - w) ** 2 + f[left, w] > (s - u) ** 2 + f[left, u]
            left = left[under]
            depth[left] -= 1
        some = depth[add] >= 0
        w = who[add, np.maximum(depth[add], 0)]
        start = np.where(some, 1 + (u * u - w * w + f[add, u] - f[add, w]) // np.maximum(2 * (u - w), 1), 0)
        put = (start < m) | ~some
        add, start = add[put], start[put]
        depth[add] += 1
        who[add, depth[add]], since[add, depth[add]] = u, start
    out = np.empty_like(f)
    for x in range(m - 1, -1, -1):
        w = who[rows, np.maximum(depth, 0)]
        out[:, x] = (x - w) ** 2 + f[rows, w]
        done = (depth > 0) & (since[rows, np.maximum(depth, 0)] == x)
        depth[done] -= 1
    return out


#: Offsets of a disc up to which a dilation explodes them; a larger one takes the distance transform.
OFFSETS = 256


def dilate_within(grid: DataFrame, radius: float, shape: tuple[int, int], keys=("image_id",), value: str = "m") -> DataFrame:
    """``value`` true wherever a true cell is within Euclidean ``radius``, whatever that is. Offsets of a small disc are
    exploded on the true cells alone, and duplicates fall together before the join back; larger ones compare distances."""
    keys = list(keys)
    n = int(radius)
    if (2 * n + 1) ** 2 <= OFFSETS * 4 / 3:
        disc = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if a * a + b * b <= radius * radius]
        around = F.array(*(F.struct((F.col("r") + a).cast("int").alias("r"), (F.col("c") + b).cast("int").alias("c")) for a, b in disc))
        hit = grid.where(F.col(value)).select(*keys, F.explode(around).alias("p")).select(*keys, "p.r", "p.c")
        hit = hit.where(F.col("r").between(1, shape[0]) & F.col("c").between(1, shape[1])).distinct()
    else:
        hit = distance_transform(grid, shape, keys, value).where(F.col("d2") <= radius * radius).select(*keys, "r", "c")
    hit = hit.withColumn("_hit", F.lit(True))
    return grid.drop(value).join(hit, [*keys, "r", "c"], "left").withColumn(value, F.coalesce("_hit", F.lit(False))).drop("_hit")


def fill_holes(field: DataFrame, w: int, shape: tuple[int, int], keys=("pair_id",), passes: int = 3, r="gi", c="gj") -> DataFrame:
    """Missing points with at least two thirds of a window measured take the neighbours' medians of dx and dy.

    Each pass sees the field as the last one left it. ``filled`` marks them; their correlation stays null.
    """
    needed = 2 * w * w // 3
    names = field.columns
    got = field.withColumn("filled", F.lit(False))
    for _ in range(passes):
        pairs = gathered(got.withColumn("_d", F.when(F.col("dx").isNotNull(), F.struct("dx", "dy"))), w, shape, keys, "_d", "_g", r, c)
        hole = F.col("dx").isNull() & (F.size("_g") >= needed)
        med = lambda k: array_median(F.transform("_g", lambda s: s[k]))
        got = pairs.withColumns({"_h": hole, "_mx": F.when(hole, med("dx")), "_my": F.when(hole, med("dy"))})
        got = got.withColumns({"dx": F.coalesce("dx", "_mx"), "dy": F.when(F.col("_h"), F.col("_my")).otherwise(F.col("dy")), "filled": F.col("filled") | F.col("_h")})
        got = got.select(*names, "filled")
    return got


def cell_max_radius(pts: DataFrame, stride: int, column: str) -> DataFrame:
    """Per coarse cell the largest radius in the left-biased ``stride`` window about its point: (pair_id, gi, gj, column)."""
    lo, hi = stride // 2, stride - 1 - stride // 2
    to = F.array(*(F.struct((F.col("gi") + a).alias("gi"), (F.col("gj") + b).alias("gj")) for a in range(-hi, lo + 1) for b in range(-hi, lo + 1)))
    near = pts.select("pair_id", column, F.explode(to).alias("t")).select("pair_id", column, "t.gi", "t.gj")
    on = (F.col("gi") % stride == 0) & (F.col("gj") % stride == 0)
    near = near.where(on).join(pts.where(on).select("pair_id", "gi", "gj"), ["pair_id", "gi", "gj"], "left_semi")
    got = near.groupBy("pair_id", "gi", "gj").agg(F.max(column).alias(column))
    return got.withColumns({"gi": (F.col("gi") / stride).cast("int"), "gj": (F.col("gj") / stride).cast("int")})
