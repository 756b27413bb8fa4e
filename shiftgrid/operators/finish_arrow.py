"""Rejection and filling of displacement grids in Arrow: every pass of a block of the grid in one task.

The relational forms are two frame passes a window, sixteen shuffles a level. Here a grid is cut into blocks
with a halo as wide as all passes reach together, so one shuffle brings a block's rows and its surroundings,
and work divides by pair and block whatever a grid's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.window2d import extent
from shiftgrid.params import Gardner
from shiftgrid.registry import OutlierFilter

#: Points of a block's side; with its halo some tens of megabytes of windows.
SIDE = 128


def finish(field: DataFrame, f: Gardner | OutlierFilter | None, upsampling: int, shape: tuple[int, int], fill_window: int | None = None, passes: int = 3, side: int = SIDE,
           keys=("pair_id",), r: str = "gi", c: str = "gj") -> DataFrame:
    """``field(keys, r, c, dx, dy, correlation, radius_x, radius_y, ...)`` with ``keep``, see ``reject_outliers``.
    With a ``fill_window`` rejected values are null and holes filled as ``fill_holes`` does, and
    ``filled`` follows. Rows of every pair need places of their own within ``shape``."""
    halo = f.reach if f else 0
    halo += passes * (fill_window // 2) if fill_window else 0

    def span(x: str, n: int):
        if n <= side:
            return F.array(F.lit(0))
        low, high = (F.floor((F.col(x) - 1 + d) / side).cast("int") for d in (-halo, halo))
        return F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit((n - 1) // side)))

    def finished(key: tuple, t: pa.Table) -> pa.Table:
        top, left = (int(k.as_py()) * side + 1 for k in key[-2:])
        t = t.drop_columns(["_br", "_bc"])
        i, j = t[r].to_numpy(), t[c].to_numpy()
        r0, c0 = int(i.min()), int(j.min())
        at = i - r0, j - c0
        grid = lambda name: _placed(t[name].to_numpy(), at)
        dx, dy = grid("dx"), grid("dy")
        keep = reject(dx, dy, grid("radius_x"), grid("radius_y"), f, upsampling, shape)
        own = (i >= top) & (i < top + side) & (j >= left) & (j < left + side)
        out = t.append_column("keep", pa.array(keep[at]))
        if fill_window:
            dx, dy, filled = fill(np.where(keep, dx, np.nan), np.where(keep, dy, np.nan), fill_window, shape, passes)
            score = np.where(keep[at], t["correlation"].to_numpy(), np.nan)
            for name, v in (("dx", dx[at]), ("dy", dy[at]), ("correlation", score)):
                out = out.set_column(out.column_names.index(name), name, pa.array(v, from_pandas=True))
            out = out.append_column("filled", pa.array(filled[at]))
        return out.filter(pa.array(own))

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in field.schema) + ", keep boolean" + (", filled boolean" if fill_window else "")
    spread = field.withColumn("_br", F.explode(span(r, shape[0]))).withColumn("_bc", F.explode(span(c, shape[1])))
    # Rows are few bytes but work for Python: as many tasks as the session has, not as few as the bytes suggest.
    parts = int(field.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = [*keys, "_br", "_bc"]
    return spread.repartition(parts, *block).groupBy(*block).applyInArrow(finished, kinds)


def _placed(v: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.full((at[0].max() + 1, at[1].max() + 1), np.nan)
    out[at] = v
    return out


def _windows(v: np.ndarray, w: int, shape: tuple[int, int]) -> np.ndarray:
    """(rows, columns, window): the values around every place, NaN beyond the grid."""
    around = extent(w, shape)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(v, around, constant_values=np.nan), tuple(a + b + 1 for a, b in around))
    return view.reshape(*v.shape, -1)


def _median(windows: np.ndarray) -> np.ndarray:
    """The median of what is not NaN along the last axis; NaN if nothing is."""
    a = np.sort(windows, axis=-1)  # NaN come last
    n = np.count_nonzero(~np.isnan(a), axis=-1)
    middle = lambda k: np.take_along_axis(a, np.maximum(k, 0)[..., None], -1)[..., 0]
    return (middle((n - 1) // 2) + middle(n // 2)) / 2


def reject(dx: np.ndarray, dy: np.ndarray, rx: np.ndarray, ry: np.ndarray, f: Gardner | OutlierFilter | None, upsampling: int, shape: tuple[int, int]) -> np.ndarray:
    """Which places of a grid are kept; NaN is missing."""
    keep = ~np.isnan(dx) & ~np.isnan(dy)
    if f is None:
        return keep
    if isinstance(f, OutlierFilter):
        return keep & f.arrays(dx, dy, rx, ry, upsampling, shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = [np.where(r > 0, d / r, np.nan) for d, r in ((dx, rx), (dy, ry))]
        step = [2.0 / (upsampling * r) for r in (rx, ry)]
        keep &= ~np.isnan(scaled[0]) & ~np.isnan(scaled[1])
        for _ in range(f.iterations):
            held = [np.where(keep, s, np.nan) for s in scaled]
            near = [np.count_nonzero(np.abs(_windows(v, f.window, shape) - v[..., None]) < f.agree_tolerance, axis=-1) for v in held]
            keep = keep & (near[0] >= f.min_agree_fraction * f.window**2 - 1e-9) & (near[1] >= f.min_agree_fraction * f.window**2 - 1e-9)
        for _ in range(max(f.iterations - 1, 1)):
            ok = keep
            for s, least in zip(scaled, step, strict=True):
                g = _windows(np.where(keep, s, np.nan), f.window, shape)
                m = _median(g)
                off = _median(np.abs(g - m[..., None]))
                ok = ok & (np.abs(s - m) <= np.fmax(f.mad_scale * off, least) + 1e-12)
            keep = ok
    return keep


def fill(dx: np.ndarray, dy: np.ndarray, w: int, shape: tuple[int, int], passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Holes filled by medians of measured neighbours, and which places those are."""
    filled = np.zeros(dx.shape, bool)
    for _ in range(passes):
        gx = _windows(dx, w, shape)
        hole = np.isnan(dx) & (np.count_nonzero(~np.isnan(gx), axis=-1) >= 2 * w * w // 3)
        if not hole.any():
            break
        new = _median(gx[hole]), _median(_windows(dy, w, shape)[hole])
        dx, dy, filled = dx.copy(), dy.copy(), filled | hole
        dx[hole], dy[hole] = new
    return dx, dy, filled
