"""Whole scenes in one task: preparation, coarse passes, every chip size, rejection, filling and the merge of many pairs.

For scenes that a task holds the tiles of ``correlate_arrow`` only move data: here consecutive pairs form blocks, a block's
scenes are shipped to one task, each is prepared there once for all of the block's pairs, and no level is written. One
shuffle in all. Passes and gates are those of ``multichip``, which larger scenes and points of one's own take.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid import registry
from shiftgrid.operators import kernels
from shiftgrid.operators.finish_arrow import fill, reject
from shiftgrid.params import Params, search_margin
from shiftgrid.shared import shared_table

#: Pairs of a block at most, and bytes of its scenes; pixels of a scene that a task takes whole.
PAIRS, BLOCK_BYTES, SCENE_PIXELS = 8, 128 << 20, 4 << 20
RESULT = "pair_id string, gi int, gj int, x double, y double, dx double, dy double, correlation double, chip_size int, interpolated boolean"


def grid_of(shape: tuple[int, int], p: Params) -> dict[str, np.ndarray]:
    """The search grid of ``points.gridpoints`` as arrays of its shape."""
    mx, my = search_margin(p.chip_size_max, p.radius_x), search_margin(p.chip_height(p.chip_size_max), p.radius_y)
    x, y = (np.arange(m + 1, n - m + 1, p.grid_spacing, dtype=float) for m, n in ((mx, shape[1]), (my, shape[0])))
    if not len(x) or not len(y):
        raise ValueError(f"no search centre fits in a {shape[0]} x {shape[1]} image: {my} x {mx} pixels are needed on each side")
    yy, xx = np.meshgrid(y, x, indexing="ij")
    return {"x": xx, "y": yy}


def _tracked(images: tuple, grid: dict[str, np.ndarray], rx: np.ndarray, ry: np.ndarray, chip: tuple[int, int], p: Params, up: int, measure) -> dict[str, np.ndarray]:
    n, shape = rx.size, rx.shape
    pts = {"x": grid["x"].ravel(), "y": grid["y"].ravel(), "radius_x": rx.ravel(), "radius_y": ry.ravel(), "dx_prior": np.full(n, p.dx_prior), "dy_prior": np.full(n, p.dy_prior),
           "chip_x": np.full(n, chip[0]), "chip_y": np.full(n, chip[1])}
    got = kernels.track(*images, pts, 1, 1, up, measure, p.rotation.tried() if p.rotation else (0.0,))
    return {k: got[k].reshape(shape) for k in ("dx", "dy", "correlation")}


def near_coarse(images: tuple, grid: dict[str, np.ndarray], rx: np.ndarray, ry: np.ndarray, chip: tuple[int, int], p: Params, measure) -> np.ndarray | None:
    """Grid points near a coherent coarse estimate, as ``multichip.coarse_mask``; None where the grid is too small to judge."""
    s, shape = p.coarse_stride, rx.shape
    small = shape[0] // s, shape[1] // s
    w = p.outliers.window if p.outliers else 1
    if min(small) < w:
        return None
    lo, hi = s // 2, s - 1 - s // 2
    pad = lambda r: np.lib.stride_tricks.sliding_window_view(np.pad(r, ((lo, hi), (lo, hi))), (s, s)).max(axis=(2, 3))[s - 1 :: s, s - 1 :: s]
    cx, cy = pad(rx), pad(ry)
    at = {k: v[s - 1 :: s, s - 1 :: s] for k, v in grid.items()}
    got = _tracked(images, at, cx, cy, chip, p, 1, measure)
    keep = reject(got["dx"], got["dy"], cx, cy, p.outliers.relaxed() if p.outliers else None, p.upsampling, small)
    seen = ~np.isnan(got["dx"]) & (cx > 0)
    if not seen.any() or np.count_nonzero(seen & keep) < p.min_coarse_valid_fraction * np.count_nonzero(seen):
        return np.zeros(shape, bool)
    n = int(p.coarse_buffer)
    wide = np.pad(keep, n)
    grown = np.zeros(small, bool)
    for a in range(-n, n + 1):
        for b in range(-n, n + 1):
            if a * a + b * b <= p.coarse_buffer * p.coarse_buffer:
                grown |= wide[n + a : n + a + small[0], n + b : n + b + small[1]]
    i, j = (np.clip(np.floor((np.arange(1, to + 1) - 0.5) * (of / to)).astype(int), 0, of - 1) for to, of in zip(shape, small, strict=True))
    return grown[i][:, j]


def track_scene(ref: np.ndarray, sec: np.ndarray, valid: np.ndarray, p: Params, measures: tuple, grid: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Every chip size of one pair of prepared scenes: arrays over the search grid, NaN and 0 where nothing was measured."""
    images = ref, sec, valid
    grid = grid_of(ref.shape, p) if grid is None else grid
    shape = grid["x"].shape
    out = {k: np.full(shape, np.nan) for k in ("dx", "dy", "correlation")} | {"chip_size": np.zeros(shape, int), "interpolated": np.zeros(shape, bool)}
    for chip_x, measure in zip(p.chip_sizes(), measures, strict=True):
        chip = chip_x, p.chip_height(chip_x)
        wanted = out["chip_size"] == 0
        if not wanted.any():
            break
        live = wanted if p.radius_x > 0 and p.radius_y > 0 else np.zeros(shape, bool)
        rx, ry = (np.where(live, max(r, p.min_search_radius), 0) for r in (p.radius_x, p.radius_y))
        near = near_coarse(images, grid, rx, ry, chip, p, measure)
        if near is not None:
            rx, ry = np.where(near, rx, 0), np.where(near, ry, 0)
        got = _tracked(images, grid, rx, ry, chip, p, p.upsampling, measure)
        keep = reject(got["dx"], got["dy"], rx, ry, p.outliers, p.upsampling, shape)
        dx, dy, filled = fill(*(np.where(keep, got[k], np.nan) for k in ("dx", "dy")), p.fill_window, shape, 3)
        new = wanted & ~np.isnan(dx)
        for k, v in (("dx", dx), ("dy", dy), ("correlation", np.where(keep, got["correlation"], np.nan)), ("chip_size", chip_x), ("interpolated", filled)):
            out[k] = np.where(new, v, out[k])
    return out


def track_scenes(planes: DataFrame, pairs: DataFrame, shape: tuple[int, int], p: Params) -> DataFrame:
    """``planes(image_id, ny, nx, data)``, row-major 32-bit floats, and ``pairs(pair_id, ref_id, sec_id)`` to the merged
    fields of all pairs, as ``multichip`` gives them. A pair whose scene is not there has no rows; a scene of another
    shape is an error."""
    kind, bytes_ = p.preprocess, p.quantize == "uint8"
    own_filter, own_quantize = registry.own("preprocess", kind.kind), registry.own("quantize", p.quantize)
    filtered = (lambda v, ok, f=own_filter.arrays: f(v, ok, kind)) if own_filter else None
    coded = own_quantize.arrays if own_quantize else None
    width = kind.width if kind.kind == "highpass" else 0
    measures = tuple(registry.own("similarity", m) or m for m in p.measures())
    p = replace(p, similarity=("zncc",))  # methods travel by themselves
    each = 1
    while each < PAIRS and (2 * each + 1) * 4 * shape[0] * shape[1] <= BLOCK_BYTES:
        each *= 2
    # Neighbours in order share scenes. A partition's rows are numbered from a multiple of 2^33, so blocks do not mix partitions.
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.select("pair_id", "ref_id", "sec_id").repartitionByRange(tasks, "ref_id", "sec_id", "pair_id").sortWithinPartitions("ref_id", "sec_id", "pair_id")
    block = F.floor(F.monotonically_increasing_id() / each).cast("bigint").alias("block")
    blocks = shared_table(ordered.select(block, "pair_id", "ref_id", "sec_id"), "blocks")  # numbers are drawn once
    asked = blocks.select("block", F.explode(F.array("ref_id", "sec_id")).alias("image_id")).distinct()
    scenes = asked.join(planes.select("image_id", "ny", "nx", "data"), "image_id")
    names = ["pair_id", "gi", "gj", "x", "y", "dx", "dy", "correlation", "chip_size", "interpolated"]

    def tracked(images: pa.Table, of: pa.Table) -> pa.Table:
        ready = {}
        for name, ny, nx, data in zip(*(images[c] for c in ("image_id", "ny", "nx", "data")), strict=True):
            if (ny.as_py(), nx.as_py()) != tuple(shape):
                raise ValueError(f"the scene {name.as_py()} is {ny.as_py()} x {nx.as_py()}, not {shape[0]} x {shape[1]}")
            ready[name.as_py()] = kernels.prepare(np.frombuffer(data.as_buffer(), np.float32).reshape(shape), width, bytes_, filtered, coded)
        grid = grid_of(shape, p)
        gi, gj = (k.ravel() + 1 for k in np.indices(grid["x"].shape, dtype=np.int32))
        parts = []
        for pair, a, b in zip(*(of[c].to_pylist() for c in ("pair_id", "ref_id", "sec_id")), strict=True):
            if a not in ready or b not in ready:
                continue
            (ref, ok), (sec, good) = ready[a], ready[b]
            got = {k: v.ravel() for k, v in track_scene(ref, sec, ok & good, p, measures, grid).items()}
            columns = [pa.array([pair] * len(gi), pa.string()), pa.array(gi), pa.array(gj), pa.array(grid["x"].ravel()), pa.array(grid["y"].ravel()),
                       *(pa.array(got[k], from_pandas=True) for k in ("dx", "dy", "correlation")), pa.array(got["chip_size"], pa.int32()), pa.array(got["interpolated"])]
            parts.append(pa.RecordBatch.from_arrays(columns, names=names))
        kinds = pa.schema([("pair_id", pa.string()), *((k, pa.int32()) for k in ("gi", "gj")), *((k, pa.float64()) for k in ("x", "y", "dx", "dy", "correlation")), ("chip_size", pa.int32()), ("interpolated", pa.bool_())])
        return pa.Table.from_batches(parts, kinds)

    # Blocks are few bytes but work for Python: more tasks than the session has, as hashes deal them unevenly.
    dealt = lambda df: df.toDF(*df.columns).repartition(4 * tasks, "block").groupBy("block")
    return dealt(scenes).cogroup(dealt(blocks)).applyInArrow(tracked, RESULT)
