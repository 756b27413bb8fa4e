"""Tracking, the coarse pass, one chip-size level, and the finest-first merge over levels.

All of it is data-parallel over ``pair_id``: a level's gates are aggregates per pair that are joined
back, so any number of pairs runs in one plan. The driver's loop is over the few chip sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftgrid.operators import correlate, peak, points
from shiftgrid.operators.correlate_arrow import halo_of, tiles, track_packs, track_tiles
from shiftgrid.operators.finish_arrow import finish
from shiftgrid.operators.outliers import reject_outliers
from shiftgrid.operators.resample import cell_max_radius, dilate_within, fill_holes, resample
from shiftgrid.params import Params
from shiftgrid.shared import shared_table

PT = ["pair_id", "pt_id"]
#: Products of chip pixels and shifts beyond which the pixel-row form gives way to packed tiles.
PIXEL_ROW_LIMIT = 1e8


@dataclass(frozen=True)
class Images:
    """Prepared pairs: ``pair(pair_id, r, c, ref, sec, valid)``; ``complex_`` values are structs.

    ``packs`` and ``pairs``, where they are given, are the images' packed tiles with a halo of ``halo`` and the
    pairs of them, which every level and coarse pass reads instead of packing pixels again.
    """

    pair: DataFrame | None
    shape: tuple[int, int]
    complex_: bool = False
    packs: DataFrame | None = None
    pairs: DataFrame | None = None
    tile: int = 256
    halo: int = 0

    def side(self, which: str) -> DataFrame:
        name = "z" if self.complex_ else "v"
        return self.pair.select("pair_id", "r", "c", F.col(which).alias(name), "valid")


def track(images: Images, pts: DataFrame, p: Params, measure: str = "zncc", upsampling: int | None = None, tier: str = "arrow", tile: int = 256, halo: int | None = None) -> DataFrame:
    """``pts`` with dx, dy, correlation (null where nothing was measured) and searched.

    ``tier``: "rows" for the relational form (small geometries, checked against SQL), "arrow" for packed
    tiles, "auto" for rows up to ``PIXEL_ROW_LIMIT`` products. All take chips from the secondary and windows
    from the reference image. ``halo`` of the tiles: that of the points, unless the caller knows it.
    """
    if tier == "auto":
        tier = "rows" if products(pts) * len(p.rotation.tried() if p.rotation else "1") <= PIXEL_ROW_LIMIT else "arrow"
    up = p.upsampling if upsampling is None else upsampling
    angles = p.rotation.tried() if p.rotation else (0.0,)
    if tier == "arrow":
        live = pts.where(points.searchable())
        need = reach(live) if halo is None else halo
        if images.packs is not None and need <= images.halo:
            got = track_packs(images.packs, images.pairs, live, images.tile, images.shape, up, measure, angles)
        else:
            got = track_tiles(tiles(images.pair, tile, need, images.complex_), live, tile, up, measure, angles)
        out = pts.join(got, PT, "left")
        return out.withColumn("searched", F.coalesce("searched", F.lit(False)))
    if tier != "rows":
        raise ValueError(f"tier: {tier!r} is none of rows, arrow, auto")
    moved = points.half_pixel(pts.where(points.searchable()))
    ref, sec = images.side("ref"), images.side("sec")
    mask = images.pair.where("valid").select("pair_id", "r", "c")
    surf = correlate.surfaces(ref, sec, moved, measure, mask, angles)
    if "angle_idx" in surf.columns:
        surf = peak.best_rotation(surf).drop("angle_idx")
    field = peak.subpixel_peak(surf, moved, up)
    # Searched is a point whose chip has a valid pixel, textured or not; no need of its surface.
    seen = correlate.live(moved, mask).withColumn("searched", F.lit(True))
    out = pts.hint("merge").join(field, PT, "left").hint("merge").join(seen, PT, "left")
    return out.withColumn("searched", F.coalesce("searched", F.lit(False)))


def products(pts: DataFrame) -> float:
    """Chip pixels times shifts, summed over the searchable points: one number to the driver."""
    one = F.col("chip_x").cast("double") * F.col("chip_y") * 4 * F.col("radius_x") * F.col("radius_y")
    return pts.where(points.searchable()).agg(F.sum(one)).first()[0] or 0.0


def widest_of(pts: DataFrame, *names: str) -> tuple:
    """The largest of ``names``, of both radii and of the priors' sizes: one row of maxima to the driver."""
    every = [*(F.max(n) for n in (*names, "radius_x", "radius_y")), F.max(F.greatest(F.abs("dx_prior"), F.abs("dy_prior")))]
    return tuple(v or 0 for v in pts.agg(*(c.alias(f"_{k}") for k, c in enumerate(every))).first())


def reach(pts: DataFrame) -> int:
    """The halo of tiles that holds every chip and window of ``pts``."""
    return halo_of(*widest_of(pts, "chip_x", "chip_y"))


def nmeasured(field: DataFrame) -> DataFrame:
    """Per pair the points that have a displacement: (pair_id, n)."""
    return field.groupBy("pair_id").agg(F.count("dx").alias("n"))


def coarse_fraction(coarse: DataFrame) -> DataFrame:
    """Per pair, the part of measured coarse points that was kept: (pair_id, fraction)."""
    ok = F.col("dx").isNotNull() & (F.col("radius_x") > 0)
    got = coarse.groupBy("pair_id").agg(F.sum((ok & F.col("keep")).cast("long")).alias("_k"), F.sum(ok.cast("long")).alias("_n"))
    return got.select("pair_id", F.try_divide("_k", "_n").alias("fraction"))


def coarse_mask(images: Images, pts: DataFrame, p: Params, chip_x: int, chip_y: int, measure: str, grid: tuple[int, int], tier: str, halo: int | None = None) -> DataFrame | None:
    """``(pair_id, gi, gj)`` of grid points near a coherent coarse estimate; None where the grid is too small
    to judge and everything is searched."""
    s = p.coarse_stride
    small = (grid[0] // s, grid[1] // s)
    w = p.outliers.window if p.outliers else 1
    if small[0] < w or small[1] < w:
        return None
    coarse = points.decimate(pts, s).drop("radius_x", "radius_y")
    for axis in "xy":
        coarse = coarse.join(cell_max_radius(pts, s, f"radius_{axis}"), ["pair_id", "gi", "gj"])
    coarse = coarse.withColumns({"chip_x": F.lit(chip_x), "chip_y": F.lit(chip_y)}).select(*pts.columns)
    # Points are few against pixels: what was tracked is written, so that gates and windows never track it again.
    found, relaxed = track(images, coarse, p, measure, 1, tier, halo=halo), p.outliers.relaxed() if p.outliers else None
    judged = finish(found, relaxed, p.upsampling, small) if tier == "arrow" else reject_outliers(shared_table(found, "coarse"), relaxed, p.upsampling, small)
    judged = shared_table(judged, "judged")
    enough = coarse_fraction(judged).where(F.col("fraction") >= p.min_coarse_valid_fraction).select("pair_id")
    kept = judged.join(enough, "pair_id", "left_semi").select("pair_id", F.col("gi").alias("r"), F.col("gj").alias("c"), "keep")
    grown = dilate_within(kept, p.coarse_buffer, small, ("pair_id",), "keep").withColumn("keep", F.col("keep").cast("double"))
    full = resample(grown, small, grid, "nearest", ("pair_id",), "keep")
    return full.where("keep > 0.5").select("pair_id", F.col("r").alias("gi"), F.col("c").alias("gj"))


def chipsize_level(images: Images, grid_pts: DataFrame, p: Params, chip_size: int, wanted: DataFrame, measure: str, grid: tuple[int, int], tier: str = "arrow", widest: tuple | None = None) -> DataFrame:
    """One chip size: coarse pass, fine pass where it was coherent, rejection, filling. The points with
    dx, dy, correlation, filled, chip_size. ``widest`` of the grid: where the caller knows it."""
    chip_y = p.chip_height(chip_size)
    pts = points.level_points(grid_pts, wanted, chip_size, chip_y, p.min_search_radius)
    halo = None
    if tier == "arrow":
        # From the grid, so that neither the coarse pass nor finer levels run once more for it.
        radius_x, radius_y, prior = widest or widest_of(grid_pts)
        halo = halo_of(chip_size, chip_y, max(radius_x, p.min_search_radius), max(radius_y, p.min_search_radius), prior)
    near = coarse_mask(images, pts, p, chip_size, chip_y, measure, grid, tier, halo)
    if near is not None:
        hit = pts.join(near.withColumn("_in", F.lit(True)), ["pair_id", "gi", "gj"], "left")
        pts = hit.withColumns({f"radius_{a}": F.when(F.col("_in").isNotNull(), F.col(f"radius_{a}")).otherwise(0) for a in "xy"}).select(*pts.columns)
    tracked = track(images, pts, p, measure, None, tier, halo=halo)
    if tier == "arrow":
        return finish(tracked, p.outliers, p.upsampling, grid, p.fill_window).drop("keep", "searched").withColumn("chip_size", F.lit(chip_size))
    fine = reject_outliers(shared_table(tracked, "tracked"), p.outliers, p.upsampling, grid)
    names = ("dx", "dy", "correlation")
    kept = fine.withColumns({k: F.when(F.col("keep"), F.col(k)) for k in names}).drop("keep", "searched")
    return fill_holes(kept, p.fill_window, grid).withColumn("chip_size", F.lit(chip_size))


def wanted(pts: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """Points that no finer level resolved."""
    ids = pts.select(*PT)
    return ids if resolved is None else ids.join(resolved.select(*PT), PT, "left_anti")


def merge_levels(pts: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Of the levels that have a value at a point the one of the smallest chip; chip_size 0 for none."""
    every = None
    for lv in levels:
        got = lv.where("dx is not null").select(*PT, "dx", "dy", "correlation", "chip_size", F.col("filled").alias("interpolated"))
        every = got if every is None else every.unionByName(got)
    first = every.withColumn("_k", F.row_number().over(W.partitionBy(*PT).orderBy("chip_size"))).where("_k = 1").drop("_k")
    out = pts.select(*PT, "gi", "gj", "x", "y").join(first, PT, "left")
    return out.select("pair_id", "gi", "gj", "x", "y", "dx", "dy", "correlation", F.coalesce("chip_size", F.lit(0)).alias("chip_size"), F.coalesce("interpolated", F.lit(False)).alias("interpolated"))


def multichip(images: Images, pts: DataFrame, p: Params, grid: tuple[int, int], tier: str = "arrow", stop=None) -> DataFrame:
    """Every level, finest chip first; coarser ones only see points still missing.

    ``stop(df)`` writes a level, so that the next ones and the merge do not compute it again; the default
    writes to the shared folder.
    """
    stop = stop or (lambda df: shared_table(df, "level"))
    levels: list[DataFrame] = []
    resolved = None
    widest = widest_of(pts) if tier == "arrow" else None
    for chip, measure in zip(p.chip_sizes(), p.measures(), strict=True):
        left = wanted(pts, resolved)
        level = chipsize_level(images, pts, p, chip, left, measure, grid, tier, widest)
        level = stop(level)
        levels.append(level)
        done = level.where("dx is not null").select(*PT)
        resolved = done if resolved is None else resolved.unionByName(done)
    return merge_levels(pts, levels)
