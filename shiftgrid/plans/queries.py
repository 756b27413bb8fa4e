"""The registered queries: every operator applied to the driver's tables, whole.

The reference image is ``embeddings`` (a row of pixels a vector); the secondary is the same image
moved by (1, 2), so every interior point has the known displacement (dx, dy) = (-2, -1).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrid.functions import scalar
from shiftgrid.operators import correlate, detect, firstguess, geo, multichip, outliers, peak, points, resample, window2d
from shiftgrid.operators import preprocess as pre
from shiftgrid.operators.correlate_arrow import pack
from shiftgrid.operators.finish_arrow import finish
from shiftgrid.params import Gardner, Preprocess, Rotation, params
from shiftgrid.plans import api
from shiftgrid.shared import shared_path
from shiftgrid.sources import images, planes, raw
from shiftgrid.streaming import series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WIDTH = 64
CHIP, RADIUS, SPACING = 8, 4, 8
P = params(chip_size=8, chip_size_max=16, grid_spacing=8, search_radius=4, min_search_radius=4, preprocess="none", quantize="none", upsampling=8)


def query(f):
    QUERIES[f.__name__] = f
    return f


def rd(c, digits: int = 6):
    """Rounded, and never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reference(spark, d) -> DataFrame:
    return images.scan_image(table(spark, d, "embeddings"), "vec_id", "embedding", "ref")


def secondary(spark, d) -> DataFrame:
    return images.shifted(reference(spark, d), 1, 2, "sec")


def masked(spark, d) -> DataFrame:
    return images.masked(reference(spark, d), (F.col("r") * 31 + F.col("c") * 17) % 23 == 0)


def holed(spark, d) -> DataFrame:
    """The masked image with nulls for invalid pixels."""
    return masked(spark, d).withColumn("v", F.when(F.col("valid"), F.col("v")))


def shape(spark, d) -> tuple[int, int]:
    return int(table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1, WIDTH


def grid(spark, d, chip: int = CHIP) -> DataFrame:
    return points.gridpoints(spark, shape(spark, d), SPACING, chip, search_radius=RADIUS)


def pair(spark, d) -> multichip.Images:
    met = pre.valid_both(pre.image_pair(reference(spark, d), images.shifted(reference(spark, d), 1, 2, "sec", shape(spark, d))))
    return multichip.Images(met.select("pair_id", "r", "c", "ref", "sec", "valid"), shape(spark, d))


def cpixels(spark, d) -> DataFrame:
    return images.complex_image(masked(spark, d), WIDTH // 2)


def field(spark, d) -> DataFrame:
    """A coherent field with planted outliers, gaps and unsearched points, on the grid of the image's pixels."""
    px = reference(spark, d)
    odd, gap, off = (F.col("r") * 7 + F.col("c") * 3) % 29 == 0, (F.col("r") * 5 + F.col("c")) % 17 == 0, (F.col("r") + F.col("c") * 11) % 31 == 0
    dx = 3 + 0.05 * F.col("r") + F.col("v") * 0.1 + F.when(odd, 2.5).otherwise(0.0)
    dy = -2 - 0.05 * F.col("c") + F.col("v") * 0.1
    return px.select(F.lit("p").alias("pair_id"), F.col("r").alias("gi"), F.col("c").alias("gj"), F.when(~gap, dx).alias("dx"), F.when(~gap, dy).alias("dy"),
                     F.when(off, 0).otherwise(8).alias("radius_x"), F.when(off, 0).otherwise(8).alias("radius_y"))


def matches(spark, d) -> DataFrame:
    """Matches turned by 3 degrees about the middle, every 13th moved away."""
    k = table(spark, d, "embeddings").select(F.lit("p").alias("pair_id"), F.col("vec_id").alias("m_id"), F.col("embedding"))
    r = (F.floor(F.col("m_id") / 20) * 5 + F.element_at("embedding", 1).cast("double")).alias("r")
    c = ((F.col("m_id") % 20) * 5 + F.element_at("embedding", 2).cast("double")).alias("c")
    at = k.select("pair_id", "m_id", r, c)
    turn = 0.05235987755982988
    sx, sy = F.col("c") * F.cos(F.lit(turn)) + F.col("r") * F.sin(F.lit(turn)), F.col("r") * F.cos(F.lit(turn)) - F.col("c") * F.sin(F.lit(turn))
    far = F.when(F.col("m_id") % 13 == 0, 40.0).otherwise(0.0)
    return at.withColumns({"dx": F.col("c") - sx + far, "dy": F.col("r") - sy})


# -- scans, sources ---------------------------------------------------------------------------------


@query
def scan_image(spark, d):
    return reference(spark, d).select("image_id", "r", "c", rd("v").alias("v"), "valid")


@query
def raw_planes(spark, d):
    """A field as raw planes in a file, read again in ranges of columns: dx, dy and score one after another."""
    n, m = shape(spark, d)
    path = shared_path(spark, "raw")
    raw.write_raw(field(spark, d).withColumn("correlation", F.lit(0.5)), (n, m), path)
    return planes.scan_planes(spark, path, n, 3 * m, range_bytes=4 * n * 10).select("r", "c", rd("v", 4).alias("v"), "valid")


@query
def image_pair(spark, d):
    got = pre.image_pair(masked(spark, d), images.shifted(reference(spark, d), 1, 2, "sec", shape(spark, d)))
    return got.select("r", "c", rd("ref").alias("ref"), rd("sec").alias("sec"), "ref_valid", "sec_valid")


@query
def valid_both(spark, d):
    got = pre.valid_both(pre.image_pair(masked(spark, d), images.shifted(masked(spark, d), 1, 2, "sec", shape(spark, d))))
    return got.select("r", "c", "valid")


@query
def valid_mask(spark, d):
    bad = reference(spark, d).withColumn("v", F.when((F.col("r") + F.col("c")) % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return pre.valid_mask(bad).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def axes(spark) -> DataFrame:
    rows = [(i, a, o, s, s > 0, True, "EPSG:3413") for i in ("ref", "sec") for a, o, s in (("X", 1000.0, 120.0), ("Y", 9000.0, -120.0))]
    return spark.createDataFrame(rows, "image_id string, axis string, origin double, step double, ascending boolean, regular boolean, crs string")


@query
def grid_coords(spark, d):
    geo.check_aligned(axes(spark), "ref", "sec")
    got = geo.grid_coords(grid(spark, d), axes(spark).where("image_id = 'ref'"))
    return got.select("gi", "gj", "map_x", "map_y")


def supplier_axes(spark, d) -> DataFrame:
    """Two axes a supplier, of steps that its row has; every third is not regular."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), F.col("s_acctbal").cast("double").alias("b"), F.col("s_suppkey").alias("k"))
    axis = lambda name, step, regular: F.struct(F.lit(name).alias("axis"), step.alias("step"), regular.alias("regular"))
    both = F.explode(F.array(axis("X", F.col("b") / 8, F.lit(True)), axis("Y", -F.col("b") / 4, F.col("k") % 3 != 0))).alias("a")
    return s.select("image_id", both).select("image_id", "a.axis", "a.step", "a.regular")


@query
def pixel_size(spark, d):
    return geo.pixel_size(supplier_axes(spark, d)).select("image_id", "axis", rd("pixel_size").alias("pixel_size"))


# -- points -----------------------------------------------------------------------------------------


@query
def gridpoints(spark, d):
    return grid(spark, d).drop("pair_id")


@query
def pointset(spark, d):
    s = table(spark, d, "lineitem")
    coords = s.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pt_id"), (F.col("l_partkey") % 64 + 1).cast("double").alias("x"),
                      (F.col("l_suppkey") % 64 + 1).cast("double").alias("y"), (F.col("l_linenumber") + 2).alias("radius_x"))
    return points.pointset(coords, CHIP, search_radius=RADIUS, dx_prior=1.5).drop("gi", "gj")


@query
def scatter(spark, d):
    return points.scatter(grid(spark, d)).select("pt_id", "gi", "gj", "x", "y")


@query
def decimate(spark, d):
    return points.decimate(grid(spark, d), 3).select("pt_id", "gi", "gj", "x", "y")


@query
def subset(spark, d):
    """Rows in an order of their own, one of them twice, and some columns."""
    n = api.grid_size(shape(spark, d), replace(P, chip_size_max=8))[0]
    return points.subset(grid(spark, d), [*range(n, 0, -2), 3, 3], [5, 1, 2]).select("pt_id", "gi", "gj", "x", "y")


@query
def rebuild(spark, d):
    given = grid(spark, d).select("pair_id", "pt_id", (F.col("pt_id") % 9 / 4).alias("dx_prior"))
    return points.rebuild(grid(spark, d), radius_x=6, y=F.col("y") + 1, dx_prior=given).select("pt_id", "x", "y", "radius_x", "radius_y", "dx_prior")


def uneven(spark, d) -> DataFrame:
    """The grid with radii and priors that vary, some of them zero."""
    return grid(spark, d).withColumns({
        "radius_x": (F.col("pt_id") % 7).cast("int"), "radius_y": (F.col("pt_id") % 5 + 1).cast("int"),
        "dx_prior": F.col("pt_id") % 4 * 0.75 - 1, "dy_prior": F.col("pt_id") % 3 * 0.5})


@query
def sanitize(spark, d):
    return points.sanitize(uneven(spark, d), 3).select("pt_id", "radius_x", "radius_y")


@query
def chip_bounds(spark, d):
    return points.chip_bounds(uneven(spark, d)).select("pt_id", "chip_r0", "chip_r1", "chip_c0", "chip_c1")


@query
def search_bounds(spark, d):
    return points.search_bounds(uneven(spark, d)).select("pt_id", "win_r0", "win_r1", "win_c0", "win_c1")


@query
def surface_size(spark, d):
    return points.surface_size(uneven(spark, d)).select("pt_id", "surf_rows", "surf_cols")


@query
def inbounds(spark, d):
    wide = uneven(spark, d).withColumn("radius_x", F.col("radius_x") * 3)
    return points.inbounds(wide, shape(spark, d)).select("pt_id", "inside")


@query
def searchable_points(spark, d):
    got = uneven(spark, d)
    return got.groupBy().agg(F.count_if(points.searchable()).alias("n_searchable"), F.count(F.lit(1)).alias("n_points"))


@query
def half_pixel_shift(spark, d):
    return points.half_pixel(grid(spark, d), (3, 5)).select("pt_id", "x", "y")


@query
def pass_geometry(spark, d):
    return points.pass_geometry(uneven(spark, d), shape(spark, d)).drop("pair_id")


@query
def level_points(spark, d):
    return points.level_points(uneven(spark, d), uneven(spark, d).where("pt_id % 3 = 0"), 16, 16, 2).select("pt_id", "radius_x", "radius_y", "chip_x", "chip_y")


# -- joins and correlation --------------------------------------------------------------------------


def as_pair(px: DataFrame) -> DataFrame:
    return px.withColumn("pair_id", F.lit("p"))


def surf(spark, d, measure: str = "zncc") -> DataFrame:
    return correlate.surfaces(as_pair(reference(spark, d)), as_pair(secondary(spark, d)), grid(spark, d), measure)


@query
def cut_chip(spark, d):
    return correlate.cut(as_pair(masked(spark, d)), grid(spark, d), "chip").select("pt_id", "i", "j", rd("v").alias("v"), "valid")


@query
def cut_window(spark, d):
    got = correlate.cut(as_pair(reference(spark, d)), grid(spark, d), "window")
    return got.groupBy("pt_id").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("v")).alias("s"), rd(F.sum(F.col("v") * (F.col("i") * 31 + F.col("j")))).alias("w"))


@query
def chip_stats(spark, d):
    got = correlate.chip_stats(correlate.cut(as_pair(secondary(spark, d)), grid(spark, d), "chip"))
    return got.select("pt_id", "n", rd("mean").alias("mean"), rd("norm").alias("norm"), "ok", "any_valid")


@query
def zncc(spark, d):
    return surf(spark, d).select("pt_id", "sy", "sx", rd("score").alias("score"))


@query
def ncc(spark, d):
    return surf(spark, d, "ncc").select("pt_id", "sy", "sx", rd("score").alias("score"))


@query
def coherence(spark, d):
    z = images.complex_image(reference(spark, d), WIDTH // 2)
    sec = images.shifted(z, 1, 2, "sec")
    pts = points.gridpoints(spark, (shape(spark, d)[0], WIDTH // 2), SPACING, CHIP, search_radius=RADIUS)
    got = correlate.surfaces(as_pair(z), as_pair(sec), pts, "coherence")
    return got.select("pt_id", "sy", "sx", rd("score").alias("score"))


@query
def peak_index(spark, d):
    return peak.peak(surf(spark, d)).select("pt_id", "sy", "sx", rd("correlation").alias("correlation"))


@query
def peak_offset(spark, d):
    return peak.peak_offset(surf(spark, d), grid(spark, d)).select("pt_id", "dx", "dy", rd("correlation").alias("correlation"))


@query
def subpixel_peak(spark, d):
    got = peak.subpixel_peak(surf(spark, d), grid(spark, d), 8)
    return got.select("pt_id", rd("dx").alias("dx"), rd("dy").alias("dy"), rd("correlation").alias("correlation"))


@query
def pyrup(spark, d):
    return peak.pyrup(reference(spark, d), shape(spark, d)).select("r", "c", rd("v").alias("v"))


@query
def rotate_chip(spark, d):
    chip = correlate.cut(as_pair(reference(spark, d)), grid(spark, d), "chip")
    return correlate.rotate_chip(chip, 10.0).select("pt_id", "i", "j", rd("v").alias("v"))


ANGLES = (-6.0, 0.0, 6.0)


@query
def rotation_search(spark, d):
    """Surfaces of chips turned by three angles; the best angle of each point."""
    every = correlate.surfaces(as_pair(reference(spark, d)), as_pair(secondary(spark, d)), grid(spark, d), "zncc", None, ANGLES)
    top = peak.best_rotation(every).groupBy("pt_id").agg(F.first("angle_idx").alias("angle_idx"), rd(F.max("score")).alias("peak"))
    return top.select("pt_id", "angle_idx", "peak")


def _turned(tier: str):
    def q(spark, d):
        p = replace(P, rotation=Rotation(ANGLES))
        got = multichip.track(pair(spark, d), grid(spark, d), p, "zncc", 1, tier)
        return got.select("pt_id", "dx", "dy", rd("correlation", 3).alias("correlation"), "searched")

    q.__name__ = f"rotation_track_{tier}"
    query(q)


_turned("rows")
_turned("arrow")


@query
def knn(spark, d):
    return firstguess.knn(matches(spark, d), 5).select("i", "j", rd("d2").alias("d2"), "rank")


@query
def knn_cells(spark, d):
    return firstguess.knn(matches(spark, d), 5, leaf=40).select("i", "j", rd("d2").alias("d2"), "rank")


def altered(keypoints: DataFrame) -> DataFrame:
    """Descriptors with one to three bits flipped, by id."""
    bit = lambda k: F.expr(f"shiftleft(1L, cast(pmod(k_id * {k}, 61) as int))")
    flips = F.when(F.col("k_id") % 3 == 0, bit(1).bitwiseXOR(bit(7)).bitwiseXOR(bit(13))).otherwise(bit(5))
    return keypoints.withColumn("desc", F.transform("desc", lambda w: w.bitwiseXOR(flips)))


@query
def hamming_match(spark, d):
    e = table(spark, d, "embeddings")
    a = images.sign_descriptors(e, "vec_id", "embedding", "ref", 25).withColumn("pair_id", F.lit("p"))
    b = altered(images.sign_descriptors(e, "vec_id", "embedding", "sec", 20).withColumn("pair_id", F.lit("p")))
    return firstguess.hamming_match(a, b, 0.9).drop("pair_id")


@query
def orb_match(spark, d):
    e = table(spark, d, "embeddings")
    a = images.sign_descriptors(e, "vec_id", "embedding", "ref", 25).withColumn("pair_id", F.lit("p"))
    b = altered(images.sign_descriptors(e, "vec_id", "embedding", "sec", 20).withColumn("pair_id", F.lit("p")))
    return firstguess.orb_match(a, b, 0.25).drop("pair_id")


@query
def detect_corners(spark, d):
    packs = pack(reference(spark, d), 256, detect.REACH, shape=shape(spark, d))
    return detect.keypoints(packs, detect.REACH, WIDTH, most=None).select("k_id", "r", "c", rd("score", 9).alias("score"))


@query
def first_guess_images(spark, d):
    """From pixels alone: corners, descriptors, matches, neighbours' agreement, points with priors."""
    s = api.Session(shape(spark, d), P).add(reference(spark, d).unionByName(images.shifted(reference(spark, d), 1, 2, "sec", shape(spark, d))))
    pairs = spark.createDataFrame([("p", "ref", "sec")], "pair_id string, ref_id string, sec_id string")
    return s.first_guess(pairs).select("pt_id", "x", "y", "dx_prior", "dy_prior", "radius_x", "chip_x")


@query
def consistent_matches(spark, d):
    return firstguess.consistent_matches(matches(spark, d)).select("m_id")


@query
def scene_rotation(spark, d):
    return firstguess.scene_rotation(matches(spark, d)).select(rd("degrees").alias("degrees"))


@query
def first_guess(spark, d):
    got = firstguess.first_guess(matches(spark, d), chip_size=8)
    return got.select("pt_id", rd("x").alias("x"), rd("y").alias("y"), rd("dx_prior").alias("dx_prior"), rd("dy_prior").alias("dy_prior"), "radius_x", "chip_x")


@query
def wanted(spark, d):
    pts = grid(spark, d)
    return multichip.wanted(pts, pts.where("pt_id % 4 = 1")).select("pt_id")


@query
def merge_levels(spark, d):
    pts = grid(spark, d)
    lv = lambda k, cs: pts.select("pair_id", "pt_id", F.when(F.col("pt_id") % k == 0, F.col("x") / cs).alias("dx"), (F.col("y") / cs).alias("dy"), F.lit(0.5).alias("correlation"), F.lit(cs).alias("chip_size"), (F.col("pt_id") % 2 == 0).alias("filled"))
    got = multichip.merge_levels(pts, [lv(2, 8), lv(3, 16), lv(5, 32)])
    return got.select("gi", "gj", rd("dx").alias("dx"), "chip_size", "interpolated")


# -- aggregates and tables --------------------------------------------------------------------------


@query
def integral(spark, d):
    return window2d.integral(reference(spark, d)).select("r", "c", rd("out").alias("s"))


@query
def integral_sq(spark, d):
    return window2d.integral(reference(spark, d), value=F.col("v") * F.col("v")).select("r", "c", rd("out").alias("s"))


@query
def boxsum(spark, d):
    return window2d.boxsum(window2d.integral(reference(spark, d)), 8, 5).select("r", "c", rd("box").alias("s"))


@query
def scale01(spark, d):
    return pre.scale01(reference(spark, d)).select("r", "c", rd("v").alias("v"))


@query
def cell_max_radius(spark, d):
    return resample.cell_max_radius(uneven(spark, d), 4, "radius_x").drop("pair_id")


@query
def coarse_fraction(spark, d):
    got = multichip.coarse_fraction(field(spark, d).withColumn("keep", F.col("gi") % 3 == 0))
    return got.select(rd("fraction").alias("fraction"))


@query
def nmeasured(spark, d):
    return multichip.nmeasured(field(spark, d)).select("n")


@query
def ramp_phase(spark, d):
    return pre.ramp_phase(cpixels(spark, d)).select(rd("phase_x").alias("phase_x"), rd("phase_y").alias("phase_y"))


@query
def deramp(spark, d):
    return pre.deramp(cpixels(spark, d)).select("r", "c", rd("z.re").alias("re"), rd("z.im").alias("im"))


# -- windows ----------------------------------------------------------------------------------------


def _window(name: str, f):
    def q(spark, d):
        return f(holed(spark, d), shape(spark, d)).select("r", "c", *(x if isinstance(x, str) else x for x in (rd("out").alias("out"),)))

    q.__name__ = name
    query(q)


_window("windowmax", lambda px, s: window2d.windowmax(px, 5, s))
_window("windowmin", lambda px, s: window2d.windowmin(px, 4, s))
_window("windowrange", lambda px, s: window2d.windowrange(px, (7, 3), s))
_window("windowmean", lambda px, s: window2d.windowmean(px, 5, s))
_window("windowmean_clamped", lambda px, s: window2d.windowmean(px, (100, 3), s))
_window("windowmedian", lambda px, s: window2d.windowmedian(px, 3, s))
_window("windowmad", lambda px, s: window2d.windowmad(px, 3, s))


@query
def windowmedmad(spark, d):
    return window2d.windowmedmad(holed(spark, d), 4, shape(spark, d)).select("r", "c", rd("med").alias("med"), rd("mad").alias("mad"))


@query
def count_agreeing(spark, d):
    return window2d.count_agreeing(holed(spark, d), 5, shape(spark, d), 0.1).select("r", "c", F.col("out").cast("bigint").alias("n"))


# -- filters, quantization --------------------------------------------------------------------------


def _filter(name: str, f):
    def q(spark, d):
        return f(masked(spark, d), shape(spark, d)).select("r", "c", rd("v").alias("v"), "valid")

    q.__name__ = name
    query(q)


_filter("highpass", lambda px, s: pre.highpass(px, 5, s))
_filter("wallis", lambda px, s: pre.wallis(px, 5, s, 0.01))
_filter("erode_mask", lambda px, s: pre.erode_mask(px, 3, s))
_filter("sobel", lambda px, s: pre.sobel(px, 3, s))
_filter("laplacian", lambda px, s: pre.laplacian(px, 3, s))
_filter("decibel", lambda px, s: pre.decibel(px, s))
_filter("quantize_uint8", lambda px, s: pre.quantize_uint8(px))
_filter("quantize_none", lambda px, s: pre.quantize_none(px))
_filter("prepare", lambda px, s: pre.prepare(px, params(preprocess=Preprocess("highpass", 5)), s))
_filter("wallis_gapfill", lambda px, s: pre.wallis_gapfill(px, 5, s))


@query
def filter_identity(spark, d):
    return pre.preprocess(masked(spark, d), Preprocess("none"), shape(spark, d)).select("r", "c", rd("v").alias("v"), "valid")


# -- resampling, outliers, filling ------------------------------------------------------------------


def _resample(name: str, scale: tuple[int, int], columns: int, method: str):
    """Rows are scaled by the fraction ``scale``, so the target grows with the image."""
    def q(spark, d):
        src = shape(spark, d)
        return resample.resample(holed(spark, d), src, (src[0] * scale[0] // scale[1], columns), method).select("r", "c", rd("v").alias("v"))

    q.__name__ = name
    query(q)


_resample("resample_nearest", (3, 2), 40, "nearest")
_resample("resample_area", (5, 12), 24, "area")
_resample("resample_bicubic", (3, 2), 100, "bicubic")


@query
def dilate_within(spark, d):
    m = reference(spark, d).withColumn("m", (F.col("r") * 13 + F.col("c") * 7) % 101 == 0)
    return resample.dilate_within(m, 3.0, shape(spark, d)).select("r", "c", "m")


@query
def distance_transform(spark, d):
    m = reference(spark, d).withColumn("m", (F.col("r") * 13 + F.col("c") * 7) % 1009 == 0)
    return resample.distance_transform(m, shape(spark, d)).select("r", "c", "d2")


@query
def dilate_far(spark, d):
    m = reference(spark, d).withColumn("m", (F.col("r") * 13 + F.col("c") * 7) % 1009 == 0)
    return resample.dilate_within(m, 12.5, shape(spark, d)).select("r", "c", "m")


@query
def reject_outliers(spark, d):
    got = outliers.reject_outliers(field(spark, d), Gardner(), 64, shape(spark, d))
    return got.select("gi", "gj", "keep")


@query
def finish_blocks(spark, d):
    """Rejection and filling of blocks of the grid in one shuffle."""
    f = field(spark, d).withColumn("correlation", F.lit(0.5))
    return finish(f, Gardner(), 64, shape(spark, d), 3).select("gi", "gj", "keep")


@query
def no_outlier_filter(spark, d):
    return outliers.reject_outliers(field(spark, d), None, 64, shape(spark, d)).select("gi", "gj", "keep")


@query
def fill_holes(spark, d):
    got = resample.fill_holes(field(spark, d), 3, shape(spark, d))
    return got.select("gi", "gj", rd("dx").alias("dx"), rd("dy").alias("dy"), "filled")


@query
def velocity(spark, d):
    got = geo.velocity(field(spark, d).withColumn("correlation", F.lit(0.9)), True, 120.0, 120.0, 0.5)
    return got.select("gi", "gj", rd("vx").alias("vx"), rd("vy").alias("vy"))


# -- scalar functions -------------------------------------------------------------------------------


@query
def reflect101(spark, d):
    i = F.col("l_partkey") - F.col("l_suppkey") * 3
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", i.alias("i"), scalar.reflect101(i, 9).cast("bigint").alias("j"))


@query
def dt_years(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", rd(scalar.dt_years(F.col("a"), F.col("b")), 9).alias("years"))


@query
def cubic_weights(spark, d):
    t = (F.col("l_partkey") % 97) / 97.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(rd(w, 9).alias(f"w{k}") for k, w in enumerate(scalar.cubic_weights(t))))


@query
def next_fft_size(spark, d):
    n = (F.col("p_partkey") % 700 + 1).cast("int")
    return table(spark, d, "part").select("p_partkey", n.alias("n"), scalar.fft_size(n, 700).alias("size"))


# -- series and whole plans -------------------------------------------------------------------------


@query
def pair_series(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("site"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("image_id"), F.col("ts").alias("acq_ts"))
    return series.pair_series(e).select("site", "pair_id", "ref_id", "sec_id", rd("years", 9).alias("years"))


@query
def track(spark, d):
    got = multichip.track(pair(spark, d), grid(spark, d), P, "zncc", 8, "rows")
    return got.select("gi", "gj", rd("dx").alias("dx"), rd("dy").alias("dy"), rd("correlation").alias("correlation"), "searched")


@query
def track_arrow(spark, d):
    got = multichip.track(pair(spark, d), grid(spark, d), P, "zncc", 8, "arrow")
    return got.select("gi", "gj", rd("dx").alias("dx"), rd("dy").alias("dy"), rd("correlation", 3).alias("correlation"), "searched")


@query
def track_scattered(spark, d):
    """Points at keys of ``part``, tracked once at their own chips, with whole priors."""
    n, m = shape(spark, d)
    at = table(spark, d, "part").select(F.col("p_partkey").alias("pt_id"), (F.col("p_partkey") % (m - 20) + 10).cast("double").alias("x"), (F.col("p_partkey") * 7 % (n - 20) + 10).cast("double").alias("y"))
    pts = points.pointset(at, CHIP, search_radius=RADIUS, dx_prior=-2.0, dy_prior=-1.0)
    got = multichip.track(pair(spark, d), pts, P, "zncc", 1, "rows")
    return got.select("pt_id", "dx", "dy", rd("correlation").alias("correlation"), "searched")


@query
def coarse_pass(spark, d):
    p = params(chip_size=8, chip_size_max=8, grid_spacing=2, search_radius=4, min_search_radius=4, coarse_stride=4, preprocess="none", quantize="none", upsampling=8)
    s = shape(spark, d)
    pts = points.gridpoints(spark, s, 2, 8, search_radius=4)
    got = multichip.coarse_mask(pair(spark, d), pts, p, 8, 8, "zncc", api.grid_size(s, p), "arrow")
    return got.select("gi", "gj")


@query
def multichip_track(spark, d):
    s = shape(spark, d)
    got = multichip.multichip(pair(spark, d), api.build_grid(spark, s, P), P, api.grid_size(s, P), "arrow")
    return got.select("gi", "gj", rd("dx").alias("dx"), rd("dy").alias("dy"), "chip_size", "interpolated")


@query
def result_layers(spark, d):
    s = shape(spark, d)
    got = multichip.multichip(pair(spark, d), api.build_grid(spark, s, P), P, api.grid_size(s, P), "arrow")
    lay = geo.layers(geo.velocity(got, True)).where("layer <> 'correlation'")
    return lay.select("layer", "gi", "gj", rd("value").alias("value"))


@query
def raster_velocity(spark, d):
    """Pixels and axes to velocities in one call."""
    got = api.track_raster(reference(spark, d), images.shifted(reference(spark, d), 1, 2, "sec", shape(spark, d)), axes(spark), shape(spark, d), 0.5, p=P)
    return got.select("gi", "gj", "map_x", "map_y", rd("vx").alias("vx"), rd("vy").alias("vy"), "chip_size", "crs")


@query
def track_pair(spark, d):
    """The whole of it in one call: preparation, levels, rejection, filling, merge."""
    ref = reference(spark, d)
    got = api.track_pair(ref, images.shifted(ref, 1, 2, "sec", shape(spark, d)), shape(spark, d), chip_size=8, chip_size_max=16, grid_spacing=8, search_radius=4, min_search_radius=4)
    return got.select("gi", "gj", rd("dx").alias("dx"), rd("dy").alias("dy"), "chip_size", "interpolated")



