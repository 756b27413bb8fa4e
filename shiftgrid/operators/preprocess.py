"""Per-image filters and quantization over pixel rows (image_id, r, c, v, valid).

Filters return the same columns: ``v`` is 0 where the result is not valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftgrid import registry
from shiftgrid.functions.scalar import c_conj_mul, c_mul
from shiftgrid.operators.window2d import windowmean, windowmin
from shiftgrid.params import Preprocess
from shiftgrid.schema import is_finite

KEYS = ("image_id",)


def valid_mask(pixels: DataFrame) -> DataFrame:
    """``valid``: the value is finite. Zero is valid."""
    return pixels.withColumn("valid", is_finite(F.col("v")))


def image_pair(reference: DataFrame, secondary: DataFrame, pair_id: str = "p") -> DataFrame:
    """Two images of one extent, pixel by pixel: (pair_id, r, c, ref, sec, ref_valid, sec_valid).

    A pixel that only one image has is an error when the plan runs.
    """
    a = reference.select("r", "c", F.col("v").alias("ref"), F.col("valid").alias("ref_valid"), F.lit(1).alias("_a"))
    b = secondary.select("r", "c", F.col("v").alias("sec"), F.col("valid").alias("sec_valid"), F.lit(1).alias("_b"))
    met = a.hint("merge").join(b, ["r", "c"], "full")
    ok = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(pair_id)).otherwise(F.raise_error(F.lit("the images of a pair must have one shape")))
    return met.select(ok.alias("pair_id"), "r", "c", "ref", "sec", "ref_valid", "sec_valid")


def valid_both(pair: DataFrame) -> DataFrame:
    return pair.withColumn("valid", F.col("ref_valid") & F.col("sec_valid"))


def _masked(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("_v", F.when(F.col("valid") & is_finite(F.col("v")), F.col("v")))


def erode_mask(pixels: DataFrame, w, shape) -> DataFrame:
    """Valid only where the whole window, as far as it is in the image, is valid."""
    got = windowmin(pixels.withColumn("_m", F.when(F.col("valid"), 1).otherwise(0)), w, shape, KEYS, "_m", "_e")
    return got.withColumn("valid", F.col("_e") > 0).drop("_m", "_e")


def _filtered(df: DataFrame, out: str, width, shape) -> DataFrame:
    """``out`` as the value; validity eroded by the filter's width; what is not finite becomes 0 and invalid."""
    names = [c for c in df.columns if not c.startswith("_")]
    got = erode_mask(df, width, shape)
    fine = is_finite(F.col(out))
    return got.withColumns({"valid": F.col("valid") & fine, "v": F.when(fine, F.col(out)).otherwise(0.0)}).select(*names)


def highpass(pixels: DataFrame, width: int, shape) -> DataFrame:
    """Value less the mean of the valid pixels around it."""
    got = windowmean(_masked(pixels), width, shape, KEYS, "_v", "_mean")
    return _filtered(got.withColumn("_o", F.col("_v") - F.col("_mean")), "_o", width, shape)


def wallis(pixels: DataFrame, width: int, shape, min_std: float = 0.0) -> DataFrame:
    """High-pass over the local population standard deviation, which is at least ``min_std``.

    Deviations are about each pixel's own local mean, which is exact where squares would cancel.
    """
    got = windowmean(_masked(pixels), width, shape, KEYS, "_v", "_mean")
    got = windowmean(got.withColumn("_d", F.pow(F.col("_v") - F.col("_mean"), 2)), width, shape, KEYS, "_d", "_var")
    sd = F.greatest(F.sqrt(F.greatest("_var", F.lit(0.0))), F.lit(float(min_std)))
    return _filtered(got.withColumn("_o", F.when(sd > 0, (F.col("_v") - F.col("_mean")) / sd)), "_o", width, shape)


def _derivative_kernel(width: int, order: int) -> list[float]:
    """Binomial smoothing of ``width`` taps with ``order`` differences in it."""
    k = [1.0]
    for _ in range(width - 1 - order):
        k = [a + b for a, b in zip([*k, 0.0], [0.0, *k], strict=True)]
    for _ in range(order):
        k = [b - a for a, b in zip([*k, 0.0], [0.0, *k], strict=True)]
    return k


def _line(df: DataFrame, kernel: list[float], keys, part: str, order: str, value: str, out: str) -> DataFrame:
    """One-dimensional correlation along an axis; null where a tap is missing, be its weight zero."""
    half = len(kernel) // 2
    w = W.partitionBy(*keys, part).orderBy(order)
    shift = lambda k: F.lag(value, k).over(w) if k > 0 else (F.lead(value, -k).over(w) if k < 0 else F.col(value))
    total = None
    for i, x in enumerate(kernel):
        term = x * shift(half - i)
        total = term if total is None else total + term
    return df.withColumn(out, total)


def sobel(pixels: DataFrame, width: int, shape) -> DataFrame:
    """Sum of the first-derivative kernels of ``width`` in x and y. Beyond the reference, which only names it."""
    d, s = _derivative_kernel(width, 1), _derivative_kernel(width, 0)
    got = _masked(pixels)
    got = _line(_line(got, d, KEYS, "r", "c", "_v", "_x1"), s, KEYS, "c", "r", "_x1", "_x")
    got = _line(_line(got, s, KEYS, "r", "c", "_v", "_y1"), d, KEYS, "c", "r", "_y1", "_y")
    return _filtered(got.withColumn("_o", F.col("_x") + F.col("_y")), "_o", width, shape)


def laplacian(pixels: DataFrame, width: int, shape) -> DataFrame:
    """Second derivatives of the log amplitude, summed. Beyond the reference, which only names it."""
    d, s = _derivative_kernel(width, 2), _derivative_kernel(width, 0)
    got = _masked(pixels).withColumn("_v", F.when(F.abs("_v") > 0, F.log(F.abs("_v"))))
    got = _line(_line(got, d, KEYS, "r", "c", "_v", "_x1"), s, KEYS, "c", "r", "_x1", "_x")
    got = _line(_line(got, s, KEYS, "r", "c", "_v", "_y1"), d, KEYS, "c", "r", "_y1", "_y")
    return _filtered(got.withColumn("_o", F.col("_x") + F.col("_y")), "_o", width, shape)


def decibel(pixels: DataFrame, shape) -> DataFrame:
    """20 log10 of the amplitude. Beyond the reference, which only names it."""
    amp = F.abs("v")
    return _filtered(_masked(pixels).withColumn("_o", F.when(F.col("_v").isNotNull() & (amp > 0), 20 * F.log10(amp))), "_o", 1, shape)


def wallis_gapfill(pixels: DataFrame, width: int, shape, min_std: float = 0.25, seed: int = 0) -> DataFrame:
    """Wallis, with gaps filled by unit noise that a hash of place and ``seed`` decides. Beyond the reference.

    A gap is an invalid pixel within the span of valid ones in its row and its column. Filled pixels
    are valid, so they do not mask their neighbourhood; noise of unit spread matches the filter's.
    """
    ok = F.col("valid") & is_finite(F.col("v"))
    # The first and last valid place of a line, over all of it: a frame that runs on to the end is made again for each row.
    inside = None
    for part, order in (("r", "c"), ("c", "r")):
        line, at = W.partitionBy("image_id", part), F.when(ok, F.col(order))
        x = F.coalesce(F.col(order).between(F.min(at).over(line), F.max(at).over(line)), F.lit(False))
        inside = x if inside is None else inside & x
    marked = pixels.withColumns({"_gap": ~ok & inside, "_was": F.col("valid")})
    base = wallis(marked.withColumnRenamed("_gap", "gap__").withColumnRenamed("_was", "was__"), width, shape, min_std)
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("image_id", "r", "c", F.lit(seed + k)), 11) + 1) / float((1 << 53) + 1)
    noise = F.sqrt(-2 * F.log(u(0))) * F.cos(6.283185307179586 * u(1))
    # Next to a gap the local statistics are of valid pixels only, so the plain result holds there.
    plain = windowmean(_masked(pixels), width, shape, KEYS, "_v", "_mean")
    plain = windowmean(plain.withColumn("_d", F.pow(F.col("_v") - F.col("_mean"), 2)), width, shape, KEYS, "_d", "_var")
    sd = F.greatest(F.sqrt("_var"), F.lit(float(min_std)))
    near = plain.select("image_id", "r", "c", F.when(sd > 0, (F.col("_v") - F.col("_mean")) / sd).alias("_p"))
    got = base.join(near, ["image_id", "r", "c"])
    v = F.when(F.col("gap__"), noise).when(F.col("was__") & F.col("_p").isNotNull(), F.col("_p")).otherwise(0.0)
    return got.withColumns({"v": v, "valid": F.col("gap__") | (F.col("was__") & F.col("_p").isNotNull())}).drop("gap__", "was__", "_p")


def ramp_phase(cpixels: DataFrame) -> DataFrame:
    """Per image the phase step along x and y: the angle of the sum of conj(z) times the next pixel's z.

    Pairs count where both pixels are valid and neighbours.
    """
    parts = {}
    for axis, part, order in (("x", "r", "c"), ("y", "c", "r")):
        w = W.partitionBy("image_id", part).orderBy(order)
        nxt = F.lead(F.struct("z", "valid", order)).over(w)
        ok = F.col("valid") & nxt["valid"] & (nxt[order] == F.col(order) + 1)
        re, im = c_conj_mul(F.col("z"), nxt["z"])
        parts |= {f"_re_{axis}": F.when(ok, re), f"_im_{axis}": F.when(ok, im)}
    sums = cpixels.withColumns(parts).groupBy("image_id").agg(*(F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in parts))
    return sums.select("image_id", *(F.atan2(f"_im_{a}", f"_re_{a}").alias(f"phase_{a}") for a in "xy"))


def deramp(cpixels: DataFrame, axis: str = "both") -> DataFrame:
    """The linear phase taken out about the first sample, along ``axis``."""
    ph = ramp_phase(cpixels)
    got = cpixels.join(ph, "image_id")
    px = F.col("phase_x") if axis != "y" else F.lit(0.0)
    py = F.col("phase_y") if axis != "x" else F.lit(0.0)
    a = -((F.col("r") - 1) * py + (F.col("c") - 1) * px)
    turn = F.struct(F.cos(a).alias("re"), F.sin(a).alias("im"))
    return got.withColumn("z", c_mul(F.col("z"), turn)).drop("phase_x", "phase_y")


def preprocess(pixels: DataFrame, method: Preprocess, shape) -> DataFrame:
    if method.kind == "none":
        return pixels
    if own := registry.own("preprocess", method.kind):
        if own.complex_ is not None and own.complex_ != ("z" in pixels.columns):
            raise ValueError(f"`preprocess` {own.name} is of {'complex' if own.complex_ else 'real'} images")
        return own.columns(pixels, method, shape)
    if method.kind == "deramp":
        if "z" not in pixels.columns:
            raise ValueError("`preprocess` deramp needs complex images; real ones have no phase")
        return deramp(pixels, method.axis)
    if "z" in pixels.columns:
        raise ValueError(f"`preprocess` {method.kind} filters amplitudes; complex images take deramp or none")
    if method.kind == "decibel":
        return decibel(pixels, shape)
    if method.kind in ("wallis", "wallis_gapfill"):
        return (wallis if method.kind == "wallis" else wallis_gapfill)(pixels, method.width, shape, method.min_std)
    return {"highpass": highpass, "sobel": sobel, "laplacian": laplacian}[method.kind](pixels, method.width, shape)


def quantize_uint8(pixels: DataFrame) -> DataFrame:
    """mean +- 3 sample deviations of the valid pixels to 0..255, halves to even; invalid 0; no spread 128."""
    v = F.when(F.col("valid") & is_finite(F.col("v")), F.col("v"))
    stats = pixels.groupBy("image_id").agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"), F.count(v).alias("_n"))
    got = pixels.join(stats, "image_id")
    scaled = F.rint(F.least(F.greatest((v - (F.col("_mean") - 3 * F.col("_sd"))) * (255.0 / (6 * F.nullif("_sd", F.lit(0.0)))), F.lit(0.0)), F.lit(255.0)))
    flat = (F.col("_n") == 1) | (F.col("_sd") == 0)
    out = F.when(F.col("_n") == 0, 0.0).when(flat, F.when(F.col("valid"), 128.0).otherwise(0.0)).when(v.isNull(), 0.0).otherwise(scaled)
    return got.withColumn("v", out).drop("_mean", "_sd", "_n")


def quantize_none(pixels: DataFrame) -> DataFrame:
    """Values that are not finite become 0; the mask already says so."""
    if "z" in pixels.columns:
        ok = is_finite(F.col("z.re")) & is_finite(F.col("z.im"))
        return pixels.withColumn("z", F.when(ok, F.col("z")).otherwise(F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))))
    return pixels.withColumn("v", F.when(is_finite(F.col("v")), F.col("v")).otherwise(0.0))


def quantize(pixels: DataFrame, method: str) -> DataFrame:
    if own := registry.own("quantize", method):
        return own.columns(pixels)
    if method == "uint8":
        if "z" in pixels.columns:
            raise ValueError("`quantize` uint8 would drop the phase of complex images; use none")
        return quantize_uint8(pixels)
    return quantize_none(pixels)


def prepare(pixels: DataFrame, p, shape) -> DataFrame:
    """Filter, then quantize, every image for itself: any number of images in one plan."""
    return quantize(preprocess(pixels, p.preprocess, shape), p.quantize)


def scale01(pixels: DataFrame) -> DataFrame:
    """Values between the extremes of the finite ones, to 0..1; others 0. An image without a range is an error."""
    v = F.when(is_finite(F.col("v")), F.col("v"))
    lim = pixels.groupBy("image_id").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    got = pixels.join(lim, "image_id")
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.raise_error(F.lit("an image has no finite range to scale")).cast("double"))
    return got.withColumn("v", F.coalesce((v - F.col("_lo")) / span, F.lit(0.0))).drop("_lo", "_hi")

