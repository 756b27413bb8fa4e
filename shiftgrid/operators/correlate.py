"""Tier A: correlation as joins and aggregates over pixel rows.

Lines of an image are packed in blocks and joined to the lines of chips and windows; a point's chip and window
meet by its key, and every shift's sums are aggregates over those two arrays, so that no product of a pixel and a
shift is ever a row, shuffled or spilled. Mean-removed chips sum to zero, so the window's mean needs no second pass.
For geometries beyond some 1e8 products take ``correlate_arrow``.

Points, their lines and pixels are many more than the files that Spark estimates them by, so they are joined by
merging: left to itself Spark would build them in the driver, to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftgrid import registry
from shiftgrid.functions.scalar import c_abs2, c_conj_mul
from shiftgrid.operators import points as P
from shiftgrid.registry import Similarity

EPS32 = 1.1920929e-07  # Fixed value: the spacing of 32-bit floats at 1
PT = ["pair_id", "pt_id"]


def _cells(pts: DataFrame, kind: str) -> DataFrame:
    """A row for each pixel of each point's chip or window: image coordinates r, c and its place i, j (from 0)."""
    got = P.chip_bounds(pts) if kind == "chip" else P.search_bounds(pts)
    p = "chip" if kind == "chip" else "win"
    got = got.withColumn("r", F.explode(F.sequence(f"{p}_r0", f"{p}_r1")))
    got = got.withColumn("c", F.explode(F.sequence(f"{p}_c0", f"{p}_c1")))
    return got.withColumns({"i": F.col("r") - F.col(f"{p}_r0"), "j": F.col("c") - F.col(f"{p}_c0")}).drop(*(f"{p}_{x}" for x in ("r0", "r1", "c0", "c1")))


def cut(pixels: DataFrame, pts: DataFrame, kind: str, value: str = "v") -> DataFrame:
    """Pixels of every point's ``chip`` or ``window``: the range join as an equi-join on exploded places.

    ``pixels`` is one image (pair_id, r, c, value, valid). Places outside it have 0 and are not valid,
    so no image is ever padded.
    """
    cells = _cells(pts.where(P.searchable()), kind)
    met = cells.join(pixels.select("pair_id", "r", "c", F.col(value).alias("v"), "valid"), ["pair_id", "r", "c"], "left")
    zero = F.lit(0.0) if value == "v" else F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    keep = [*PT, "i", "j", "r", "c", "radius_x", "radius_y", "chip_x", "chip_y"]
    return met.select(*keep, F.coalesce("v", zero).alias("v"), F.coalesce("valid", F.lit(False)).alias("valid"))


def chip_stats(chip: DataFrame) -> DataFrame:
    """Per point: n, mean, norm of the mean-removed chip, and whether it has texture.

    The squares are of deviations (through a window over the point's own pixels), not of differences of sums.
    """
    own = W.partitionBy(*PT)
    d = chip.withColumn("_m", F.avg("v").over(own)).withColumn("_d", F.col("v") - F.col("_m"))
    got = d.groupBy(*PT).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("_tt"), F.bool_or("valid").alias("any_valid"))
    return got.select(*PT, "n", "mean", F.sqrt("_tt").alias("norm"), (F.col("_tt") > EPS32 * F.col("n")).alias("ok"), "any_valid")


#: Built-in similarities as columns of the sums that :class:`shiftgrid.registry.Similarity` names.
_BUILT_IN = {
    "zncc": Similarity("zncc", lambda s: s["num"] / _den(s["tt"], s["s2"] - s["s1"] * s["s1"] / s["n"])),
    "ncc": Similarity("ncc", lambda s: s["num"] / _den(s["tt"], s["s2"])),
    "coherence": Similarity("coherence", lambda s: F.sqrt(s["re"] * s["re"] + s["im"] * s["im"]) / _den(s["tt"], s["s2"] - (s["s1_re"] * s["s1_re"] + s["s1_im"] * s["s1_im"]) / s["n"]), complex_=True),
}


def _den(tt: Column, power: Column) -> Column:
    return F.nullif(F.sqrt(tt) * F.sqrt(F.greatest(power, F.lit(0.0))), F.lit(0.0))


def surfaces(ref: DataFrame, sec: DataFrame, pts: DataFrame, measure: str = "zncc", mask: DataFrame | None = None, angles: tuple[float, ...] = (0.0,)) -> DataFrame:
    """``(pair_id, pt_id, sy, sx, score)``: the correlation at every shift (0-based; zero shift at the radius).

    ``ref``, ``sec``: (pair_id, r, c, v or z, valid). ``mask``: where the pair is valid (default: both
    are). Points whose chip has no valid pixel give no rows; chips without texture give score null. With ``angles`` other
    than one of 0 every chip is turned by each, and ``angle_idx`` says by which (from 0).
    """
    method = registry.own("similarity", measure) or _BUILT_IN[measure]
    complex_ = "z" in ref.columns
    if method.complex_ != complex_:
        raise ValueError(f"`similarity` {measure} is of {'complex' if method.complex_ else 'real'} images; {'complex ones take coherence' if complex_ else 'real ones take zncc or ncc'}")
    if complex_ and angles != (0.0,):
        raise ValueError("rotation turns chips of real images")
    value, zero = ("z", F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))) if complex_ else ("v", F.lit(0.0))
    on = pts.where(P.searchable())
    if mask is None:
        mask = ref.where("valid").select("pair_id", "r", "c").hint("merge").join(sec.where("valid").select("pair_id", "r", "c"), ["pair_id", "r", "c"], "left_semi")
    # Chips and windows meet by point, so what follows needs no other shuffle: products are never rows.
    held = on.select(*PT, "radius_x", "radius_y", "chip_x", "chip_y").hint("merge").join(live(on, mask), PT, "left_semi")
    held = held.hint("merge").join(_patches(sec, on, "chip", value, zero, "chip"), PT).hint("merge").join(_patches(ref, on, "window", value, zero, "win"), PT)
    keys = PT
    if angles != (0.0,):
        keys = [*PT, "angle_idx"]
        turned = F.array(*(_turned(F.col("chip"), a) for a in angles))
        held = held.select(*PT, "radius_x", "radius_y", "chip_x", "chip_y", "win", F.posexplode(turned).alias("angle_idx", "chip"))
    got = held.select(*keys, F.explode(_sums(F.col("chip"), F.col("win"), complex_)).alias("s"))
    names = ("re", "im", "s1_re", "s1_im", "s2") if complex_ else ("num", "s1", "s2")
    score = method.columns({k: F.col("s.sums")[k] for k in names} | {k: F.col(f"s.{k}") for k in ("tt", "n", "mean")})
    score = F.coalesce(score, F.lit(0.0)) if method.name in _BUILT_IN else score
    return got.select(*keys, "s.sy", "s.sx", F.when(F.col("s.tt") > EPS32 * F.col("s.n"), score).alias("score"))


#: Pixels of a block of an image's line. Blocks are packed once, so that a chip's line meets a row or two, not one a pixel.
LINE = 64


def _block(c: Column) -> Column:
    return F.floor((c - 1) / LINE).cast("int")


def _blocks_of(pts: DataFrame, kind: str) -> DataFrame:
    """(pair_id, pt_id, r, b, c0, c1): the blocks that lines of each point's chip or window touch."""
    got, p = (P.chip_bounds(pts), "chip") if kind == "chip" else (P.search_bounds(pts), "win")
    lines = got.select(*PT, F.explode(F.sequence(f"{p}_r0", f"{p}_r1")).alias("r"), F.col(f"{p}_c0").alias("c0"), F.col(f"{p}_c1").alias("c1"))
    return lines.select("*", F.explode(F.sequence(_block(F.col("c0")), _block(F.col("c1")))).alias("b"))


def _patches(pixels: DataFrame, pts: DataFrame, kind: str, value: str, zero: Column, out: str) -> DataFrame:
    """(pair_id, pt_id, out): every point's chip or window as one array, row by row; ``zero`` where the image has no value."""
    k = F.pmod(F.col("c") - 1, F.lit(LINE)).cast("int")
    packed = pixels.groupBy("pair_id", "r", _block(F.col("c")).alias("b")).agg(F.collect_list(F.struct(k.alias("k"), F.col(value).alias("v"))).alias("e"))
    dense = _let(F.map_from_entries("e"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(LINE - 1)), lambda i: F.coalesce(m[i], zero)))
    met = _blocks_of(pts, kind).hint("merge").join(packed.select("pair_id", "r", "b", dense.alias("e")), ["pair_id", "r", "b"], "left")
    first, last = F.greatest(F.col("c0"), F.col("b") * LINE + 1), F.least(F.col("c1"), (F.col("b") + 1) * LINE)
    part = F.coalesce(F.slice("e", first - F.col("b") * LINE, last - first + 1), F.array_repeat(zero, last - first + 1))
    # Cut before they are gathered, so that a point's rows carry no whole blocks.
    parts = met.select(*PT, F.struct("r", "b", part.alias("part")).alias("p")).groupBy(*PT).agg(F.sort_array(F.collect_list("p")).alias("p"))
    return parts.select(*PT, F.flatten("p.part").alias(out))


def live(pts: DataFrame, mask: DataFrame) -> DataFrame:
    """Searchable points with a chip pixel that is in ``mask(pair_id, r, c)``."""
    there = mask.groupBy("pair_id", "r", _block(F.col("c")).alias("b")).agg(F.collect_list("c").alias("cs"))
    met = _blocks_of(pts.where(P.searchable()), "chip").hint("merge").join(there, ["pair_id", "r", "b"])
    return met.where(F.exists("cs", lambda c: c.between(F.col("c0"), F.col("c1")))).select(*PT).distinct()


def _let(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` has it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _width() -> Column:
    return F.floor(F.col("chip_x") / 2).cast("int") * 2


def _sums(chip: Column, win: Column, complex_: bool) -> Column:
    """Array over the shifts of (sy, sx, sums, tt, n, mean): the sums that a similarity takes, of a chip and its window.

    The window is cut into pieces, a chip's line long, one for every line and column shift; a shift's part of the window
    is some of them. Every sum is one number that is added up by itself; those of the window alone are of its pieces' sums.
    """
    n, across, width = F.size(chip), 2 * F.col("radius_x"), _width()
    height = F.floor(n / width).cast("int")
    stride, lines = width + across - 1, height + 2 * F.col("radius_y") - 1
    double = F.lit(0.0)
    upto = lambda m: F.sequence(F.lit(0), m - 1)
    of_each = lambda f: lambda p: total(F.transform(p, f))
    total = lambda xs: F.aggregate(xs, double, lambda a, x: a + x)
    if complex_:
        mean = F.struct(*((total(F.transform(chip, lambda x: x[k])) / n).alias(k) for k in ("re", "im")))
        less = lambda x, m: F.struct((x["re"] - m["re"]).alias("re"), (x["im"] - m["im"]).alias("im"))
        square, given = c_abs2, F.lit(None).cast("double")
        crossed = {"re": lambda t, w: c_conj_mul(t, w)[0], "im": lambda t, w: c_conj_mul(t, w)[1]}
        alone = {"s1_re": lambda w: w["re"], "s1_im": lambda w: w["im"], "s2": c_abs2}
    else:
        mean = total(chip) / n
        less, square, given = (lambda x, m: x - m), (lambda x: x * x), None
        crossed, alone = {"num": lambda t, w: t * w}, {"s1": lambda w: w, "s2": lambda w: w * w}

    def of_shift(ts, tt, m, pieces, own, rows, k):
        met = lambda patch: F.struct(*(total(F.zip_with(ts, patch, f)).alias(g) for g, f in crossed.items()), *(mine(g).alias(g) for g in alone))
        mine = lambda g: F.aggregate(rows, double, lambda a, i: a + F.get(own[g], k + i * across))
        sums = _let(F.flatten(F.transform(rows, lambda i: F.get(pieces, k + i * across))), met)
        return F.struct(F.floor(k / across).cast("int").alias("sy"), (k % across).alias("sx"), sums.alias("sums"), tt.alias("tt"), n.alias("n"), (m if given is None else given).alias("mean"))

    def of_pieces(ts, tt, m, pieces):
        own = F.struct(*(F.transform(pieces, of_each(f)).alias(g) for g, f in alone.items()))
        shifts = lambda own, rows: F.transform(upto(across * 2 * F.col("radius_y")), lambda k: of_shift(ts, tt, m, pieces, own, rows, k))
        return _let(own, lambda own: _let(upto(height), lambda rows: shifts(own, rows)))

    def of_chip(m):
        cut_up = lambda w: F.transform(upto(lines * across), lambda q: F.slice(w, F.floor(q / across).cast("int") * stride + q % across + 1, width))
        pieces = _let(F.transform(win, lambda w: w), cut_up)
        squares = lambda ts: F.aggregate(ts, double, lambda a, t: a + square(t))
        return _let(F.transform(chip, lambda x: less(x, m)), lambda ts: _let(squares(ts), lambda tt: _let(pieces, lambda ps: of_pieces(ts, tt, m, ps))))

    return _let(mean, of_chip)


def _turn(i: Column, j: Column, degrees: float) -> dict[str, Column]:
    """Where place (i, j) of a chip, from 0, comes from when it is turned about its centre: tap (1-based), parts, whether it is inside."""
    a = F.radians(F.lit(float(degrees)))
    yc, xc = (F.col("chip_y") + 1) / 2, (F.col("chip_x") + 1) / 2
    dy, dx = i + 1 - yc, j + 1 - xc
    sy, sx = yc + F.cos(a) * dy + F.sin(a) * dx, xc - F.sin(a) * dy + F.cos(a) * dx
    i0, j0 = F.floor(sy).cast("int"), F.floor(sx).cast("int")
    inside = (i0 >= 1) & (j0 >= 1) & (i0 + 1 <= F.col("chip_y")) & (j0 + 1 <= F.col("chip_x"))
    return {"i0": i0, "j0": j0, "fy": sy - i0, "fx": sx - j0, "inside": inside}


def _turned(chip: Column, degrees: float) -> Column:
    """A chip's array turned as :func:`rotate_chip` turns its rows."""
    if degrees == 0:
        return chip

    def at(k):
        t = _turn(F.floor(k / _width()).cast("int"), k % _width(), degrees)
        tap = lambda p, q: F.get(chip, (t["i0"] - 1 + p) * _width() + t["j0"] - 1 + q)
        parts = [(t["fy"] if p else 1 - t["fy"]) * (t["fx"] if q else 1 - t["fx"]) * tap(p, q) for p in (0, 1) for q in (0, 1)]
        return F.when(t["inside"], parts[0] + parts[1] + parts[2] + parts[3]).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.size(chip) - 1), at)


def rotate_chip(chip: DataFrame, degrees: float) -> DataFrame:
    """Chips turned about their centre, bilinear, outside 0. The four taps are one equi-join on exploded places."""
    if degrees == 0:
        return chip
    t = _turn(F.col("i"), F.col("j"), degrees)
    to = chip.withColumns({f"_{k}": v for k, v in t.items()})
    inside, fy, fx = F.col("_inside"), F.col("_fy"), F.col("_fx")
    taps = F.array(*(F.struct((F.col("_i0") - 1 + p).alias("si"), (F.col("_j0") - 1 + q).alias("sj"), ((fy if p else 1 - fy) * (fx if q else 1 - fx)).alias("w")) for p in (0, 1) for q in (0, 1)))
    src = chip.select(*PT, F.col("i").alias("si"), F.col("j").alias("sj"), F.col("v").alias("sv"))
    names = chip.columns
    t = to.where(inside).select(*(c for c in names if c != "v"), F.explode(taps).alias("t")).select("*", "t.si", "t.sj", "t.w").drop("t")
    keys = [c for c in names if c != "v"]
    got = t.join(src, [*PT, "si", "sj"]).groupBy(*keys).agg(F.sum(F.col("w") * F.col("sv")).alias("v"))
    out = to.where(~inside).select(*keys, F.lit(0.0).alias("v"))
    return got.unionByName(out).select(*names)
