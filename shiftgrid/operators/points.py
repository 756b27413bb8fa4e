"""Search points: construction, geometry and predicates, all as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrid.params import search_margin


def pointset(coords: DataFrame, chip_size: int = 32, chip_aspect: float = 1.0, search_radius: int | tuple[int, int] = 25,
             dx_prior: float = 0.0, dy_prior: float = 0.0, pair_id: str = "p") -> DataFrame:
    """Scattered points from ``coords(pt_id, x, y, ...)``. Columns of ``coords`` with a field's name are used for
    it (per-point geometry); fields that are whole numbers reject fractions when the plan runs."""
    rx, ry = search_radius if isinstance(search_radius, tuple) else (search_radius, search_radius)
    defaults = {"pair_id": pair_id, "gi": None, "gj": None, "radius_x": rx, "radius_y": ry, "dx_prior": dx_prior, "dy_prior": dy_prior,
                "chip_x": chip_size, "chip_y": 2 * round(chip_size * chip_aspect / 2)}
    kinds = {"pair_id": "string", "pt_id": "bigint", "gi": "int", "gj": "int", "x": "double", "y": "double", "radius_x": "int", "radius_y": "int",
             "dx_prior": "double", "dy_prior": "double", "chip_x": "int", "chip_y": "int"}
    out = []
    for name, kind in kinds.items():
        if name in coords.columns:
            c = exactly(F.col(name), name) if kind == "int" and name not in ("gi", "gj") else F.col(name)
            out.append(c.cast(kind).alias(name))
        else:
            out.append(F.lit(defaults[name]).cast(kind).alias(name))
    return coords.select(*out)


def exactly(c: Column, name: str) -> Column:
    """A whole number, or an error: a fraction is never rounded away."""
    return F.when(c.cast("double") == F.floor(c.cast("double")), c).otherwise(F.raise_error(F.concat(F.lit(f"`{name}` must be a whole number, got "), c.cast("string"))))


def gridpoints(spark: SparkSession, shape: tuple[int, int], spacing: int, chip_size: int = 32, chip_aspect: float = 1.0,
               search_radius: int | tuple[int, int] = 25, dx_prior: float = 0.0, dy_prior: float = 0.0, pair_id: str = "p") -> DataFrame:
    """A lattice of search centres whose chips and windows lie within an image of ``shape``.

    ``gi``, ``gj`` are 1-based grid indices along y and x; ``pt_id`` runs down columns first.
    """
    if spacing <= 0:
        raise ValueError(f"`spacing` must be positive, got {spacing}")
    rx, ry = search_radius if isinstance(search_radius, tuple) else (search_radius, search_radius)
    chip_y = 2 * round(chip_size * chip_aspect / 2)
    mx, my = search_margin(chip_size, rx), search_margin(chip_y, ry)
    nx, ny = len(range(mx + 1, shape[1] - mx + 1, spacing)), len(range(my + 1, shape[0] - my + 1, spacing))
    if not nx or not ny:
        raise ValueError(f"no search centre fits in a {shape[0]} x {shape[1]} image with chip {chip_size} x {chip_y} and search radius {rx} x {ry}: "
                         f"{my} x {mx} pixels are needed on each side")
    k = F.col("id")
    return spark.range(nx * ny).select(
        F.lit(pair_id).alias("pair_id"), k.alias("pt_id"), (k % ny + 1).cast("int").alias("gi"), (F.floor(k / ny) + 1).cast("int").alias("gj"),
        (F.floor(k / ny) * spacing + mx + 1).cast("double").alias("x"), (k % ny * spacing + my + 1).cast("double").alias("y"),
        F.lit(rx).alias("radius_x"), F.lit(ry).alias("radius_y"), F.lit(float(dx_prior)).alias("dx_prior"), F.lit(float(dy_prior)).alias("dy_prior"),
        F.lit(chip_size).alias("chip_x"), F.lit(chip_y).alias("chip_y"))


def scatter(pts: DataFrame) -> DataFrame:
    """The same points without a layout."""
    return pts.withColumns({"gi": F.lit(None).cast("int"), "gj": F.lit(None).cast("int")})


def decimate(pts: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th grid point in each direction, renumbered."""
    kept = pts.where((F.col("gi") % stride == 0) & (F.col("gj") % stride == 0))
    return kept.withColumns({"gi": (F.col("gi") / stride).cast("int"), "gj": (F.col("gj") / stride).cast("int")})


def subset(pts: DataFrame, rows: list[int] | None = None, columns: list[int] | None = None) -> DataFrame:
    """The grid points of the 1-based ``rows`` and ``columns`` (None: all), numbered by their places in the lists: order is kept,
    and a row named twice is there twice. ``pt_id`` is renumbered down columns first. An index that no pair has is an error."""
    spark = pts.sparkSession
    out = pts
    for name, own in (("gi", rows), ("gj", columns)):
        if own is None:
            continue
        if not own or any(isinstance(k, bool) or k != int(k) or k < 1 for k in own):
            raise ValueError(f"{'rows' if name == 'gi' else 'columns'}: {own!r} are no 1-based indices")
        ranked = spark.createDataFrame([(int(k), n) for n, k in enumerate(own, 1)], f"{name} int, _n int")
        most = out.groupBy("pair_id").agg(F.max(name).alias("_most"))
        beyond = F.raise_error(F.concat(F.lit(f"`{name}` {max(own)} is beyond the grid's "), F.col("_most").cast("string"))).cast("int")
        out = out.join(most, "pair_id").join(F.broadcast(ranked), name).withColumn(name, F.when(F.col("_most") >= max(own), F.col("_n")).otherwise(beyond)).select(*pts.columns)
    height = out.groupBy("pair_id").agg(F.max("gi").cast("bigint").alias("_h"))
    return out.join(height, "pair_id").withColumn("pt_id", (F.col("gj") - 1) * F.col("_h") + F.col("gi") - 1).select(*pts.columns)


#: Fields of points and whether each is a whole number.
FIELDS = {"x": False, "y": False, "radius_x": True, "radius_y": True, "dx_prior": False, "dy_prior": False, "chip_x": True, "chip_y": True}


def rebuild(pts: DataFrame, **fields) -> DataFrame:
    """The same points with some fields replaced: by a number, by an expression of the points, or by a table ``(pair_id, pt_id, <field>)``
    that has every point once. Another name is an error, and so, when it runs, are a fraction where a whole number belongs, a missing value
    and a table of other points."""
    out = pts
    for name, v in fields.items():
        if name not in FIELDS:
            raise ValueError(f"points have no field {name!r}; they have {', '.join(FIELDS)}")
        if isinstance(v, DataFrame):
            given = v.select("pair_id", "pt_id", F.col(name).alias("_v"), F.lit(1).alias("_g")).groupBy("pair_id", "pt_id").agg(F.first("_v").alias("_v"), F.count("_g").alias("_g"))
            met = out.withColumn("_p", F.lit(True)).join(given, ["pair_id", "pt_id"], "full")
            wrong = F.raise_error(F.concat(F.lit(f"`{name}`: its table and the points do not match one to one at point "), F.col("pt_id").cast("string")))
            out = met.withColumn("_v", F.when((F.col("_g") == 1) & F.col("_p"), F.col("_v")).otherwise(wrong.cast("double")))
        else:
            out = out.withColumn("_v", v if isinstance(v, Column) else F.lit(v))
        whole = exactly(F.col("_v"), name).cast("int") if FIELDS[name] else F.col("_v").cast("double")
        there = F.when(F.col("_v").isNull(), F.raise_error(F.lit(f"`{name}` is missing at a point")).cast("double")).otherwise(whole)
        out = out.withColumn(name, there.cast("int" if FIELDS[name] else "double")).select(*pts.columns)
    return out


def sanitize(pts: DataFrame, min_radius: int) -> DataFrame:
    """A radius that is not positive in one axis clears both; others are raised to ``min_radius``."""
    dead = (F.col("radius_x") <= 0) | (F.col("radius_y") <= 0)
    rx, ry = (F.when(dead, 0).otherwise(F.greatest(F.col(f"radius_{a}"), F.lit(min_radius))).cast("int") for a in "xy")
    return pts.withColumns({"radius_x": rx, "radius_y": ry})


def searchable() -> Column:
    return (F.col("radius_x") > 0) & (F.col("radius_y") > 0)


def half_pixel(pts: DataFrame, pad: tuple[int, int] = (0, 0)) -> DataFrame:
    """Coordinates moved by padding and half a pixel, to which an even chip's centre refers."""
    return pts.withColumns({"x": F.col("x") + pad[0] + 0.5, "y": F.col("y") + pad[1] + 0.5})


def chip_bounds(pts: DataFrame) -> DataFrame:
    """chip_r0..chip_r1, chip_c0..chip_c1: inclusive pixel ranges of the chip in the secondary image."""
    cx, cy = F.floor(F.col("x") - F.col("dx_prior")).cast("int"), F.floor(F.col("y") - F.col("dy_prior")).cast("int")
    hx, hy = (F.floor(F.col(f"chip_{a}") / 2).cast("int") for a in "xy")
    return pts.withColumns({"chip_r0": cy - hy, "chip_r1": cy + hy - 1, "chip_c0": cx - hx, "chip_c1": cx + hx - 1})


def search_bounds(pts: DataFrame) -> DataFrame:
    """win_r0..win_r1, win_c0..win_c1: the window in the reference image, chip + 2 radius - 1 wide."""
    cx, cy = F.floor("x").cast("int"), F.floor("y").cast("int")
    hx, hy = (F.floor(F.col(f"chip_{a}") / 2).cast("int") for a in "xy")
    rx, ry = F.col("radius_x"), F.col("radius_y")
    return pts.withColumns({"win_r0": cy - hy - ry, "win_r1": cy + hy + ry - 2, "win_c0": cx - hx - rx, "win_c1": cx + hx + rx - 2})


def surface_size(pts: DataFrame) -> DataFrame:
    return pts.withColumns({"surf_rows": 2 * F.col("radius_y"), "surf_cols": 2 * F.col("radius_x")})


def inbounds(pts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``inside``: whether the search window lies within the image."""
    got = search_bounds(pts)
    ok = (F.col("win_r0") >= 1) & (F.col("win_r1") <= shape[0]) & (F.col("win_c0") >= 1) & (F.col("win_c1") <= shape[1])
    return got.withColumn("inside", ok).drop("win_r0", "win_r1", "win_c0", "win_c1")


def pass_geometry(pts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Per pair: the largest chip and radius, the padding that keeps every window inside, and whether none is needed."""
    need = lambda a: F.max(F.floor(F.col(f"chip_{a}") / 2) + F.col(f"radius_{a}") + F.ceil(F.abs(f"d{a}_prior")))
    return inbounds(pts, shape).where(searchable()).groupBy("pair_id").agg(
        F.max("chip_x").alias("chip_x"), F.max("chip_y").alias("chip_y"), F.max("radius_x").alias("radius_x"), F.max("radius_y").alias("radius_y"),
        (need("x") + 2).cast("int").alias("pad_x"), (need("y") + 2).cast("int").alias("pad_y"), F.bool_and("inside").alias("fits"))


def level_points(pts: DataFrame, wanted: DataFrame, chip_x: int, chip_y: int, min_radius: int) -> DataFrame:
    """The points at one chip size; those that are not in ``wanted(pair_id, pt_id)`` are not searched."""
    marked = pts.join(wanted.select("pair_id", "pt_id", F.lit(True).alias("_w")), ["pair_id", "pt_id"], "left")
    on = F.col("_w").isNotNull()
    got = marked.withColumns({
        "radius_x": F.when(on, F.col("radius_x")).otherwise(0), "radius_y": F.when(on, F.col("radius_y")).otherwise(0),
        "chip_x": F.lit(chip_x), "chip_y": F.lit(chip_y)}).drop("_w")
    return sanitize(got, min_radius)
