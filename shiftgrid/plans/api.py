"""One-shot and batch tracking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrid import registry
from shiftgrid.operators import detect, firstguess, geo, points
from shiftgrid.operators import multichip as M
from shiftgrid.operators import preprocess as PP
from shiftgrid.operators.correlate_arrow import halo_of, pack, pack_planes
from shiftgrid.operators.scenes import SCENE_PIXELS, track_scenes
from shiftgrid.params import Params, params, search_margin
from shiftgrid.schema import IMAGE_AXES, require
from shiftgrid.shared import shared_table


def grid_size(shape: tuple[int, int], p: Params) -> tuple[int, int]:
    """Rows and columns of the search grid."""
    mx, my = search_margin(p.chip_size_max, p.radius_x), search_margin(p.chip_height(p.chip_size_max), p.radius_y)
    return len(range(my + 1, shape[0] - my + 1, p.grid_spacing)), len(range(mx + 1, shape[1] - mx + 1, p.grid_spacing))


def build_grid(spark: SparkSession, shape: tuple[int, int], p: Params, pair_ids: DataFrame | None = None) -> DataFrame:
    """The search grid, inset for the largest chip; with ``pair_ids(pair_id)`` one copy a pair."""
    pts = points.gridpoints(spark, shape, p.grid_spacing, p.chip_size_max, p.chip_aspect, (p.radius_x, p.radius_y), p.dx_prior, p.dy_prior)
    if pair_ids is None:
        return pts
    return pair_ids.select("pair_id").distinct().crossJoin(F.broadcast(pts.drop("pair_id"))).select(*pts.columns)  # a grid is small and fixed by the parameters


#: Tables of one kind beyond which a session writes them as one.
MOST_TABLES = 8


class Session:
    """Prepared images kept by id, so each is filtered, quantized and packed once however many pairs it is in.

    ``add`` takes pixels of images; ``track`` runs any number of pairs in one plan. The last result is kept
    until other tables are asked for or an image is added. ``tile``: pixels of a packed tile's side.
    """

    def __init__(self, shape: tuple[int, int], p: Params | None = None, tile: int = 256, **keywords):
        self.params = p or params(**keywords)
        self.shape, self.tile = shape, tile
        q = self.params
        self.halo = max(detect.REACH, halo_of(q.chip_size_max, q.chip_height(q.chip_size_max), max(q.radius_x, q.min_search_radius), max(q.radius_y, q.min_search_radius), max(abs(q.dx_prior), abs(q.dy_prior))))
        # Tables of images by what they hold, a table a call, with the call's number in _v; scenes whose tiles nothing has asked for yet.
        self._tables: dict[str, list[DataFrame]] = {"prepared": [], "packs": [], "scenes": []}
        self._unpacked: list[tuple[DataFrame, int]] = []
        self.axes: DataFrame | None = None
        self.tracked_pairs = 0  #: pairs that the last call of ``field`` had to track
        self._adds: list[DataFrame] = []  # (image_id, version) of every call that added images
        self._added, self._settled = 0, False
        self._fields: list[DataFrame] = []  # results by pair and the versions of its images
        self._last: tuple[tuple, DataFrame] | None = None

    def _keep(self, what: str, df: DataFrame, version: int) -> None:
        self._tables[what].append(df.withColumn("_v", F.lit(version)))

    def _latest(self, what: str) -> DataFrame | None:
        """The rows of each image's latest version: one union of the calls' tables and one semi-join, however many calls."""
        parts = self._tables[what]
        if not parts:
            return None
        if self._added == 1:
            return parts[0].drop("_v")
        got = reduce(DataFrame.unionByName, parts).join(self.versions().withColumnRenamed("version", "_v"), ["image_id", "_v"], "left_semi")
        if len(parts) > MOST_TABLES:
            got = shared_table(got, what)
            self._tables[what] = [got]
        return got.drop("_v")

    @property
    def prepared(self) -> DataFrame | None:
        """Prepared pixels of the images that were added as pixels."""
        return self._latest("prepared")

    @property
    def scenes(self) -> DataFrame | None:
        """Images that were added as planes."""
        return self._latest("scenes")

    @property
    def packs(self) -> DataFrame | None:
        """Packed tiles of every image; those of scenes are made when something first asks for them."""
        kind = self.params.preprocess
        own, coded = registry.own("preprocess", kind.kind), registry.own("quantize", self.params.quantize)
        filtered = (lambda v, ok, f=own.arrays: f(v, ok, kind)) if own else None
        while self._unpacked:
            new, version = self._unpacked.pop(0)
            packed = pack_planes(new, self.tile, self.halo, kind.width if kind.kind == "highpass" else 0, self.params.quantize == "uint8", filtered, coded.arrays if coded else None)
            self._keep("packs", shared_table(packed, "packs"), version)
        return self._latest("packs")

    def add(self, pixels: DataFrame, replace: bool = False) -> Session:
        """Prepare the images of ``pixels(image_id, r, c, v or z, valid)``. Those of known ids are left as they
        are, or with ``replace`` take their place, values and mask alike. Pixels beyond the shape are an error.
        """
        if self._adds and not replace:
            pixels = pixels.join(self.image_ids(), "image_id", "left_anti")
        done = shared_table(PP.prepare(pixels, self.params, self.shape), "prepared")
        n, low_r, low_c, r, c = done.agg(F.count(F.lit(1)), F.min("r"), F.min("c"), F.max("r"), F.max("c")).first()
        if not n:
            return self
        if r > self.shape[0] or c > self.shape[1] or min(low_r, low_c) < 1:
            raise ValueError(f"an image has pixels beyond its shape {self.shape}")
        packed = shared_table(pack(done, self.tile, self.halo, "z" in done.columns, self.shape), "packs")
        self._touched(packed)
        self._keep("prepared", done, self._added)
        self._keep("packs", packed, self._added)
        return self

    def add_planes(self, planes: DataFrame) -> Session:
        """Scenes as ``planes(image_id, ny, nx, data)``, each in one task: for the default preparation (high-pass,
        and bytes or none) of scenes that fit there. They take the place of known ids. They are read when pairs are
        tracked; pixel forms of them are not kept, so points that reach beyond the parameters' halo are an error."""
        kind = self.params.preprocess
        own, bytes_ = registry.own("preprocess", kind.kind), registry.own("quantize", self.params.quantize)
        if kind.kind not in ("highpass", "none") and not (own and own.arrays) or bytes_ and not bytes_.arrays:
            raise ValueError(f"`preprocess` {kind.kind} with `quantize` {self.params.quantize} is of pixel tables; planes take highpass or none, and methods that have a form for arrays")
        planes = planes.select("image_id", "ny", "nx", "data")
        self._touched(planes)
        self._keep("scenes", planes, self._added)
        self._unpacked.append((planes, self._added))
        return self

    def _touched(self, images: DataFrame) -> None:
        self._added, self._settled = self._added + 1, False
        self._adds.append(images.select("image_id", F.lit(self._added).alias("version")))
        self._last = None

    def versions(self) -> DataFrame:
        """``(image_id, version)``: the number of the call that last added or replaced each image."""
        if len(self._adds) > 1 or not self._settled:
            every = reduce(DataFrame.union, self._adds).groupBy("image_id").agg(F.max("version").alias("version"))
            self._adds, self._settled = [shared_table(every, "versions")], True
        return self._adds[0]

    def field(self, pairs: DataFrame) -> DataFrame:
        """The fields of ``pairs`` on the parameters' grid, each tracked once for the versions of its two images: after an image is
        replaced only its own pairs are tracked again, and pairs asked for before are not. Results are written."""
        if not self._adds:
            raise ValueError("no image was added")
        v = self.versions()
        side = lambda k: v.select(F.col("image_id").alias(f"{k}_id"), F.col("version").alias(f"_{k}"))
        key = ["pair_id", "ref_id", "sec_id", "_ref", "_sec"]
        asked = shared_table(pairs.select("pair_id", "ref_id", "sec_id").join(side("ref"), "ref_id").join(side("sec"), "sec_id").select(*key), "asked")
        new = asked
        for held in self._fields:
            new = new.join(held.select(*key).distinct(), key, "left_anti")
        new = shared_table(new, "new")
        self.tracked_pairs = new.count()
        if self.tracked_pairs:
            found = shared_table(self.track(new.select("pair_id", "ref_id", "sec_id")).join(new, "pair_id"), "fields")
            self._fields.append(found)
        if len(self._fields) > MOST_TABLES:  # one table again, without what images of now have replaced
            current = reduce(DataFrame.unionByName, self._fields).join(side("ref"), ["ref_id", "_ref"], "left_semi").join(side("sec"), ["sec_id", "_sec"], "left_semi")
            self._fields = [shared_table(current, "fields")]
        return reduce(DataFrame.unionByName, [f.join(asked, key, "left_semi") for f in self._fields]).drop("ref_id", "sec_id", "_ref", "_sec")

    def bind_axes(self, axes: DataFrame) -> Session:
        """Axes and coordinate system of images: ``axes(image_id, axis, origin, step, ascending, regular, crs)``, two rows an image."""
        self.axes = require(axes, IMAGE_AXES, "axes")
        return self

    def velocity(self, pairs: DataFrame, dt=None, rotate: bool = True) -> DataFrame:
        """Fields on the images' own axes: ``map_x``, ``map_y``, ``crs``, and ``vx``, ``vy`` in map orientation, per year where ``dt`` (a timedelta
        or years) or the pairs' column ``years`` says how far apart the images are. ``rotate=False``: ``dx``, ``dy`` as they are.
        Unequal axes or systems of a pair's images are an error of the plan."""
        if self.axes is None:
            raise ValueError("no axes are bound; see bind_axes")
        years = geo.interval_years(dt)
        timed = pairs.withColumn("years", F.lit(years).cast("double")) if years is not None or "years" not in pairs.columns else pairs
        bound = geo.pair_axes(timed.select("pair_id", "ref_id", "sec_id", "years"), self.axes)
        placed = geo.on_axes(self.track(pairs), bound)
        return geo.pair_velocity(placed, bound) if rotate else placed

    def image_ids(self) -> DataFrame:
        """``(image_id)`` of the images that are held."""
        return self.versions().select("image_id")

    def pairs_of(self, pairs: DataFrame) -> DataFrame | None:
        """``pairs(pair_id, ref_id, sec_id)`` to (pair_id, r, c, ref, sec, valid)."""
        prepared = self.prepared
        if prepared is None:
            return None
        value = "z" if "z" in prepared.columns else "v"
        side = lambda k: prepared.select(F.col("image_id").alias(f"{k}_id"), "r", "c", F.col(value).alias(k), F.col("valid").alias(f"_{k}_ok"))
        ids = pairs.select("pair_id", "ref_id", "sec_id")
        met = side("ref").join(ids, "ref_id").join(side("sec"), ["sec_id", "r", "c"])
        return met.select("pair_id", "r", "c", "ref", "sec", (F.col("_ref_ok") & F.col("_sec_ok")).alias("valid"))

    def matches(self, pairs: DataFrame, method: str = "corners", **options) -> DataFrame:
        """``(pair_id, m_id, r, c, dx, dy)`` of image pairs: corners matched by their descriptors (``ratio``, ``spacing``,
        ``most``), or what the registered method of another name finds. No image or no corner gives no rows."""
        if not self._adds:
            raise ValueError("no image was added")
        own = registry.own("matches", method)
        return own.find(self, pairs, **options) if own else self._corner_matches(pairs, **options)

    def _corner_matches(self, pairs: DataFrame, ratio: float = 0.8, spacing: int = 3, most: int | None = 2000) -> DataFrame:
        asked = pairs.select(F.explode(F.array("ref_id", "sec_id")).alias("image_id")).distinct()
        found = detect.keypoints(self.packs.join(asked, "image_id", "left_semi"), self.halo, self.shape[1], spacing, most)
        found = shared_table(found, "corners")  # both sides read it, and an image is in several pairs
        return firstguess.hamming_match(detect.of_pairs(found, pairs, "ref"), detect.of_pairs(found, pairs, "sec"), ratio)

    def first_guess(self, pairs: DataFrame, method: str = "corners", min_matches: int = 8, search_radius: int = 6, chip_size: int | None = None, consistency: dict | None = None, **options) -> DataFrame:
        """Scattered points with priors, for ``track``: from the images alone, by matches that their neighbours bear out.
        ``consistency``: what ``consistent_matches`` takes. Pairs with under ``min_matches`` of them have no points."""
        found = shared_table(self.matches(pairs, method, **options), "matches")
        return firstguess.first_guess(found, min_matches, search_radius, chip_size or self.params.chip_size, **(consistency or {}))

    def _whole_scenes(self) -> bool:
        """Whether all images came as planes that a task holds whole."""
        return bool(self._tables["scenes"]) and not self._tables["prepared"] and self.shape[0] * self.shape[1] <= SCENE_PIXELS

    def track(self, pairs: DataFrame, pts: DataFrame | None = None, tier: str = "arrow", checkpoint: bool = False) -> DataFrame:
        """The displacement field of each pair. Gridded points (the default) go through all chip sizes; scattered
        ones (``gi`` null) are tracked once at their own chips. ``checkpoint`` writes the result.

        ``tier``: "arrow" takes whole scenes where all images are planes that a task holds ("scenes"), and else halo tiles
        ("tiles"); "rows" is the relational form, "auto" takes it for small geometries.
        """
        if not self._adds:
            raise ValueError("no image was added")
        key = (pairs, pts, tier, checkpoint)
        if self._last and all(a is b or (isinstance(a, (str, bool)) and a == b) for a, b in zip(self._last[0], key, strict=True)):
            return self._last[1]
        p = self.params
        if pts is None and tier in ("arrow", "scenes") and self._whole_scenes():
            out = track_scenes(self.scenes, pairs, self.shape, p)
            out = shared_table(out, "field") if checkpoint else out
            self._last = (key, out)
            return out
        if tier == "scenes":
            raise ValueError("`tier` scenes is of images that were all added as planes, on the grid of the parameters")
        tier = "arrow" if tier == "tiles" else tier
        prepared = self._tables["prepared"]
        images = M.Images(self.pairs_of(pairs), self.shape, bool(prepared) and "z" in prepared[0].columns, self.packs, pairs, self.tile, self.halo)
        if pts is not None and pts.where("gi is null").limit(1).count():
            out = M.track(images, pts, p, p.similarity[0], None, tier)
        else:
            grid = pts if pts is not None else build_grid(pairs.sparkSession, self.shape, p, pairs)
            out = M.multichip(images, grid, p, grid_size(self.shape, p), tier)
        if checkpoint:
            out = shared_table(out, "field")
        self._last = (key, out)
        return out


def track_pair(reference: DataFrame, secondary: DataFrame, shape: tuple[int, int], p: Params | None = None, pts: DataFrame | None = None,
               tier: str = "arrow", checkpoint: bool = False, **keywords) -> DataFrame:
    """One pair in one call: pixels of two images to its displacement field."""
    spark = reference.sparkSession
    s = Session(shape, p, **keywords)
    names = [df.select("image_id").first() for df in (reference, secondary)]
    if None in names:
        raise ValueError("an image has no pixels")
    (ref_id,), (sec_id,) = names
    if ref_id == sec_id:
        raise ValueError(f"both images have the id {ref_id!r}")
    s.add(reference.unionByName(secondary))
    pairs = spark.createDataFrame([("p", ref_id, sec_id)], "pair_id string, ref_id string, sec_id string")
    return s.track(pairs, pts, tier, checkpoint)


def track_raster(reference: DataFrame, secondary: DataFrame, axes: DataFrame, shape: tuple[int, int], dt=None, rotate: bool = True, p: Params | None = None, **keywords) -> DataFrame:
    """Two images on map axes to velocities in one call: see :meth:`Session.velocity`. With ``rotate=False``, as for arrays on any
    two dimensions, displacements in pixels on those axes."""
    s = Session(shape, p, **keywords).add(reference.unionByName(secondary)).bind_axes(axes)
    ids = [df.select("image_id").first() for df in (reference, secondary)]
    if None in ids:
        raise ValueError("an image has no pixels")
    pairs = reference.sparkSession.createDataFrame([("p", ids[0][0], ids[1][0])], "pair_id string, ref_id string, sec_id string")
    return s.velocity(pairs, dt, rotate)
