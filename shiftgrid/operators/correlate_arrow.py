"""Tier B: correlation of points against halo tiles of packed images, in Arrow batches.

Images are cut into tiles with a halo as wide as any window reaches, so each point needs one tile: one
equi-join on (pair, tile), no range join, and work divides by pair and tile whatever an image's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid import registry
from shiftgrid.operators import kernels

PACKS = "image_id string, tr int, tc int, r0 int, c0 int, ny int, nx int, data binary, ok binary"
TILES = "pair_id string, tr int, tc int, r0 int, c0 int, ny int, nx int, ref binary, sec binary, valid binary"


def pack(pixels: DataFrame, tile: int, halo: int, complex_: bool = False, shape: tuple[int, int] | None = None) -> DataFrame:
    """``pixels(image_id, r, c, v or z, valid)`` to packed tiles of ``tile`` x ``tile`` pixels plus ``halo`` on every
    side, once an image, whatever pairs and passes it is in and in either slot.

    A pixel goes to each tile that it is in or near. Places outside the image are 0 and not valid. With the
    images' ``shape`` there are no tiles beyond them, which only a point outside would need.
    """
    def span(x: str, n: int | None):
        low, high = (F.floor((F.col(x) - 1 + d) / tile).cast("int") for d in (-halo, halo))
        return F.sequence(low, high) if n is None else F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit((n - 1) // tile)))

    ny, nx = shape or (None, None)
    spread = pixels.withColumn("tr", F.explode(span("r", ny))).withColumn("tc", F.explode(span("c", nx)))
    size, kind = tile + 2 * halo, np.complex128 if complex_ else np.float32
    values = {"re": "z.re", "im": "z.im"} if complex_ else {"re": "v"}
    flat = spread.select("image_id", "tr", "tc", "r", "c", *(F.col(c).cast("double").alias(n) for n, c in values.items()), "valid")

    def packed(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        name, tr, tc = key
        r0, c0 = int(tr) * tile + 1 - halo, int(tc) * tile + 1 - halo
        i, j = df["r"].to_numpy() - r0, df["c"].to_numpy() - c0
        data, ok = np.zeros((size, size), kind), np.zeros((size, size), bool)
        data[i, j] = df["re"].to_numpy() + (1j * df["im"].to_numpy() if complex_ else 0)
        ok[i, j] = df["valid"].to_numpy(bool)
        return pd.DataFrame({"image_id": [name], "tr": [tr], "tc": [tc], "r0": [r0], "c0": [c0], "ny": [size], "nx": [size], "data": [data.tobytes()], "ok": [ok.tobytes()]})

    return flat.groupBy("image_id", "tr", "tc").applyInPandas(packed, PACKS)


def pack_planes(planes: DataFrame, tile: int, halo: int, filter_width: int = 0, quantize: bool = False, own_filter=None, own_quantize=None) -> DataFrame:
    """``planes(image_id, ny, nx, data)``, row-major 32-bit floats, NaN where missing, to the tiles of :func:`pack`,
    high-passed over ``filter_width`` and quantized on the way: a scene a row, for scenes that one task holds
    (a few hundred bytes of memory a pixel at most). Larger ones come as pixels, prepared by tables."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ny, nx, raw in zip(*(b.column(c) for c in ("image_id", "ny", "nx", "data")), strict=True):
                v = np.frombuffer(raw.as_py(), np.float32).reshape(ny.as_py(), nx.as_py())
                v, ok = kernels.prepare(v, filter_width, quantize, own_filter, own_quantize)
                rows = []
                for tr in range(-(-v.shape[0] // tile)):
                    for tc in range(-(-v.shape[1] // tile)):
                        r0, c0, size = tr * tile - halo, tc * tile - halo, tile + 2 * halo
                        data, good = np.zeros((size, size), np.float32), np.zeros((size, size), bool)
                        y, x = slice(max(r0, 0), min(r0 + size, v.shape[0])), slice(max(c0, 0), min(c0 + size, v.shape[1]))
                        at = slice(y.start - r0, y.stop - r0), slice(x.start - c0, x.stop - c0)
                        data[at], good[at] = v[y, x], ok[y, x]
                        rows.append((name.as_py(), tr, tc, r0 + 1, c0 + 1, size, size, data.tobytes(), good.tobytes()))
                names = ["image_id", "tr", "tc", "r0", "c0", "ny", "nx", "data", "ok"]
                kinds = [pa.string(), *[pa.int32()] * 6, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return planes.select("image_id", "ny", "nx", "data").mapInArrow(packed, PACKS)


def tiles(pair: DataFrame, tile: int, halo: int, complex_: bool = False) -> DataFrame:
    """``pair(pair_id, r, c, ref, sec, valid)`` to packed tiles of both images, as :func:`pack` makes them of one."""
    value = "z" if complex_ else "v"
    own = lambda side: pack(pair.select(F.col("pair_id").alias("image_id"), "r", "c", F.col(side).alias(value), "valid"), tile, halo, complex_)
    sec = own("sec").select("image_id", "tr", "tc", F.col("data").alias("sec"))
    got = own("ref").join(sec, ["image_id", "tr", "tc"])
    return got.select(F.col("image_id").alias("pair_id"), "tr", "tc", "r0", "c0", "ny", "nx", F.col("data").alias("ref"), "sec", F.col("ok").alias("valid"))


def halo_of(chip_x: int, chip_y: int, radius_x: int, radius_y: int, prior: float = 0.0) -> int:
    """A halo that holds any chip and window of a point in a tile."""
    return max(chip_x // 2 + radius_x, chip_y // 2 + radius_y) + int(np.ceil(prior)) + 2


_NAMES = ["pt_id", "x", "y", "radius_x", "radius_y", "dx_prior", "dy_prior", "chip_x", "chip_y"]


def _by_tile(pts: DataFrame, tile: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """Points as one array a tile: they are few against pixels, so joins move packed rows only. With a
    ``shape`` points outside belong to the nearest tile."""
    place = lambda x, n: F.floor((F.floor(x) - 1) / tile).cast("int") if n is None else F.greatest(F.lit(0), F.least(F.floor((F.floor(x) - 1) / tile), F.lit((n - 1) // tile))).cast("int")
    ny, nx = shape or (None, None)
    at = pts.withColumns({"tr": place("y", ny), "tc": place("x", nx)})
    cols = at.groupBy("pair_id", "tr", "tc").agg(F.sort_array(F.collect_list(F.struct(*(F.col(n).cast("double").alias(n) if n != "pt_id" else F.col(n) for n in _NAMES)))).alias("p"))
    return cols.select("pair_id", "tr", "tc", *(F.col(f"p.{n}").alias(n) for n in _NAMES))


def _tracked(met: DataFrame, by: list[str], upsampling: int, measure: str, angles: tuple[float, ...]) -> DataFrame:
    """Points of joined tiles; ``by``: the keys that rows were dealt by in the last join, so that they need not be dealt again."""
    own = registry.own("similarity", measure)  # resolved here; workers get the method itself
    if own and own.arrays is None:
        raise ValueError(f"`similarity` {measure} has no form for arrays; track by rows")
    complex_, scored = (own.complex_, own) if own else (measure == "coherence", measure)

    def tracked(key: tuple, t: pa.Table) -> pa.Table:
        parts = []
        for t in t.to_batches(max_chunksize=1):  # a view of a row
            of = lambda k: t.column(k)[0]  # noqa: B023, E731
            size = of("ny").as_py(), of("nx").as_py()
            image = lambda k, kind: np.frombuffer(of(k).as_buffer(), kind).reshape(size)  # noqa: B023, E731
            valid = image("valid", bool)
            if of("valid2").is_valid:
                valid = valid & image("valid2", bool)
            kind = np.complex128 if complex_ else np.float32
            at = {n: of(n).values.to_numpy(zero_copy_only=False).astype(float) for n in _NAMES if n != "pt_id"}
            got = kernels.track(image("ref", kind), image("sec", kind), valid, at, of("r0").as_py(), of("c0").as_py(), upsampling, scored, angles)
            ids = of("pt_id").values
            columns = [pa.array([of("pair_id").as_py()] * len(ids), pa.string()), ids, *(pa.array(got[k], pa.float64(), from_pandas=True) for k in ("dx", "dy", "correlation")), pa.array(got["searched"])]
            parts.append(pa.RecordBatch.from_arrays(columns, names=["pair_id", "pt_id", "dx", "dy", "correlation", "searched"]))
        return pa.Table.from_batches(parts)

    # A tile of a pair is a group of its own: however many tiles a task has, Python holds one of them at a time.
    keep = ["r0", "c0", "ny", "nx", "ref", "sec", "valid", "valid2"]
    at = [*by, *(k for k in ("pair_id", "tr", "tc") if k not in by)]
    rows = met.select(*at, *(n for n in (*_NAMES, *keep) if n not in at))
    return rows.groupBy(*at).applyInArrow(tracked, "pair_id string, pt_id bigint, dx double, dy double, correlation double, searched boolean")


def track_tiles(packed: DataFrame, pts: DataFrame, tile: int, upsampling: int, measure: str = "zncc", angles: tuple[float, ...] = (0.0,)) -> DataFrame:
    """``(pair_id, pt_id, dx, dy, correlation, searched)`` for every point that has a tile of ``packed`` pairs."""
    met = packed.withColumn("valid2", F.lit(None).cast("binary")).join(_by_tile(pts, tile), ["pair_id", "tr", "tc"])
    return _tracked(met, ["pair_id", "tr", "tc"], upsampling, measure, angles)


def track_packs(packs: DataFrame, pairs: DataFrame, pts: DataFrame, tile: int, shape: tuple[int, int], upsampling: int, measure: str = "zncc", angles: tuple[float, ...] = (0.0,)) -> DataFrame:
    """The same over the tiles of single images, met by ``pairs(pair_id, ref_id, sec_id)`` on (image, tile).

    Only tiles that hold points are joined; a pair is valid where both its images are.
    """
    asked = _by_tile(pts, tile, shape).join(pairs.select("pair_id", "ref_id", "sec_id"), "pair_id")
    ref = packs.select(F.col("image_id").alias("ref_id"), "tr", "tc", "r0", "c0", "ny", "nx", F.col("data").alias("ref"), F.col("ok").alias("valid"))
    sec = packs.select(F.col("image_id").alias("sec_id"), "tr", "tc", F.col("data").alias("sec"), F.col("ok").alias("valid2"))
    return _tracked(asked.join(ref, ["ref_id", "tr", "tc"]).join(sec, ["sec_id", "tr", "tc"]), ["sec_id", "tr", "tc"], upsampling, measure, angles)
