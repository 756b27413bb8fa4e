"""Corners of images with oriented binary descriptors, by a table function over packed halo tiles.

A tile's halo holds all that its own pixels need, and every number is made by the same additions in the same order
wherever a tile begins, so keypoints do not depend on the tiling: neither scores nor suppression nor descriptors change
at a tile's border.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Half the side of a descriptor's patch, and of the disc whose centroid orients it.
PATCH, DISC = 15, 13
#: Pixels around one that decide on it: its patch turned, smoothed and differentiated, or its neighbours' windows.
REACH = 26
#: Bits of a descriptor, directions that patches are turned in, weight of the squared trace in a corner's score.
BITS, TURNS, TRACE = 256, 30, 0.04


@lru_cache(maxsize=1)
def _pairs() -> np.ndarray:
    """(TURNS, BITS, 4) whole offsets: pairs of places drawn about the middle, turned in every direction."""
    rng = np.random.default_rng(1234)
    at = rng.normal(scale=PATCH / 2.5, size=(4 * BITS, 2, 2))
    at = at[(np.hypot(at[..., 0], at[..., 1]) <= PATCH).all(1) & (np.abs(at[:, 0] - at[:, 1]).max(1) >= 1)][:BITS]
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.cos(a), -np.sin(a), np.sin(a), np.cos(a)], -1).reshape(-1, 2, 2)
    return np.rint(np.einsum("tij,bpj->tbpi", turn, at)).astype(int).reshape(TURNS, BITS, 4)


def _box(a: np.ndarray, n: int) -> np.ndarray:
    """Sums over (2 n + 1) x (2 n + 1) windows, places outside as 0: shifted arrays are added one after another."""
    for axis in (0, 1):
        p = np.pad(a, [(n, n) if k == axis else (0, 0) for k in (0, 1)])
        out = np.zeros_like(a)
        for d in range(2 * n + 1):
            out = out + (p[d : d + a.shape[0]] if axis == 0 else p[:, d : d + a.shape[1]])
        a = out
    return a


def scores(v: np.ndarray) -> np.ndarray:
    """The corner score of every pixel: determinant less a part of the squared trace of the structure tensor over 5 x 5."""
    p = np.pad(v, 1)
    gy, gx = (p[2:, 1:-1] - p[:-2, 1:-1]) / 2, (p[1:-1, 2:] - p[1:-1, :-2]) / 2
    a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
    return a * c - b * b - TRACE * (a + c) * (a + c)


def corners(v: np.ndarray, ok: np.ndarray, own: tuple[slice, slice], spacing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the corners within ``own``: pixels whose score is positive and, of all within
    ``spacing`` pixels along each axis, the highest, of equal ones the first by row and column. Their patches are valid."""
    s = np.where(_box((~ok).astype(np.int64), REACH - spacing - 3) == 0, scores(v), -np.inf)
    best = np.isfinite(s) & (s > 0)
    p = np.pad(s, spacing, constant_values=-np.inf)
    h, w = s.shape
    for dy in range(-spacing, spacing + 1):
        for dx in range(-spacing, spacing + 1):
            other = p[spacing + dy : spacing + dy + h, spacing + dx : spacing + dx + w]
            if (dy, dx) < (0, 0):
                best &= s > other
            elif (dy, dx) > (0, 0):
                best &= s >= other
    inside = np.zeros_like(best)
    inside[own] = True
    r, c = np.nonzero(best & inside)
    return r, c, s[r, c]


def describe(v: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (index of ``TURNS``) by the centroid of a disc, and descriptors as (n, BITS / 64) 64-bit words."""
    if not len(r):
        return np.empty(0, int), np.empty((0, BITS // 64), np.int64)
    y, x = np.mgrid[-DISC : DISC + 1, -DISC : DISC + 1]
    y, x = (k[np.hypot(y, x) <= DISC] for k in (y, x))
    disc = v[r[:, None] + y, c[:, None] + x]
    middle = disc.sum(1, keepdims=True) / disc.shape[1]  # of the same values in the same order wherever a tile begins
    disc = disc - middle
    angle = np.arctan2((disc * y).sum(1), (disc * x).sum(1))
    turn = np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
    smooth = _box(v, 2)
    at = _pairs()[turn]  # offsets of x and y of both places of every bit
    first = smooth[r[:, None] + at[..., 1], c[:, None] + at[..., 0]]
    second = smooth[r[:, None] + at[..., 3], c[:, None] + at[..., 2]]
    bits = np.packbits(first < second, axis=1, bitorder="little")
    return turn, np.ascontiguousarray(bits).view("<i8")


@udtf(returnType="r int, c int, score double, angle double, desc array<bigint>")
class Corners:
    """Corners of one tile's own pixels."""

    def eval(self, r0: int, c0: int, ny: int, nx: int, data: bytes, ok: bytes, halo: int, spacing: int) -> Iterator[tuple]:
        v = np.frombuffer(data, np.float32).reshape(ny, nx).astype(np.float64)
        good = np.frombuffer(ok, bool).reshape(ny, nx)
        if not good.any():
            return
        r, c, s = corners(np.where(good, v, 0.0), good, (slice(halo, ny - halo), slice(halo, nx - halo)), spacing)
        turn, desc = describe(v, r, c)
        for k in range(len(r)):
            yield int(r[k]) + r0, int(c[k]) + c0, float(s[k]), float(turn[k] * 360 / TURNS), desc[k].tolist()


def keypoints(packs: DataFrame, halo: int, columns: int, spacing: int = 3, most: int | None = 2000) -> DataFrame:
    """``(image_id, k_id, r, c, score, angle, desc)``: corners of images packed with a ``halo`` of ``REACH`` pixels or more.

    ``columns``: of the images, for ids by place. ``most``: of each image the strongest so many (ties to the smaller id);
    None for all. Corners keep clear of what is not valid, the image's outside included. An image without texture has none.
    """
    if halo < REACH or not 1 <= spacing <= 8:
        raise ValueError(f"corners need a halo of {REACH} pixels and a `spacing` from 1 to 8")
    args = [F.col(k).outer() for k in ("r0", "c0", "ny", "nx", "data", "ok")]
    found = packs.lateralJoin(Corners(*args, F.lit(halo), F.lit(spacing)))
    k_id = ((F.col("r").cast("bigint") - 1) * columns + F.col("c")).alias("k_id")
    out = found.select("image_id", k_id, F.col("r").cast("double").alias("r"), F.col("c").cast("double").alias("c"), "score", "angle", "desc")
    if most is None:
        return out
    order = W.partitionBy("image_id").orderBy(F.desc("score"), "k_id")
    return out.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def of_pairs(found: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Keypoints of the ``side`` (ref or sec) of each of ``pairs(pair_id, ref_id, sec_id)``."""
    ids = pairs.select("pair_id", F.col(f"{side}_id").alias("image_id"))
    return found.join(ids, "image_id").select("pair_id", "k_id", "r", "c", "desc")
