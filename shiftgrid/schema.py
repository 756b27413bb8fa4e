"""Canonical table schemas. Rows and columns are 1-based; a missing measurement is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXELS = "image_id string, r int, c int, v double, valid boolean"
COMPLEX_PIXELS = "image_id string, r int, c int, z struct<re:double,im:double>, valid boolean"
IMAGE_AXES = "image_id string, axis string, origin double, step double, ascending boolean, regular boolean, crs string"
PAIRS = "pair_id string, ref_id string, sec_id string, ref_ts timestamp, sec_ts timestamp"
POINTS = (
    "pair_id string, pt_id bigint, gi int, gj int, x double, y double, radius_x int, radius_y int, "
    "dx_prior double, dy_prior double, chip_x int, chip_y int"
)
FIELD = "pair_id string, pt_id bigint, gi int, gj int, dx double, dy double, correlation double, searched boolean"
RESULT = "pair_id string, gi int, gj int, x double, y double, dx double, dy double, correlation double, chip_size int, interpolated boolean"
MATCHES = "pair_id string, m_id bigint, r double, c double, dx double, dy double"
KEYPOINTS = "image_id string, k_id bigint, r double, c double, desc array<bigint>"


def is_finite(v: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def missing_as_null(v: Column) -> Column:
    """NaN and infinities as null: Spark's aggregates and orderings treat NaN as the largest number."""
    return F.when(is_finite(v), v)


def require(df: DataFrame, ddl: str, what: str) -> DataFrame:
    """``df`` with the columns of ``ddl`` in order; a missing column or another type is an error."""
    want = [tuple(x.strip().split(" ", 1)) for x in _fields(ddl)]
    types = dict(df.dtypes)
    for name, kind in want:
        if name not in types:
            raise ValueError(f"{what}: no column `{name}`; it has {', '.join(df.columns)}")
        if types[name] != kind:
            raise ValueError(f"{what}: `{name}` is {types[name]}, not {kind}")
    return df.select(*(n for n, _ in want))


def _fields(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]
