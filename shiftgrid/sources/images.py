"""Images from tables: one row a line of pixels, to pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftgrid.schema import is_finite, missing_as_null


def scan_image(table: DataFrame, row: str, values: str, image_id: str = "ref", first_row: int = 0) -> DataFrame:
    """A table of (row number from ``first_row``, array of values) as pixels (image_id, r, c, v, valid).

    NaN and infinities become null and are not valid; zero is valid.
    """
    got = table.select((F.col(row) - first_row + 1).cast("int").alias("r"), F.posexplode(values).alias("pos", "e"))
    v = F.col("e").cast("double")
    return got.select(F.lit(image_id).alias("image_id"), "r", (F.col("pos") + 1).cast("int").alias("c"), missing_as_null(v).alias("v"), is_finite(v).alias("valid"))


def shifted(pixels: DataFrame, dr: int, dc: int, image_id: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """The image moved by (dr, dc); with ``shape`` it wraps around that extent, else places left empty are absent."""
    r, c = F.col("r") + dr, F.col("c") + dc
    if shape:
        r, c = F.pmod(r - 1, F.lit(shape[0])) + 1, F.pmod(c - 1, F.lit(shape[1])) + 1
    return pixels.withColumns({"image_id": F.lit(image_id), "r": r.cast("int"), "c": c.cast("int")})


def masked(pixels: DataFrame, invalid: Column) -> DataFrame:
    return pixels.withColumn("valid", F.col("valid") & ~invalid)


def complex_image(pixels: DataFrame, half: int) -> DataFrame:
    """Columns 1..half as real parts, the ``half`` after them as imaginary parts."""
    re = pixels.where(F.col("c") <= half).select("image_id", "r", "c", F.col("v").alias("re"), F.col("valid").alias("a"))
    im = pixels.where((F.col("c") > half) & (F.col("c") <= 2 * half)).select("image_id", "r", (F.col("c") - half).alias("c"), F.col("v").alias("im"), F.col("valid").alias("b"))
    met = re.join(im, ["image_id", "r", "c"])
    return met.select("image_id", "r", "c", F.struct("re", "im").alias("z"), (F.col("a") & F.col("b")).alias("valid"))


def sign_descriptors(table: DataFrame, key: str, values: str, image_id: str, width: int) -> DataFrame:
    """Keypoints whose descriptor is the sign bits of up to 64 values in one word; placed row by row, ``width`` a row."""
    bits = F.aggregate(F.transform(values, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i % 62).cast("bigint")), F.expr("0L"), lambda a, b: a.bitwiseXOR(b))
    return table.select(F.lit(image_id).alias("image_id"), F.col(key).alias("k_id"), F.floor(F.col(key) / width).cast("double").alias("r"), (F.col(key) % width).cast("double").alias("c"), F.array(bits).alias("desc"))
