"""Headerless raw planes: column-major 32-bit floats, as files that any Spark path can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftgrid.shared import shared_table
from shiftgrid.sources.planes import write_parts


def read_raw(spark: SparkSession, path: str, ny: int, nx: int, image_id: str | None = None) -> DataFrame:
    """Pixels of raw images under ``path``; the id is the file's name without its ending unless given."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, r = np.divmod(np.arange(ny * nx), ny)
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = content.as_py()
                if len(raw) != 4 * ny * nx:
                    raise ValueError(f"{name}: {len(raw)} bytes, not the {4 * ny * nx} of {ny} x {nx} 32-bit floats")
                v = np.frombuffer(raw, "<f4").astype(float)
                ok = np.isfinite(v)
                own = image_id or name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own] * len(v)), pa.array((r + 1).astype(np.int32)), pa.array((c + 1).astype(np.int32)), pa.array(v, mask=~ok), pa.array(ok)],
                    names=["image_id", "r", "c", "v", "valid"])

    return files.mapInArrow(scanned, "image_id string, r int, c int, v double, valid boolean")


#: Places of a plane that a task lays out at a time, and values of a row: a writer gets 10,000 rows at once.
PART, ROW = 1 << 18, 1 << 12


def plane_parts(result: DataFrame, grid: tuple[int, int]) -> DataFrame:
    """``(pair_id, first, data)``: parts of files that hold dx, dy and correlation, each a column-major plane of 32-bit floats, NaN
    where nothing was measured; ``first`` is a part's place in its file. A place beyond the grid is an error."""
    names = ("dx", "dy", "correlation")
    size = grid[0] * grid[1]

    def laid(key: tuple, t: pa.Table) -> pa.Table:
        start = key[1].as_py() * PART
        n = min(PART, size - start)
        at = t["_at"].to_numpy() - start
        first, data = [], []
        for k, name in enumerate(names):
            a = np.full(n, np.nan, "<f4")
            a[at] = t[name].to_numpy()
            for s in range(0, n, ROW):
                first.append(k * size + start + s)
                data.append(a[s : s + ROW].tobytes())
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(data), pa.string()), pa.array(first, pa.int64()), pa.array(data, pa.binary())], names=["pair_id", "first", "data"])

    inside = F.col("gi").between(1, grid[0]) & F.col("gj").between(1, grid[1])
    at = F.when(inside, (F.col("gj").cast("bigint") - 1) * grid[0] + F.col("gi") - 1).otherwise(F.raise_error(F.lit(f"a place lies beyond the grid {grid}")).cast("bigint"))
    rows = result.select("pair_id", at.alias("_at"), *(F.col(k).cast("double").alias(k) for k in names)).withColumn("_part", F.floor(F.col("_at") / PART).cast("bigint"))
    return rows.groupBy("pair_id", "_part").applyInArrow(laid, "pair_id string, first bigint, data binary")


def write_raw(result: DataFrame, grid: tuple[int, int], path: str) -> DataFrame:
    """One raw file ``<path>/<pair_id>.bin`` a pair, the three planes one after another, all of them or none. Their
    names, as ``(pair_id, path)``."""
    rows = shared_table(plane_parts(result, grid), "planes")
    write_parts(rows, path, 3 * grid[0] * grid[1])
    return rows.select("pair_id").distinct().select("pair_id", F.concat(F.lit(path.rstrip("/") + "/"), "pair_id", F.lit(".bin")).alias("path"))
