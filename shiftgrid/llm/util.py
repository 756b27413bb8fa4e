"""Shared helpers: written tables in the cluster's shared folder, and column snippets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset a temporary one, in a local session
    only: on a cluster each executor would write to a disk of its own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="shiftgrid-"))
    return _LOCAL_DIR[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back.

    The folder is marked for deletion when the application's file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


#: The letters that ASCII lower-casing maps.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def hash_sample(df: DataFrame, keys: tuple[str, ...], rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, never more: those of the smallest hashes of ``keys``.

    A threshold on the hash, set for twice as many, comes before the ordering, so that what tasks send
    to the driver is bounded by the sample, not by the number of tasks.
    """
    share = min(1.0, 2.0 * rows / max(total, 1))
    h = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    got = df if share == 1.0 else df.where(h < int(share * 2**63))
    return got.withColumn("_h", h).orderBy("_h", *keys).limit(rows).drop("_h")


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, the place of each row in its file, so that two scans agree however they are
    split. What is not read from files is written first."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    try:
        got = docs.select(*docs.columns, place.alias("_row"))
        got.schema  # names are resolved here
        return got
    except AnalysisException:
        return written(docs, "docs").select(*docs.columns, place.alias("_row"))


def waves(rows: DataFrame, keys: tuple[str, ...], most: int):
    """``(some of rows, their number)``: all of a written table in turn, about ``most`` at a time, so that one task a row
    makes no shuffle of more tasks than the driver can track. Of no rows: one empty wave."""
    total = rows.count()
    n = -(-total // most)
    if n <= 1:
        yield rows, total
        return
    for w in range(n):
        part = rows.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == w)
        yield part, part.count()


#: Rows of one item that a task makes.
CHUNK = 10_000


def repeated(items: DataFrame, n: str, chunk: int | None = None) -> DataFrame:
    """Each item as often as its column ``n`` (a long) says, numbered by ``i`` from 0. Items of many rows are
    dealt in chunks first, so that no task makes all rows of one."""
    size, count = chunk or CHUNK, F.col(n)
    few = items.where((count > 0) & (count <= size)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    many = items.where(count > size).withColumn("_c", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {size})")))
    many = many.repartition(*items.columns[:1], "_c")
    return few.unionByName(many.withColumn("i", F.explode(F.expr(f"sequence(_c * {size}, least({n}, (_c + 1) * {size}) - 1)"))).drop("_c"))
