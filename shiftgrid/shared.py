"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, deleted with the session. Where that is unset, a
    temporary folder serves a local session only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or _temporary.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="shiftgrid-"))
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def shared_table(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` cut off from its lineage: written to the shared folder, in folders ``by`` columns, and read again. Survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by or ()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
