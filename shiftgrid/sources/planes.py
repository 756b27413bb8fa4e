"""Raw planes as a Spark data source: files of column-major 32-bit floats, read in ranges of columns, written whole or not at all.

``spark.dataSource.register(RawPlanes)``, then ``read.format("raw_planes")`` with the options ``ny`` and ``nx``, and
``write.format("raw_planes")`` of rows ``(pair_id, <one binary column a plane>)``, or of parts of files by place. Paths are local ones or those that
Arrow's file systems open (s3, gs, hdfs); for others there is ``raw.read_raw``, which takes whole files by Spark's reader.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from shiftgrid.schema import PIXELS

#: Bytes of a partition's range of columns unless the option ``range_bytes`` says otherwise; a column at least.
RANGE_BYTES = 16 << 20
#: Pixels that a task holds at a time.
AT_ONCE = 1 << 18


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a plain path is local."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def id_of(path: str) -> str:
    """A file's name without its ending."""
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class RawPlanes(DataSource):
    """Options of reading: ``path`` (a file, or a folder of them), ``ny``, ``nx``, ``image_id`` (of one file; by default its
    name), ``range_bytes``. Of writing: ``path``, a folder that takes ``<pair_id>.bin`` a row, or with ``values`` (of each file)
    one of all rows ``(pair_id, first, data)`` of that id: the values of a file from ``first`` (from 0) on."""

    @classmethod
    def name(cls) -> str:
        return "raw_planes"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PlaneWriter(self.options["path"], overwrite, int(self.options.get("values", 0)))


@dataclass
class ColumnRange(InputPartition):
    path: str
    image_id: str
    first: int  #: the first column, from 0
    end: int


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        for k in ("path", "ny", "nx"):
            if k not in options:
                raise ValueError(f"raw_planes: the option `{k}` is missing")
        self.path, self.ny, self.nx, self.image_id = options["path"], int(options["ny"]), int(options["nx"]), options.get("image_id")
        self.columns = max(1, int(options.get("range_bytes", RANGE_BYTES)) // (4 * self.ny))

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise ValueError(f"raw_planes: there is no {self.path}")
        files = [info] if info.is_file else sorted((f for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        if self.image_id and len(files) > 1:
            raise ValueError(f"raw_planes: one `image_id` for {len(files)} files")
        for f in files:
            if f.size != 4 * self.ny * self.nx:
                raise ValueError(f"{f.path}: {f.size} bytes, not the {4 * self.ny * self.nx} of {self.ny} x {self.nx} 32-bit floats")
        base = self.path if info.is_file else None
        return [ColumnRange(base or f"{self.path.rstrip('/')}/{f.base_name}", self.image_id or id_of(f.path), a, min(a + self.columns, self.nx)) for f in files for a in range(0, self.nx, self.columns)]

    def read(self, partition: ColumnRange) -> Iterator[pa.RecordBatch]:
        fs, path = opened(partition.path)
        ny = self.ny
        at, end = partition.first * ny, partition.end * ny
        with fs.open_input_file(path) as f:
            while at < end:
                n = min(AT_ONCE, end - at)
                v = np.frombuffer(f.read_at(4 * n, 4 * at), "<f4").astype(float)
                c, r = np.divmod(np.arange(at, at + n), ny)
                ok = np.isfinite(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.image_id] * n, pa.string()), pa.array(r + 1, pa.int32()), pa.array(c + 1, pa.int32()), pa.array(v, mask=~ok), pa.array(ok)],
                    names=["image_id", "r", "c", "v", "valid"])
                at += n


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  #: name in the write's own folder, name it gets


class PlaneWriter(DataSourceArrowWriter):
    """Tasks write into a folder of this write alone; its files get their places when all tasks are done, and if the write
    fails the folder goes. A task that runs twice writes other files; those of one run are taken. Tasks do not make the
    folder, so one that outlives a failed write can't bring it back."""

    def __init__(self, path: str, overwrite: bool, values: int = 0):
        self.path, self.overwrite, self.values, self.own = path, overwrite, values, f".write-{uuid.uuid4().hex}"
        fs, root = opened(path)
        fs.create_dir(f"{root}/{self.own}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        done = []
        for pair, parts in self._parts(iterator) if self.values else self._rows(iterator):
            if pair is None or "/" in pair or pair.startswith("."):
                raise ValueError(f"raw_planes: {pair!r} is no name of a file")
            part = f"{uuid.uuid4().hex}.part"
            with fs.open_output_stream(f"{root}/{self.own}/{part}") as out:
                for data in parts:
                    out.write(data)
            done.append((part, f"{pair}.bin"))
        return Written(done)

    def _rows(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        for b in iterator:
            names = [n for n in b.schema.names if n != "pair_id"]
            for k, pair in enumerate(b.column("pair_id").to_pylist()):
                yield pair, (b.column(n)[k].as_py() or b"" for n in names)

    def _parts(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        """Files in rows' order, each as it comes: a task holds a part, not a file."""
        rows = ((p, a, d) for b in iterator for p, a, d in zip(b.column("pair_id").to_pylist(), b.column("first").to_pylist(), b.column("data"), strict=True))
        for pair, own in groupby(rows, lambda t: t[0]):
            yield pair, self._filled(pair, own)

    def _filled(self, pair: str, rows: Iterator[tuple]) -> Iterator[bytes]:
        """One file's parts, NaN where it has none."""
        at, none = 0, np.full(AT_ONCE, np.nan, "<f4").tobytes()

        def gap(upto: int) -> Iterator[bytes]:
            for k in range(at, upto, AT_ONCE):
                yield none[: 4 * min(AT_ONCE, upto - k)]

        for _, first, data in rows:
            if first < at:
                raise ValueError(f"raw_planes: parts of {pair!r} overlap or are out of order at {first}")
            yield from gap(first)
            yield (raw := data.as_py())
            at = first + len(raw) // 4
        if at > self.values:
            raise ValueError(f"raw_planes: {pair!r} has values up to {at} of {self.values}")
        yield from gap(self.values)

    def _drop(self, fs: pafs.FileSystem, root: str) -> None:
        for last in (False, False, True):  # a task that still writes may add a file while the folder is emptied
            try:
                if fs.get_file_info(f"{root}/{self.own}").type != pafs.FileType.NotFound:
                    fs.delete_dir(f"{root}/{self.own}")
                return
            except OSError:
                if last:
                    raise

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self._drop(fs, root)
            raise ValueError("raw_planes: a pair_id has several rows")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.is_file and f.base_name.endswith(".bin"):
                    fs.delete_file(f.path)
        for part, name in files:
            fs.move(f"{root}/{self.own}/{part}", f"{root}/{name}")
        self._drop(fs, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(*opened(self.path))


def scan_planes(spark: SparkSession, path: str, ny: int, nx: int, image_id: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pixels of the raw images under ``path``, each file in ranges of columns of ``range_bytes``; a missing value (NaN or
    infinite) is null and not valid. A file of another size is an error."""
    spark.dataSource.register(RawPlanes)
    got = spark.read.format("raw_planes").option("ny", ny).option("nx", nx).option("range_bytes", range_bytes)
    return (got.option("image_id", image_id) if image_id else got).load(path)


def write_planes(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows ``(pair_id, <binary planes>)`` to ``<path>/<pair_id>.bin`` each, the planes one after another."""
    rows.sparkSession.dataSource.register(RawPlanes)
    rows.write.format("raw_planes").mode("overwrite" if overwrite else "append").save(path)


def write_parts(rows: DataFrame, path: str, values: int, overwrite: bool = False) -> None:
    """Rows ``(pair_id, first, data)`` to ``<path>/<pair_id>.bin``: ``data`` (32-bit floats) from the place ``first`` of the
    ``values`` of each file on, NaN where no row is. A file's parts stream in order through one task, which holds one of them."""
    rows.sparkSession.dataSource.register(RawPlanes)
    own = rows.select("pair_id", "first", "data").repartition("pair_id").sortWithinPartitions("pair_id", "first")
    own.write.format("raw_planes").option("values", values).mode("overwrite" if overwrite else "append").save(path)
