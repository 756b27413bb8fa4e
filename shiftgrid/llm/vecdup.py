"""Embedding near-duplicates: PCA-ordered tiles, leading dimensions first, suffix norms as bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.graph import components
from shiftgrid.llm.util import hash_sample, waves, written

#: Bytes of a tile's vectors, which bounds what a task holds whatever their length, and vectors of the blocks that tiles are compared in.
TILE, BLOCK = 8 * 2**20, 1024


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers to unit length, safe against overflow."""
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(kind: str):
    """(vec_id, embedding) to (vec_id, vec): the numbers' bytes, null where the row links with nothing."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr, named = b.column("embedding"), b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            start, end = arr.offsets.to_numpy()[[0, -1]] if len(arr) else (0, 0)
            # Null components as NaN; -0.0 is made 0.0, so that equal vectors have equal bytes.
            flat = arr.values.slice(start, end - start).cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
            at = arr.offsets.to_numpy() - start
            bad, some = (np.r_[0, np.cumsum(x)] for x in (~np.isfinite(flat), flat != 0))
            ok = arr.is_valid().to_numpy(zero_copy_only=False) & named & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            data = flat.astype(kind)
            vec = pa.Array.from_buffers(pa.large_binary(), len(arr), [pa.py_buffer(np.packbits(ok, bitorder="little")), pa.py_buffer(at.astype(np.int64) * data.itemsize), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), vec.cast(pa.binary())], names=["vec_id", "vec"])

    return usable


def _pca(reps: DataFrame, n: int, sample: int, kind: str) -> dict[int, np.ndarray]:
    """For each length of vectors, principal directions (largest first) of a bounded sample."""
    got = hash_sample(reps.select("vec"), ("vec",), sample, n).toPandas()["vec"]
    by: dict[int, list] = {}
    for b in got:
        by.setdefault(len(b) // np.dtype(kind).itemsize, []).append(np.frombuffer(b, kind).astype(float))
    out = {}
    for dim, rows in by.items():
        x = _units(np.stack(rows))
        _, basis = np.linalg.eigh(x.T @ x)
        out[dim] = np.ascontiguousarray(basis[:, ::-1])
    return out


def _pack(size: int):
    """Rows sorted by (dim, y) to tiles of one dim and at most ``size`` bytes of vectors (one, if that is longer)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (dim, ids, copies, ys, bytes) of slices of batches
        filled = 0

        def tile() -> pa.RecordBatch:
            ids, copies, ys = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0][0]], pa.int32()), pa.array([ys.min()], pa.float64()), pa.array([ys.max()], pa.float64()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([copies.tobytes()], pa.binary()), pa.array([b"".join(h[4] for h in held)], pa.binary())],
                names=["dim", "lo", "hi", "ids", "copies", "mat"])

        for b in batches:
            ids, copies, dims, ys = (b.column(c).to_numpy() for c in ("rid", "m", "dim", "y"))
            vec = b.column("vec")
            at = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset : vec.offset + len(vec) + 1].astype(np.int64)
            data = memoryview(vec.buffers()[2])
            k = 0
            while k < len(ids):
                if held and held[0][0] != dims[k]:
                    yield tile()
                    held, filled = [], 0
                width = max(1, int(at[k + 1] - at[k]))
                other = np.flatnonzero(dims[k:] != dims[k])
                stop = min(k + int(other[0]) if len(other) else len(ids), k + max((size - filled) // width, 0 if held else 1))
                if stop > k:
                    held.append((int(dims[k]), ids[k:stop], copies[k:stop], ys[k:stop], bytes(data[at[k] : at[stop]])))
                    filled, k = filled + int(at[stop] - at[k]), stop
                if held and filled + width > size:
                    yield tile()
                    held, filled = [], 0
        if held:
            yield tile()

    return packed


def _leading(r: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` rotated dimensions and the norm of the rest: products of two such rows bound the cosine."""
    return np.hstack([r[:, :k], np.sqrt((r[:, k:] ** 2).sum(1, keepdims=True))]).astype(np.float32)


def linked(a: np.ndarray, b: np.ndarray, leads: list[tuple[np.ndarray, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every cosine of the unit rows of ``a`` and ``b`` that reaches ``least``.

    ``leads``: for each step the leading parts of both, with more dimensions each. Where few pairs can
    still reach the threshold those are computed in double precision; if many remain after the last
    step, all are. Bounds are in single precision, with room for its rounding.
    """
    for la, lb in leads:
        may = la @ lb.T >= least - 1e-4
        n = np.count_nonzero(may)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n <= 0.02 * may.size:
            i, j = np.divmod(np.flatnonzero(may), may.shape[1])
            near = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 16384]], b[j[k : k + 16384]]) for k in range(0, n, 16384)]) >= least
            return i[near], j[near]
    return np.nonzero(a @ b.T >= least)


def _forest(link: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links between rows ``ia`` and columns ``ib``."""
    edges, open_a, open_b = [], link.any(1), link.any(0)
    for seed in np.flatnonzero(open_a):
        if not open_a[seed]:
            continue
        open_a[seed] = False
        queue = [(0, int(seed))]
        while queue:
            side, k = queue.pop()
            if side == 0:
                near = np.flatnonzero(link[k] & open_b)
                open_b[near] = False
                edges += [(int(ia[k]), int(ib[j])) for j in near]
                queue += [(1, int(j)) for j in near]
            else:
                near = np.flatnonzero(link[:, k] & open_a)
                open_a[near] = False
                edges += [(int(ia[i]), int(ib[k])) for i in near]
                queue += [(0, int(i)) for i in near]
    return edges


def _compare(bases: dict[int, np.ndarray], least: float, steps: tuple[int, ...], kind: str, block: int):
    """Pairs of tiles to rows (a, b, n): edges of a forest with n 0, and linked copies n of a, b null."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6

    def prepared(mat, dim):
        x = _units(np.frombuffer(mat, kind).reshape(-1, dim).astype(float))
        r = x @ bases.get(dim, np.eye(dim))
        return x, r[:, 0], [_leading(r, k) for k in steps if k < dim]

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples(index=False):
                dim, same = int(r.dim), r.t == r.t2
                a, ya, la = prepared(r.mat, dim)
                b, yb, lb = (a, ya, la) if same else prepared(r.mat2, dim)
                ia, ib = np.frombuffer(r.ids, np.int64), np.frombuffer(r.ids2, np.int64)
                ma, mb = np.frombuffer(r.copies, np.int64), np.frombuffer(r.copies2, np.int64)
                na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                edges: list[tuple[int, int]] = []
                for s in range(0, len(a), block):
                    u = slice(s, s + block)
                    for t in range(s if same else 0, len(b), block):
                        v = slice(t, t + block)
                        if yb[v].min() > ya[u].max() + reach or ya[u].min() > yb[v].max() + reach:
                            continue
                        i, j = linked(a[u], b[v], [(x[u], y[v]) for x, y in zip(la, lb, strict=True)], least)
                        if same and s == t:
                            i, j = i[i < j], j[i < j]
                        if not len(i):
                            continue
                        np.add.at(na, i + s, mb[v][j])
                        np.add.at(na if same else nb, j + t, ma[u][i])
                        link = np.zeros((len(a[u]), len(b[v])), bool)
                        link[i, j] = True
                        if same and s == t:
                            link |= link.T
                        edges += _forest(link, ia[u], ib[v])
                e = np.array(edges, np.int64).reshape(-1, 2)
                hit_a, hit_b = np.flatnonzero(na), np.flatnonzero(nb)
                yield pd.DataFrame({
                    "a": np.r_[e[:, 0], ia[hit_a], ib[hit_b]],
                    "b": np.r_[e[:, 1], np.full(len(hit_a) + len(hit_b), -1)],
                    "n": np.r_[np.zeros(len(e), np.int64), na[hit_a], nb[hit_b]],
                })

    return compared


#: Pairs of tiles, a task each, that are compared at a time.
MOST_TASKS = 20_000


def near_duplicates(vectors: DataFrame, least: float = 0.95, sample: int = 20_000, steps: tuple[int, ...] = (16, 32), tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Links are cosines of at least ``least`` in double precision. Equal vectors are compared once, as
    one representative with its number of copies. Tiles hold vectors of neighbouring first principal
    coordinates; pairs of tiles further apart than two linked unit vectors can be are never met; the
    others are compared in blocks, never as rows. Rows with a null id, or with a null, empty or zero
    vector or one of null or non-finite components, link with nothing: 0 links, component their own
    id, kept (null for a null id). Vectors of different lengths do not link. Repeated rows with one
    id count each other as links and get equal results.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_usable(kind), "vec_id long, vec binary"), "vectors")
    reps = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("m"))
    reps = reps.withColumn("dim", (F.octet_length("vec") / np.dtype(kind).itemsize).cast("int"))
    # An id may belong to several vectors: nodes are numbered by vector.
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    n = reps.count()
    bases = _pca(reps, n, sample, kind)
    first = {dim: b[:, 0] for dim, b in bases.items()}

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            y = np.zeros(len(df))
            for dim in df["dim"].unique():
                own = np.flatnonzero(df["dim"] == dim)
                if dim in first:
                    x = np.frombuffer(b"".join(df["vec"].iloc[own]), kind).reshape(len(own), dim).astype(float)
                    y[own] = _units(x) @ first[dim]
            yield df.assign(y=y)

    placed = reps.select(F.col("node").alias("rid"), "m", "vec", "dim").mapInPandas(project, "rid long, m long, vec binary, dim int, y double")
    parts = max(1, -(-(reps.agg(F.sum(F.octet_length("vec"))).first()[0] or 0) // tile))
    tiles = placed.repartitionByRange(parts, "dim", "y", "rid").sortWithinPartitions("dim", "y", "rid")
    # A session that deals into more partitions than there are tiles would leave many tiny ones, and the square of them in pairs.
    tiles = tiles.coalesce(parts).mapInArrow(_pack(tile), "dim int, lo double, hi double, ids binary, copies binary, mat binary")
    tiles = written(tiles.withColumn("t", F.monotonically_increasing_id()), "tiles")
    # Linked unit vectors are at most this far apart, in every coordinate: a tile meets those that begin from its own
    # beginning to that far beyond its end. Steps of an eighth of that make this an equal join.
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    step = lambda c: F.floor(c * 8 / max(reach, 0.125))
    own = tiles.select("dim", "lo", "hi", "t", F.explode(F.sequence(step(F.col("lo")), step(F.col("hi") + reach))).alias("step"))
    other = tiles.select("dim", F.col("lo").alias("lo2"), F.col("t").alias("t2"), step(F.col("lo")).alias("step"))
    after = (F.col("lo2") > F.col("lo")) | ((F.col("lo2") == F.col("lo")) & (F.col("t2") >= F.col("t")))
    pairs = own.join(other, ["dim", "step"]).where(after & (F.col("lo2") <= F.col("hi") + reach))
    pairs = written(pairs.select("t", "t2"), "pairs")
    right = tiles.select(*(F.col(c).alias(f"{c}2") for c in ("t", "ids", "copies", "mat")))
    # A task a pair of tiles, which is some billion products at most, and so many tasks at a time.
    links = []
    for some, tasks in waves(pairs, ("t", "t2"), MOST_TASKS):
        met = some.join(tiles, "t").join(right, "t2").repartition(max(1, tasks), "t", "t2")
        met = met.select("t", "t2", "dim", "ids", "copies", "mat", "ids2", "copies2", "mat2")
        links.append(written(met.mapInPandas(_compare(bases, least, steps, kind, block), "a long, b long, n long"), "links"))
    found = reduce(DataFrame.unionByName, links)
    comp = written(components(found.where("n = 0").select("a", "b")), "components")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    done = reps.select("vec", "rid", "m", "node").join(counts, F.col("node") == F.col("a"), "left").drop("a")
    done = written(done.join(comp, F.col("node") == F.col("id"), "left").select("vec", "rid", "m", "n", F.coalesce("root", "node").alias("root")), "rooted")
    # Written, so that the join has plain exchanges on both sides and a large component's rows may be split.
    least_id = written(done.groupBy("root").agg(F.min("rid").alias("component_id")), "least")
    done = done.join(least_id, "root").select("vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    # Rows that link with nothing have no vector to be joined on.
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.join(written(done, "results"), "vec").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
