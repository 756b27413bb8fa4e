"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftgrid.llm.util import hash_sample, waves, written

#: Vectors of a packed block, blocks of a share (neighbours in norm order), and queries of a query block.
#: A task meets one share with one query block; both have about as many rows, so both move about as often.
BLOCK, BLOCKS, QUERIES = 2048, 8, 16_384
#: Queries of a product; products of norms below which doubles hold every integer, and beyond which they may overflow.
ROWS, EXACT, HUGE = 1024, 2.0**53, 1e290
LONGS = np.iinfo(np.int64)


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``(vec_id, v array<double>, norm double)``: floor(scale * x) of each component, x as double; whole
    numbers, which doubles hold whatever their size.

    Rows whose vector is null, empty or holds null or non-finite components are left out, and those of
    which ``scale`` makes a component non-finite.
    """
    v = F.transform("embedding", lambda x: scale * x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(~F.exists("v", bad))
    # Spark's floor gives longs; from 2 ** 53 on a double is whole as it is.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)))
    # Squares of parts of the largest, which never overflow; that is bound to a lambda's variable, so it is found once.
    of = lambda big: F.when(big > 0, big * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / big) * (x / big)))).otherwise(0.0)
    return rows.withColumn("norm", F.transform(F.array(F.greatest(F.array_max("v"), -F.array_min("v"))), of)[0])


def rotation(rows: DataFrame, dim: int, n: int, sample: int = 20_000) -> np.ndarray:
    """Right singular vectors, largest first, of the directions of a bounded sample of rows (smallest hashes of id).

    Any rotation gives the same results; this one makes leading sums tell most.
    """
    got = hash_sample(rows.where((F.size("v") == dim) & (F.col("norm") > 0)).select("vec_id", "v", "norm"), ("vec_id", "v"), sample, n).toPandas()
    if not len(got):
        return np.eye(dim)
    x = np.stack(got["v"].to_numpy()).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    _, basis = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(basis[:, ::-1])


def _pack(dim: int, size: int):
    """Rows to blocks of ``size``: ids, matrix (doubles, zero-padded to ``dim``), norms, the largest norm."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mats, norms, held = [], [], [], 0

        def block():
            n = np.concatenate(norms)
            return pa.RecordBatch.from_arrays(
                [pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(mats).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([float(n.max())], pa.float64())],
                names=["ids", "mat", "norms", "norm"])

        for b in batches:
            own, n = b.column("vec_id").to_numpy(), b.column("norm").to_numpy()
            width = np.diff(b.column("v").offsets.to_numpy())
            x = np.zeros((len(own), dim))
            x[np.arange(dim)[None, :] < width[:, None]] = b.column("v").flatten().to_numpy()
            at = 0
            while at < len(own):
                stop = min(at + size - held, len(own))
                ids.append(own[at:stop]), mats.append(x[at:stop]), norms.append(n[at:stop])
                held, at = held + stop - at, stop
                if held == size:
                    yield block()
                    ids, mats, norms, held = [], [], [], 0
        if held:
            yield block()

    return packed


def _whole(q: np.ndarray, x: np.ndarray) -> int:
    """The inner product of two rows of whole doubles, exact, as the nearest long."""
    return min(max(sum(int(a) * int(b) for a, b in zip(q, x, strict=True)), LONGS.min), LONGS.max)


class _Best:
    """The best ``k`` so far of each query of a block, met by blocks of candidates in any order."""

    def __init__(self, r, dim: int, basis: np.ndarray, k: int, lead: int):
        self.qb, self.k, self.basis, self.lead = r.qb, k, basis, lead
        self.ids, self.norm = np.frombuffer(r.ids, np.int64), np.frombuffer(r.norms, np.float64)
        self.q = np.frombuffer(r.mat, np.float64).reshape(-1, dim)
        with np.errstate(all="ignore"):
            rot = self.q @ basis
            self.rot, self.rest = rot[:, :lead], np.sqrt((rot[:, lead:] ** 2).sum(1))
        n = len(self.ids)
        # What a candidate has to reach: from earlier shares, and from the own k best.
        self.bar = np.frombuffer(r.bars, np.float64).copy() if r.bars is not None else np.full(n, -np.inf)
        self.score, self.vec, self.size = np.full((n, k), LONGS.min), np.full((n, k), LONGS.max), np.zeros(n, np.int64)

    def meet(self, r) -> None:
        ids, x, norms = np.frombuffer(r.ids, np.int64), np.frombuffer(r.mat, np.float64).reshape(-1, self.q.shape[1]), np.frombuffer(r.norms, np.float64)
        rot = rest = None
        for s in range(0, len(self.ids), ROWS):
            with np.errstate(all="ignore"):
                live = s + np.flatnonzero(self.norm[s : s + ROWS] * (r.norm * (1 + 1e-12)) >= self.bar[s : s + ROWS])
                if not len(live):
                    continue
                if rot is None:
                    whole = x @ self.basis
                    rot, rest = whole[:, : self.lead], np.sqrt((whole[:, self.lead :] ** 2).sum(1))
                reach = np.outer(self.norm[live], norms)
                bound = self.rot[live] @ rot.T + np.outer(self.rest[live], rest)
                may = ~(bound + (reach * 1e-12 + 1e-6) < self.bar[live][:, None]) | ~(reach < HUGE)
                may &= ids[None, :] != self.ids[live][:, None]
                cols = np.flatnonzero(may.any(0))
                if not len(cols):
                    continue
                full, may, reach = self.q[live] @ x[cols].T, may[:, cols], reach[:, cols]
                # Below 2 ** 53 sums of products of whole numbers are exact; beyond, off by so much at most.
                off = np.where(reach < EXACT / 2, 0.0, np.where(reach < HUGE, reach * (2.0**-50 * x.shape[1]), np.inf))
                low, high = np.where(may, full - off, -np.inf), np.where(may, full + off, -np.inf)
                # Scores end at the longs' ends, so those beyond tie there.
                low = np.where(may, np.clip(np.where(np.isnan(low), -np.inf, low), LONGS.min, LONGS.max), -np.inf)
                high = np.clip(np.where(np.isnan(high), np.inf, high), LONGS.min, LONGS.max)
                bar = self.bar[live]
                if low.shape[1] > self.k:
                    bar = np.maximum(bar, np.partition(low, -self.k, axis=1)[:, -self.k])
                take = (high >= bar[:, None]) & may
            for i, row in zip(live, range(len(live)), strict=True):
                own = np.flatnonzero(take[row])
                if len(own):
                    self._put(int(i), ids[cols[own]], [int(full[row, c]) if off[row, c] == 0 else _whole(self.q[i], x[cols[c]]) for c in own])

    def _put(self, i: int, vec: np.ndarray, score: list[int]) -> None:
        n = self.size[i]
        score, vec = np.r_[self.score[i, :n], np.array(score, np.int64)], np.r_[self.vec[i, :n], vec]
        order = np.lexsort((vec, ~score))[: self.k]  # ~ reverses the order of longs, and overflows for none
        n = self.size[i] = len(order)
        self.score[i, :n], self.vec[i, :n] = score[order], vec[order]
        if n == self.k:
            least = float(self.score[i, n - 1])
            self.bar[i] = max(self.bar[i], least if abs(least) < EXACT else np.nextafter(least, -np.inf))

    def out(self) -> pd.DataFrame:
        hit = np.arange(self.k)[None, :] < self.size[:, None]
        with np.errstate(all="ignore"):
            need = np.where(self.norm > 0, self.bar / self.norm, -np.inf)
        need = need.min(initial=np.inf)
        return pd.DataFrame({"qb": [self.qb], "need": [float(need)], "bars": [self.bar.tobytes()], "q": [np.repeat(self.ids, self.size)], "v": [self.vec[hit]], "s": [self.score[hit]]})


def _search(dim: int, basis: np.ndarray, k: int, lead: int):
    """Rows sorted by query block and share, the queries first, then the share's blocks: for each share
    the best k, and the bars reached."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for df in frames:
            for r in df.itertuples(index=False):
                if r.asks:
                    if state is not None:
                        yield state.out()
                    state = _Best(r, dim, basis, k, lead)
                else:
                    state.meet(r)
        if state is not None:
            yield state.out()

    return best


#: Pairs of a query block and a share, a task each, that meet at a time.
MOST_TASKS = 20_000


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest integer inner products for each row whose
    vec_id is divisible by ``every``, against all other rows; ties to the smaller vec_id.

    Shorter vectors are padded with zeros. Rows without an id, and vectors that are null, empty or
    hold null or non-finite components, take no part. Products are exact whatever their size; one
    beyond a long counts as the nearest long. Where a query's vec_id repeats, its smallest vector
    asks; repeated candidates each count, but none with the query's own id.

    Vectors lie in shares by falling norm. All queries first meet the first share; what each has to beat
    from there on goes with its query block, and only shares whose largest norm can still reach one of
    those are sent to it.
    """
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors, scale), "vectors")
    dim, n, n_q = rows.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    if not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = rotation(rows, dim, n)
    n_share, n_qb = -(-n // (BLOCK * BLOCKS)), -(-n_q // QUERIES)
    kinds = "ids binary, mat binary, norms binary, norm double"
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("b")).select("vec_id", "b.v", "b.norm")
    asked = asked.repartition(n_qb, "vec_id").mapInArrow(_pack(dim, QUERIES), kinds)
    asked = written(asked.withColumn("qb", F.monotonically_increasing_id()), "queries")
    # Norm order over the whole table: ranges by falling norm, ids telling equal norms apart.
    blocks = rows.repartitionByRange(n_share, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id").mapInArrow(_pack(dim, BLOCK), kinds)
    blocks = written(blocks.withColumn("share", F.spark_partition_id()), "blocks")
    shares = written(blocks.groupBy("share").agg(F.max("norm").alias("most")), "shares")  # a row a share, as many as 16,384 vectors
    payload = ["qb", "share", "asks", "ids", "mat", "norms", "norm", "bars"]

    def met(due: DataFrame, queries: DataFrame, tasks: int, name: str) -> DataFrame:
        """The shares of ``due(qb, share)`` against ``queries``, which go once to each share, not to each block."""
        to = queries.join(due, "qb").withColumn("asks", F.lit(True))
        own = blocks.join(due, "share").withColumns({"asks": F.lit(False), "bars": F.lit(None).cast("binary")})
        every = to.select(*payload).unionByName(own.select(*payload)).repartition(tasks, "qb", "share")
        every = every.sortWithinPartitions("qb", "share", F.desc("asks"), F.desc("norm"), "ids")
        return written(every.mapInPandas(_search(dim, basis, k, max(1, dim // 4)), "qb long, need double, bars binary, q array<long>, v array<long>, s array<long>"), name)

    # The first share that has rows: a range may be empty.
    top = shares.agg(F.min("share")).first()[0]
    first = met(asked.select("qb", F.explode(F.array(F.lit(top))).alias("share")), asked.withColumn("bars", F.lit(None).cast("binary")), n_qb, "first")
    # Numbers of blocks and shares only: which share a query block still has to meet.
    due = first.select("qb", "need", F.explode(F.sequence(F.lit(0), F.lit(n_share - 1))).alias("share")).where(F.col("share") != top)
    due = written(due.join(shares, "share").where(F.col("most") * (1 + 1e-9) >= F.col("need")).select("qb", "share"), "due")
    bars = asked.join(first.select("qb", "bars"), "qb")
    rest = [met(some, bars, max(1, tasks), "rest") for some, tasks in waves(due, ("qb", "share"), MOST_TASKS)]
    found = reduce(DataFrame.unionByName, rest, first).select(F.explode(F.arrays_zip("q", "v", "s")).alias("e")).select(F.col("e.q").alias("query_id"), F.col("e.v").alias("vec_id"), F.col("e.s").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
