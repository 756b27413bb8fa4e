"""Nearest neighbours by a k-d partition: leaves of bounded size from sampled medians, however points cluster.

Points are split where a sample's median lies, along the wider axis, again and again until no leaf holds more than it may;
points of one place are split by id. A point's nearest within its leaf bound what it can find elsewhere, so it asks only the
leaves whose box is within that distance. Work is one leaf against points of another, packed in two rows; no cell, cluster
or pair of a large group comes together in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftgrid.shared import shared_table

#: Points of a leaf, sampled points of a leaf that is split, and how often a split is split again before points move.
LEAF, SAMPLE, DEPTH = 1024, 2048, 6
#: Leaves whose boxes go to every task (64 bytes each); with more points leaves grow instead.
MOST_LEAVES = 1_000_000


def _splits(r: np.ndarray, c: np.ndarray, i: np.ndarray, parts: float) -> tuple[list[int], list[float], list[int]]:
    """A complete tree of ``DEPTH`` levels, in heap order: axis (0 rows, 1 columns, 2 ids, 3 not split) and from what value on a
    point goes right. A node is split while it stands for more than one of ``parts``."""
    n = 2**DEPTH - 1
    axis, at, at_id = [3] * n, [0.0] * n, [0] * n
    held = {0: np.arange(len(r))}
    for k in range(n):
        own = held.pop(k, None)
        if own is None or parts * len(own) <= len(r) or len(own) < 2:
            continue
        wide = [np.ptp(r[own]), np.ptp(c[own])]
        axis[k] = int(np.argmax(wide)) if max(wide) > 0 else 2
        v = (r, c, i)[axis[k]][own]
        middle = np.sort(v)[len(v) // 2]
        middle = v[v > middle].min() if middle == v.min() and (v > middle).any() else middle  # else the left side would be empty
        if axis[k] == 2:
            at_id[k] = int(middle)
        else:
            at[k] = float(middle)
        right = v >= middle
        held[2 * k + 1], held[2 * k + 2] = own[~right], own[right]
    return axis, at, at_id


def partitioned(pts: DataFrame, keys: list[str], leaf: int) -> DataFrame:
    """``pts(keys, i, r, c)`` with ``leaf``, a number: no leaf of one of the ``keys`` has more than ``leaf`` points."""
    own = [*keys, "leaf"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pts.select(*keys).schema)
    out, done = shared_table(pts.withColumn("leaf", F.lit(0).cast("bigint")), "points"), None
    while True:
        counts = out.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
        large = shared_table(counts.where(F.col("_n") > leaf), "large")
        if large.isEmpty():
            return out if done is None else done.unionByName(out)
        rest = out.join(large.select(*own), own, "left_anti")
        moving = out.join(large, own)
        share = F.shiftrightunsigned(F.xxhash64("i"), 1) < (F.lit(float(SAMPLE)) / F.col("_n") * 2.0**63)
        fixed = F.col("_n") <= SAMPLE

        def built(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            i = np.sort(df["i"].to_numpy())
            df = df.sort_values("i")
            axis, at, at_id = _splits(df["r"].to_numpy(), df["c"].to_numpy(), i, float(df["_n"].iloc[0]) / (0.8 * leaf))
            return pd.DataFrame({**{k: [v] for k, v in zip(own, key, strict=True)}, "axis": [axis], "at": [at], "at_id": [at_id]})

        trees = moving.where(fixed | share).groupBy(*own).applyInPandas(built, f"{kinds}{', ' if kinds else ''}leaf bigint, axis array<int>, at array<double>, at_id array<bigint>")
        trees = shared_table(trees, "splits")

        def down(node, _):
            a = F.get("axis", node)
            right = F.when(a == 0, F.col("r") >= F.get("at", node)).when(a == 1, F.col("c") >= F.get("at", node)).when(a == 2, F.col("i") >= F.get("at_id", node)).otherwise(False)
            return 2 * node + 1 + right.cast("int")

        node = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), down)
        moved = moving.join(trees, own).withColumn("leaf", F.col("leaf") * 2**DEPTH + (node - (2**DEPTH - 1)) + 1)
        done = rest if done is None else done.unionByName(rest)
        out = shared_table(moved.select(*keys, "i", "r", "c", "leaf"), "points")


def best_of(r: np.ndarray, c: np.ndarray, i: np.ndarray, rj: np.ndarray, cj: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``i``, place in ``j``, squared distance) of the ``k`` nearest others of every point; ``j`` in order, ties to the smaller."""
    places, others, far = [], [], []
    for s in range(0, len(i), 256):
        a = slice(s, s + 256)
        d = (r[a, None] - rj) * (r[a, None] - rj) + (c[a, None] - cj) * (c[a, None] - cj)
        d[i[a, None] == j] = np.inf
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
        x, y = np.nonzero((d <= most[:, None]) & (d < np.inf))
        order = np.lexsort((y, d[x, y], x))
        x, y = x[order], y[order]
        first = np.searchsorted(x, np.arange(len(d)))
        near = np.arange(len(x)) - first[x] < k
        places.append(x[near] + s)
        others.append(y[near])
        far.append(d[x[near], y[near]])
    return np.concatenate(places), np.concatenate(others), np.concatenate(far)


def knn(pts: DataFrame, k: int, keys=("pair_id",), pt: str = "m_id", r: str = "r", c: str = "c", leaf: int = LEAF) -> DataFrame:
    """``(keys, i, j, d2, rank)``: the ``k`` nearest others of each point, ties to the smaller id. Points of fewer than ``k``
    others have as many. Ids are whole numbers, one a point of its ``keys``."""
    keys = list(keys)
    a = pts.select(*keys, F.col(pt).cast("bigint").alias("i"), F.col(r).cast("double").alias("r"), F.col(c).cast("double").alias("c"))
    own = [*keys, "leaf"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.select(*keys).schema)
    kinds += ", " if kinds else ""
    a = shared_table(a, "points")
    leaf = max(leaf, k + 1, -(-a.count() // MOST_LEAVES) * 2)
    at = partitioned(a, keys, leaf)
    packed = at.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("i", "r", "c"))).alias("p"))
    packed = shared_table(packed.select(*own, *(F.col(f"p.{n}").alias(n) for n in ("i", "r", "c"))), "leaves")
    boxes = packed.select(*keys, "leaf", F.size("i").alias("n"), *(f(n).alias(f"{n}_{s}") for n in ("r", "c") for f, s in ((F.array_min, "low"), (F.array_max, "high")))).toPandas()  # at most MOST_LEAVES rows
    of_key: dict[tuple, pd.DataFrame] = {key if isinstance(key, tuple) else (key,): df for key, df in boxes.groupby(keys, dropna=False)} if keys else {(): boxes}
    shared = a.sparkSession.sparkContext.broadcast({key: {n: df[n].to_numpy() for n in ("leaf", "n", "r_low", "r_high", "c_low", "c_high")} for key, df in of_key.items()})

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A leaf's points to each leaf that may hold nearer ones than their own, and to their own."""
        for df in frames:
            for t in df.to_dict("records"):
                i, x, y = (np.asarray(t[n]) for n in ("i", "r", "c"))
                place, _, d2 = best_of(x, y, i, x, y, i, k)
                reach = np.full(len(i), np.inf)
                n = np.bincount(place, minlength=len(i))
                last = np.cumsum(n) - 1
                reach[n == k] = d2[last[n == k]]
                b = shared.value[tuple(t[key] for key in keys)]
                full = b["n"] >= k + 1
                for m in np.flatnonzero(np.isinf(reach)) if full.any() else ():  # in a leaf of few points: the far corner of a leaf that has enough
                    far = [np.maximum(np.abs(v - b[f"{n}_low"][full]), np.abs(v - b[f"{n}_high"][full])) for n, v in (("r", x[m]), ("c", y[m]))]
                    reach[m] = (far[0] * far[0] + far[1] * far[1]).min()
                apart = lambda v, low, high: np.maximum(np.maximum(low - v, v - high), 0.0)
                gap_r = np.maximum(np.maximum(b["r_low"] - x.max(), x.min() - b["r_high"]), 0.0)
                gap_c = np.maximum(np.maximum(b["c_low"] - y.max(), y.min() - b["c_high"]), 0.0)
                out = {n: [] for n in ("leaf", "i", "r", "c")}
                for m in np.flatnonzero(gap_r * gap_r + gap_c * gap_c <= reach.max()):
                    dr, dc = apart(x, b["r_low"][m], b["r_high"][m]), apart(y, b["c_low"][m], b["c_high"][m])
                    who = np.flatnonzero((dr * dr + dc * dc <= reach) | (b["leaf"][m] == t["leaf"]))
                    if len(who):
                        for name, v in (("leaf", b["leaf"][m]), ("i", i[who]), ("r", x[who]), ("c", y[who])):
                            out[name].append(v)
                yield pd.DataFrame({key: [t[key]] * len(out["leaf"]) for key in keys} | out)

    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for t in df.to_dict("records"):
                i, j = np.asarray(t["i"]), np.asarray(t["j"])
                a, b, d2 = best_of(np.asarray(t["r"]), np.asarray(t["c"]), i, np.asarray(t["rj"]), np.asarray(t["cj"]), j, k)
                if len(a):
                    yield pd.DataFrame({key: [t[key]] * len(a) for key in keys} | {"i": i[a], "j": j[b], "d2": d2})

    requests = packed.mapInPandas(asked, f"{kinds}leaf bigint, i array<bigint>, r array<double>, c array<double>")
    held = packed.select(*own, F.col("i").alias("j"), F.col("r").alias("rj"), F.col("c").alias("cj"))
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in own]
    met = requests.alias("a").join(held.alias("b"), same).select(*(F.col(f"a.{n}") for n in [*keys, "i", "r", "c"]), "j", "rj", "cj")
    near = met.mapInPandas(answered, f"{kinds}i bigint, j bigint, d2 double")
    rank = F.row_number().over(W.partitionBy(*keys, "i").orderBy("d2", "j"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
