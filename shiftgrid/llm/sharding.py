"""Sharding by sampled splitters, DataFrame functions only.

A size-weighted sample of keys gives quantile boundaries; records are put into the ranges between
them, ranges that turn out too full are subdivided, and running sums over ranges and within them give
every record its exact place in key order, from which the shard follows. Keys are checksums of texts, so
equal texts lie together; groups of them that are large against a shard are ranges of their own.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftgrid.llm.util import repeated, text_of, written

#: Bytes a record has besides its text.
OVERHEAD = 16


def splitters(records: DataFrame, ranges: int, per_range: int = 24) -> list[int]:
    """At most ``ranges - 1`` boundaries: quantiles of a sample of ``ranges * per_range`` keys.

    Keys are drawn with chances in proportion to size, without replacement, by the smallest
    exponential clock over size; the clock's randomness is a hash of the record, so reruns agree. The
    sample is the operator's only bounded one; it decides how even the ranges are, not the result.
    """
    want = ranges * per_range
    total = records.agg(F.sum("size")).first()[0] or 0
    u = (F.shiftrightunsigned(F.xxhash64("text_crc32", "doc_id", F.lit(5)), 11) + 1) / float(1 << 53)
    clocks = records.select(F.col("text_crc32").alias("key"), (-F.log(u) / F.col("size")).alias("clock"))
    # About twice as many clocks as wanted run out before this; the driver sees no more, however many tasks there are.
    drawn = clocks.where(F.col("clock") < 2.0 * want / max(total, 1)).orderBy("clock", "key").limit(want)
    keys = sorted(r[0] for r in drawn.collect())
    step = max(1, per_range)
    return sorted(set(keys[step::step]))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at most ``key``, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    table = F.array(*(F.lit(b) for b in bounds))
    n = len(bounds)
    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = (acc["lo"] < acc["hi"]) & (F.get(table, F.least(mid, F.lit(n - 1))) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when((acc["lo"] < acc["hi"]) & ~right, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve)["lo"]


def grown(doc_id: Column, shards: int) -> Column:
    """The ``key`` law: the shard whose hash with the id is highest, so one more only takes rows into itself."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(s, doc_id).alias("h"), s.alias("s"))))
    return best["s"]


#: A group of equal texts of more than this part of a shard's bytes, or of its share of rows, is placed by itself; no
#: more than twice shards over this are.
LARGE = 0.01
#: Groups of no more rows than this are not large by rows.
ROWS = 10_000


def _level(loads: list[float], more: float) -> list[float]:
    """What each of ``loads`` takes of ``more`` so that they end as even as can be: the fill up to one level."""
    level, ordered = 0.0, sorted(loads)
    for k in range(1, len(ordered) + 1):
        level = (more + sum(ordered[:k])) / k
        if k == len(ordered) or level <= ordered[k]:
            break
    return [max(0.0, level - x) for x in loads]


def _deal(groups: list[tuple], shards: int, target: float) -> tuple[list[tuple], list[float]]:
    """Large groups ``(r, size, n)`` to pieces ``(r, piece, rows a piece, shard, rows before it in its shard)`` and
    the shards' loads: the largest piece first, each to the least loaded shard. Only a group that is larger
    than a shard is cut, into pieces of a shard at most."""
    pieces = []
    for r, size, n in groups:
        each = n if n * size <= target else max(1, int(target // size))
        pieces += [(min(each, n - k * each) * size, r, k, each, min(each, n - k * each)) for k in range(-(-n // each))]
    heap, loads, counts, out = [(0.0, s) for s in range(shards)], [0.0] * shards, [0] * shards, []
    for b, r, k, each, rows in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        load, s = heapq.heappop(heap)
        out.append((r, k, each, s, counts[s]))
        loads[s], counts[s] = load + b, counts[s] + rows
        heapq.heappush(heap, (loads[s], s))
    return out, loads


def shard(docs: DataFrame, shards: int = 40, law: str = "bytes", ranges: int | None = None) -> DataFrame:
    """Each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``bytes``: equal texts lie in one shard; only a group of them that is larger than a shard is cut. Groups
    of more than a hundredth of a shard, in bytes or in rows, are dealt first, the largest to the least loaded shard; the others
    fill the shards up to one level, in order of checksum, each group where its middle falls. So sizes are
    off by a hundredth of a shard, or by a record that is larger than that.
    ``rows``: shards take consecutive records in that order, with counts at most one apart; a boundary may
    cut a group. ``key``: the shard is decided by doc_id and the number of shards, one more taking rows only
    into itself; ``grown_shard`` is that. Slots run from 0 within a shard. A null id is hashed like a value,
    a null text is empty; repeated rows differ in their slots alone; an empty table gives no rows. Other
    columns are not read.
    """
    if law not in ("bytes", "rows", "key"):
        raise ValueError(f"law: {law!r} is none of bytes, rows, key")
    spark, text = docs.sparkSession, text_of()
    raw = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # Rows that agree in all three are one item of n; they get consecutive places and are made rows again at the end.
    items = raw.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    if law == "key":
        items = items.withColumns({"ks": grown(F.col("doc_id"), shards), "gs": grown(F.col("doc_id"), shards + 1)})
    records = written(items, "records")
    ranges = ranges or shards * 16
    bytes_, rows = F.sum(F.col("size") * F.col("n")), F.sum("n")
    total_b, total_c = (x or 0 for x in records.agg(bytes_, rows).first())
    placed = records.withColumn("r", _range_of(F.col("text_crc32"), splitters(records, ranges)))
    large: list[tuple] = []
    if law == "bytes":
        groups = records.groupBy("text_crc32", "size").agg(rows.alias("n"))
        # Their sizes, and their rows, add up to no more than all, so these are at most 2 * shards / LARGE rows.
        got = groups.where((F.col("size") * F.col("n") > LARGE * total_b / shards) | (F.col("n") > F.greatest(F.lit(ROWS), F.lit(LARGE * total_c / shards)))).collect()
        large = [(ranges + k, g["text_crc32"], g["size"], g["n"]) for k, g in enumerate(sorted(got))]
        if large:
            own = spark.createDataFrame(large, "own int, text_crc32 long, size long, _n long").drop("_n")
            placed = placed.join(F.broadcast(own), ["text_crc32", "size"], "left").withColumn("r", F.coalesce("own", "r")).drop("own")
    # Overfull ranges, told by their exact sizes, are subdivided by a hash; other ranges are one part.
    full = placed.groupBy("r").agg(bytes_.alias("b"), rows.alias("c"))
    parts = F.greatest(F.ceil(F.col("b") / max(1.0, 2.0 * total_b / ranges)), F.ceil(F.col("c") / max(1.0, 2.0 * total_c / ranges))).cast("int")
    over = {x["r"]: x["p"] for x in full.withColumn("p", parts).where("p > 1").select("r", "p").collect()}  # at most as many as ranges and large groups
    part = F.lit(0)
    if over:
        of_range = F.create_map(*(F.lit(x) for kv in over.items() for x in kv))
        # Parts of a range hold whole groups where groups matter; a large group is cut by ids.
        by_group = F.xxhash64("text_crc32", "size") if law == "bytes" else F.xxhash64("text_crc32", "doc_id")
        h = F.when(F.col("r") >= ranges, F.xxhash64("doc_id")).otherwise(by_group)
        part = F.pmod(h, F.coalesce(F.element_at(of_range, F.col("r")), F.lit(1)).cast("long")).cast("int")
    placed = placed.withColumn("sub", part)
    by = ["ks", "r", "sub"] if law == "key" else ["r", "sub"]
    sums = placed.groupBy(*by).agg(bytes_.alias("b"), rows.alias("c"))
    # A row for each range and part: some thousands, set by the number of shards.
    before = (W.partitionBy("ks").orderBy("r", "sub") if law == "key" else W.orderBy("r", "sub")).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    starts = written(starts, "starts")
    order = W.partitionBy(*by).orderBy("text_crc32", "size", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    running = placed.withColumns({"bw": F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n"), "cw": F.sum("n").over(order) - F.col("n")})
    at = running.join(F.broadcast(starts), by).withColumn("rank", F.col("c0") + F.col("cw"))
    names = ("doc_id", "size", "text_crc32", F.lit(law).alias("law"))
    none = F.lit(None).cast("int").alias("grown_shard")
    if law == "key":
        return repeated(at, "n").select(*names, F.col("ks").alias("shard"), (F.col("rank") + F.col("i")).alias("slot"), F.col("gs").alias("grown_shard"))
    if law == "rows":
        rank = F.col("rank") + F.col("i")
        of_rows = F.floor(rank.cast("decimal(38,0)") * shards / F.lit(max(total_c, 1))).cast("int")
        out = written(repeated(at, "n").select("doc_id", "size", "text_crc32", F.least(of_rows, F.lit(shards - 1)).alias("shard"), rank.alias("rank")), "sharded")
        first = out.groupBy("shard").agg(F.min("rank").alias("first"))  # a row a shard
        return out.join(F.broadcast(first), "shard").select(*names, "shard", (F.col("rank") - F.col("first")).alias("slot"), none)
    dealt, loads = _deal([(r, size, n) for r, _, size, n in large], shards, total_b / shards)
    rest = total_b - sum(size * n for _, _, size, n in large)
    takes = _level(loads, rest)
    bounds = [math.ceil(sum(takes[: k + 1])) for k in range(shards - 1)]
    # Each small group is where its middle falls in what the shards take.
    group = W.partitionBy("r", "sub", "text_crc32", "size")
    small = at.where(F.col("r") < ranges).withColumns({"g0": F.col("b0") + F.min("bw").over(group), "gb": F.sum(F.col("size") * F.col("n")).over(group)})
    small = small.withColumn("shard", _range_of(F.floor(F.col("g0") + F.col("gb") / 2), bounds)).select("doc_id", "size", "text_crc32", "n", "shard", "rank")
    small = written(small, "small")
    first = written(small.groupBy("shard").agg(F.min("rank").alias("first"), F.sum("n").alias("held")), "first")  # a row a shard
    slots = small.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "n", "shard", (F.col("rank") - F.col("first")).alias("slot0"))
    every = repeated(slots, "n").select(*names, "shard", (F.col("slot0") + F.col("i")).alias("slot"), none)
    if not large:
        return every
    # As many rows as pieces of large groups, which the number of shards bounds.
    pieces = spark.createDataFrame(dealt, "r int, piece long, each long, shard int, ahead long").join(first.select("shard", "held"), "shard", "left")
    pieces = pieces.select("r", "piece", "shard", (F.col("ahead") + F.coalesce("held", F.lit(0))).alias("ahead"))
    own = starts.where(F.col("r") >= ranges).groupBy("r").agg(F.min("c0").alias("g0"))
    each = spark.createDataFrame(sorted({(r, e) for r, _, e, _, _ in dealt}), "r int, each long")
    big = at.where(F.col("r") >= ranges).join(F.broadcast(own), "r").join(F.broadcast(each), "r")
    big = repeated(big, "n").withColumn("k", F.col("rank") - F.col("g0") + F.col("i")).withColumn("piece", F.expr("k div each"))
    big = big.join(F.broadcast(pieces), ["r", "piece"])
    return every.unionByName(big.select(*names, "shard", (F.col("ahead") + F.col("k") % F.col("each")).alias("slot"), none))

