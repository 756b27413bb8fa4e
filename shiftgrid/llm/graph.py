"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.util import written


EDGES_A_TASK = 50_000


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(id, root)``: each node that has an edge to another, with the
    smallest node of its component.

    Every round lets each node hand its larger neighbours the smallest node it sees (large star),
    then its smaller neighbours (small star), until the edges are stars. The minima of a round are
    written before they are joined, so both sides of the join are plain exchanges and AQE may split
    the rows of a hub. Only two numbers a round reach the driver. Self-loops and null ends are
    ignored; no edges give no rows.
    """
    ok = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    stars = written(ok.distinct(), "edges")
    before = _state(stars)
    few = max(8, -(-before[0] // EDGES_A_TASK))  # small graphs take few tasks a step; large ones as many as the shuffle has
    while before[0]:
        both = stars.union(stars.select("lo", "hi")).toDF("u", "v")
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(few), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = written(large.distinct().coalesce(few), "large")
        low = written(large.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(few), "low")
        met = large.join(low, "hi")
        small = met.select(F.explode(F.array(
            F.struct("hi", F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
        )).alias("e")).select("e.*").where("hi <> lo")
        stars = written(small.distinct().coalesce(few), "stars")
        after = _state(stars)
        if after == before:
            break
        before = after
    nodes = stars.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return nodes.union(stars.select("lo", "lo").distinct().toDF("id", "root"))
