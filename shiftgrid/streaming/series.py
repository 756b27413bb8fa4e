"""Consecutive pairs of a series of acquisitions: the new reference is the old secondary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from shiftgrid.functions.scalar import YEAR_SECONDS, dt_years
from shiftgrid.shared import shared_table

PAIRS = "site string, pair_id string, ref_id string, sec_id string, ref_ts timestamp, sec_ts timestamp, years double"


def pair_series(acquisitions: DataFrame) -> DataFrame:
    """``acquisitions(site, image_id, acq_ts)`` to the pairs of neighbours in time, ties by image id."""
    w = W.partitionBy("site").orderBy("acq_ts", "image_id")
    got = acquisitions.withColumns({"ref_id": F.lag("image_id").over(w), "ref_ts": F.lag("acq_ts").over(w)}).where("ref_id is not null")
    return got.select("site", F.concat_ws("-", "ref_id", "image_id").alias("pair_id"), "ref_id", F.col("image_id").alias("sec_id"), "ref_ts",
                      F.col("acq_ts").alias("sec_ts"), dt_years(F.col("ref_ts"), F.col("acq_ts")).alias("years"))


NAMES = ["site", "pair_id", "ref_id", "sec_id", "ref_ts", "sec_ts", "years"]


def paired(site: str, last: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple | None]:
    """Pairs of a site's new acquisitions with each other and with ``last`` (image_id, acq_ts), and the new last one. What is
    older than ``last``, or the same, is left out."""
    out = []
    for r in rows.sort_values(["acq_ts", "image_id"]).itertuples(index=False):
        if last is not None:
            before = pd.Timestamp(last[1])
            if (r.acq_ts, r.image_id) <= (before, last[0]):
                continue
            out.append((site, f"{last[0]}-{r.image_id}", last[0], r.image_id, before, r.acq_ts, (r.acq_ts - before).total_seconds() / YEAR_SECONDS))
        last = (r.image_id, r.acq_ts)
    return out, last


class LastImage(StatefulProcessor):
    """State of a site: its last acquisition's id and time, for ``idle`` seconds (None: always) since its last change. Images stay in their table."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle) -> None:
        ttl = None if self.idle is None else self.idle * 1000
        self.last = handle.getValueState("last", "image_id string, acq_ts timestamp", ttl) if ttl else handle.getValueState("last", "image_id string, acq_ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, last = paired(key[0], self.last.get() if self.last.exists() else None, pd.concat(list(rows)))
        if last is not None:
            self.last.update((last[0], pd.Timestamp(last[1]).to_pydatetime()))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def stream_pairs(acquisitions: DataFrame, late: str = "1 day", idle: int | None = None) -> DataFrame:
    """The same pairs as they arrive. Acquisitions later than ``late`` behind, or older than what their site has
    been paired up to, are dropped. A site that has been silent for ``idle`` seconds begins anew. Needs the RocksDB state store."""
    marked = acquisitions.withWatermark("acq_ts", late)
    return marked.groupBy("site").transformWithStateInPandas(LastImage(idle), PAIRS, "Append", "ProcessingTime" if idle else "None")


def stream_pairs_by_batch(acquisitions: DataFrame, late: str = "1 day", idle: int | None = None) -> DataFrame:
    """As :func:`stream_pairs`, with the older state API, which any state store serves. ``idle`` counts in the stream's own
    time: a site begins anew once the watermark has passed its last acquisition by so many seconds."""

    def of(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=NAMES)
            return
        out, last = paired(key[0], state.get if state.exists else None, pd.concat(list(frames)))
        if last is not None:
            at = pd.Timestamp(last[1])
            state.update((last[0], at.to_pydatetime()))
            if idle is not None:
                state.setTimeoutTimestamp(max(int(at.timestamp() * 1000) + idle * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=NAMES)

    marked = acquisitions.withWatermark("acq_ts", late)
    return marked.groupBy("site").applyInPandasWithState(of, PAIRS, "image_id string, acq_ts timestamp", "append", "EventTimeTimeout" if idle is not None else "NoTimeout")


def write_fields(pairs: DataFrame, field_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A stream of pairs to a table of their fields under ``path``: each batch's pairs are tracked by ``field_of`` (as ``Session.track``
    is) and written to a folder of the batch's number, which a batch that is run again replaces, so every pair is there once.
    Returns the query builder; read the table with :func:`read_fields`."""

    def store(batch: DataFrame, number: int) -> None:
        batch = shared_table(batch, "batch")  # state is read once, whatever the plan of the fields reads
        if batch.isEmpty():
            return
        field_of(batch.select("pair_id", "ref_id", "sec_id", "years")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_fields` has written so far, with ``batch``."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
