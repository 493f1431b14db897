"""Stateful and streaming jobs over an event stream.

Each job reads its files as a stream, processes what is there (``availableNow``) with a checkpoint in the
shared folder, and can be started again: files already taken are not taken twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quadrille.sources.versions import append_batch, appended
from quadrille.storage import scratch

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENT).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def drained(stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run a stream until its files are done; what it wrote."""
    spark = stream.sparkSession
    path = path or scratch(spark, label)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint or scratch(spark, f"{label}-checkpoint"))
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:  # the whole result of the last batch
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ledgered(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream until its files are done; each batch is added with its entry in the table's log, once, also if it was
    cut off before or behind that entry. All batches so far."""

    def take(batch: DataFrame, number: int) -> None:
        append_batch(batch, number, path)

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(take).start().awaitTermination()
    return appended(stream.sparkSession, path, stream.schema)


def admit(requests: list[int], start: int | None, in_window: int, in_session: int, window: int, per_window: int, per_session: int) -> tuple[list[str], int | None, int, int]:
    """Verdicts on requests at times in order, and the state after: a window opens with the first request after
    the last one's end, and both the window and the session have a cap."""
    out = []
    for t in requests:
        if start is None or t - start >= window:
            start, in_window = t, 0
        if in_session >= per_session:
            out.append("session-limit")
        elif in_window >= per_window:
            out.append("rate-limit")
        else:
            in_window, in_session = in_window + 1, in_session + 1
            out.append("executed")
    return out, start, in_window, in_session


def request_windows(events: DataFrame, window_s: int = 3600, per_window: int = 2, per_session: int = 40) -> DataFrame:
    """(user_id, event_id, verdict) of a stream of requests, one session a user; the state is three numbers."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        start, n, total = state.get if state.exists else (None, 0, 0)
        times = [int(t.timestamp()) for t in rows["ts"]]
        verdicts, start, n, total = admit(times, start, n, total, window_s, per_window, per_session)
        state.update((start, n, total))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "verdict": verdicts})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, verdict string", "start long, n long, total long", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts and sums by window and type (an extension; the windows are aligned to the epoch)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions by user (an extension): a session ends when no event comes for ``gap``."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")
