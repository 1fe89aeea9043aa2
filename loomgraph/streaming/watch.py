"""Continuous indexing: file events, debounced, drive incremental updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.versions import BUCKET, Versions

QUIET, POLL = "2 seconds", "1500 milliseconds"


def debounced(events: DataFrame, quiet: str = QUIET, by: str = "user_id", ts: str = "ts", reason: str = "event_type", late: str | None = None) -> DataFrame:
    """One row a burst: events of a key less than ``quiet`` apart; the last reason counts.

    Works on tables and, with a watermark ``late``, on streams.
    """
    source = events.withWatermark(ts, late) if late else events
    w = F.session_window(F.col(ts), quiet)
    out = source.groupBy(by, w.alias("w")).agg(F.count("*").alias("n_events"), F.max_by(reason, F.struct(F.col(ts), F.col(reason))).alias("reason"))
    return out.select(by, F.col("w.start").alias("started"), F.col("w.end").alias("fired"), "n_events", "reason")


def bursts(events: DataFrame, quiet_ms: int = 2000, by: str = "repo", ts: str = "ts", reason: str = "reason") -> DataFrame:
    """A stream of one row a burst, by timers that each event of a key starts again.

    State holds one row a key: what came since the last burst.  A burst is
    given ``quiet_ms`` of processing time after its last event, however late
    that event is; a restarted query goes on with the timers of its checkpoint.
    Rows by, n_events, reason (of the last event by time), last (its time).
    """
    kind = events.schema[by].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, why, last = state.get
            state.remove()
            yield pd.DataFrame({by: [key[0]], "n_events": [n], "reason": [why], "last": [pd.Timestamp(last, unit="us")]})
            return
        n, why, last = state.get if state.exists else (0, None, -(1 << 62))
        for frame in frames:
            at = frame[ts].astype("datetime64[us]").astype("int64")
            newest = frame.assign(__at=at).sort_values(["__at", reason]).iloc[-1]
            n += len(frame)
            if newest["__at"] >= last:
                last, why = int(newest["__at"]), newest[reason]
        state.update((n, why, last))
        state.setTimeoutDuration(quiet_ms)

    return events.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, n_events long, reason string, last timestamp", "n long, reason string, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def synced(fired: DataFrame, folder: str, sync: Callable[[list], None], checkpoint: str, by: str = "repo", poll_ms: int = 1500):
    """Calls ``sync`` with the keys of each batch of bursts; a batch that was synced before a restart isn't again.

    The batch's number is committed next to its work, in the versioned table
    ``synced`` of ``folder``.
    """

    def batch(df: DataFrame, number: int) -> None:
        kept = Versions(df.sparkSession, folder)
        done = kept.read("synced")
        if done is not None and done.where(F.col("batch") == number).count():
            return
        keys = sorted(r[0] for r in df.select(by).distinct().collect())
        if keys:
            sync(keys)
            row = df.sparkSession.createDataFrame([(number,)], "batch long").withColumn(BUCKET, F.lit(number % 64))
            kept.commit({"synced": (row, [number % 64], 64, [])})

    return fired.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{poll_ms} milliseconds").start()


def file_changes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, modificationTime, length) of files that appear under a folder."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def watch(spark: SparkSession, folder: str, action: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*"):
    """Runs ``action(changed files, batch)`` for each poll that found any; the query to stop is returned."""
    return file_changes(spark, folder, pattern).writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(processingTime=POLL).start()


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that differ in time or length between two snapshots."""
    stamp = F.struct("modificationTime", "length")
    both = old.select("path", stamp.alias("a")).join(new.select("path", stamp.alias("b")), "path", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").otherwise("changed").alias("status"))
