"""Incremental folder watch and run-log folding with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from evigraph.operators.checks import manifest_diff


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends (path, byte_size, sha256, seen) of files not seen yet to a Parquet manifest, then stops; the checkpoint remembers what was seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("seen"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(spark: SparkSession, manifest: str) -> DataFrame:
    """(path, change) between the newest and the one before of each path in a watched manifest (path, byte_size, sha256, seen)."""
    rows = spark.read.parquet(manifest)
    ordered = rows.withColumn("i", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seen")))).where("i <= 2")
    side = lambda i: ordered.where(F.col("i") == i).select("path", "byte_size", "sha256")
    return manifest_diff(side(2), side(1)).where("change <> 'unchanged'")


def latest_runs(log: DataFrame) -> DataFrame:
    """The newest status of each run of a streaming or batch log (run_id, status, ts, event_id), by one aggregation in update or complete mode."""
    return log.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extension: events per type and window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def replayed(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """What a stream has written by the time it has read all there is; run again, it goes on from the checkpoint."""
    spark, query = stream.sparkSession, stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def debounced(events: DataFrame, key: str, quiet: str = "2 seconds", late: str = "0 seconds") -> DataFrame:
    """(key, first, last, n) of bursts: events (key, ts) of one key that follow each other in less than ``quiet`` are one change.

    Session windows keep one row of state a burst.  A burst is told once, when the watermark, ``late`` behind the newest event, has passed its end.
    """
    bursts = events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return bursts.select(key, "first", "last", "n")


# The moves of a run; all others are refused.
RUN_MOVES = {
    "queued": ("running", "paused", "cancelled"),
    "running": ("succeeded", "partial", "failed", "paused", "cancelled", "interrupted"),
    "paused": ("queued",),
    "interrupted": ("queued",),
    "cancelled": ("queued",),
    "failed": ("queued",),
}


def run_moves(log: DataFrame) -> DataFrame:
    """(run_id, event_id, ts, was, status, outcome) of every row of a run log (run_id, event_id, ts, status): moved, refused or late.

    A refused move leaves the run as it was; a run begins as queued.  Works on streams: a run's state is its status and the time and event
    of the last row it has seen.  The rows of a micro-batch are taken in the order (ts, event_id); one that is older than what an earlier batch
    has brought is late and changes nothing.
    """
    import pandas as pd

    def run(key, frames, state):
        was, ts, event = state.get if state.exists else ("", pd.Timestamp(1900, 1, 1), -1)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            if (r.ts, r.event_id) <= (ts, event):
                out.append((key[0], r.event_id, r.ts, was or None, r.status, "late"))
                continue
            ts, event = r.ts, r.event_id
            legal = r.status in RUN_MOVES.get(was, ()) if was else r.status == "queued"
            out.append((key[0], r.event_id, r.ts, was or None, r.status, "moved" if legal else "refused"))
            was = r.status if legal else was
        state.update((was, ts, event))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "ts", "was", "status", "outcome"])

    kind = dict(log.dtypes)["run_id"]
    return log.select("run_id", "event_id", "ts", "status").groupBy("run_id").applyInPandasWithState(
        run, f"run_id {kind}, event_id long, ts timestamp, was string, status string, outcome string", "was string, ts timestamp, event_id long", "append", "NoTimeout"
    )
