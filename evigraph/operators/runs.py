"""Runs, idempotency, transactions and latency, folded from append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.constants import MAX_RETRIES, RETRY_STATUS


def latest(log: DataFrame) -> DataFrame:
    """The newest row (status, ts) of each run."""
    return log.groupBy("run_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("x"), F.count("*").alias("n_events")).select("run_id", "x.status", "x.ts", "n_events")


def retryable(status: Column, attempts: Column) -> Column:
    return (status.isin(*RETRY_STATUS) | status.between(500, 599)) & (attempts <= MAX_RETRIES)


def publishable(attempts: DataFrame) -> DataFrame:
    """Adds publishes (only the last attempt, not cancelled) and usage_total (late attempts count as well)."""
    w = W.partitionBy("run_id")
    return attempts.withColumn("publishes", (F.col("attempt") == F.max("attempt").over(w)) & (F.col("status") == "succeeded")).withColumn("usage_total", F.round(F.sum("usage").over(w), 6))


def idempotency(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds decision for requests (key, operation, input_hash)."""
    known = stored.select("key", "operation", F.col("input_hash").alias("first_hash"), "state")
    decision = F.when(F.col("first_hash").isNull(), "execute").when(F.col("first_hash") != F.col("input_hash"), "IDEMPOTENCY_KEY_REUSED").when(F.col("state") == "in_progress", "attach").otherwise("replay")
    return requests.join(known, ["key", "operation"], "left").withColumn("decision", decision).drop("first_hash", "state")


def recovery(actual: Column, before: Column, after: Column) -> Column:
    """What recovery does with a file of a committed manifest."""
    return F.when(actual == after, "skip").when(actual == before, "roll_forward").otherwise("conflict")


def latency(log: DataFrame, q: float = 0.95) -> DataFrame:
    return log.groupBy("operation").agg(F.count("*").alias("n"), F.round(F.percentile("elapsed", F.lit(q)), 6).alias("p95"))
