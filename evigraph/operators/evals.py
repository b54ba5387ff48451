"""Retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per query: reciprocal rank, recall at 5 and 10, nDCG at 10, from (qid, unit_id, rank) and (qid, unit_id)."""
    gold = relevant.select("qid", "unit_id").distinct()
    sizes = gold.groupBy("qid").agg(F.count("*").alias("n"))
    hits = ranked.join(gold, ["qid", "unit_id"]).groupBy("qid").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("h5"), F.count_if(F.col("rank") <= 10).alias("h10"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(1 + F.col("rank"))).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(1 + i))
    joined = sizes.join(hits, "qid", "left")
    value = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return joined.select("qid", value(1 / F.col("first"), "mrr"), value(F.col("h5") / F.col("n"), "recall_5"), value(F.col("h10") / F.col("n"), "recall_10"), value(F.col("dcg") / ideal, "ndcg_10"))


def classification(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    p, t = F.col(predicted), F.col(truth)
    n = lambda c: F.count_if(c)
    return rows.agg(F.count("*").alias("n"), F.round(n(p & t) / n(p), 6).alias("precision"), F.round(n(p & t) / n(t), 6).alias("recall"), F.round(n(p == t) / F.count("*"), 6).alias("accuracy"), F.every(p == t).alias("all_right"))


def validity_gate(verified: DataFrame, *by: str) -> DataFrame:
    """Counts of evidence (status) that is valid, and passes: the gate asks for all of it."""
    ok = F.col("status").isin("exact", "repaired")
    return verified.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.every(ok).alias("passes"))
