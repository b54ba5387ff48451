"""Vector functions: array expressions, and exact k-nearest-neighbour search in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def finite(v) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("float")))


def nonzero(v) -> Column:
    return F.exists(v, lambda x: x != 0)


def validity(v, dimensions: int) -> Column:
    """Why a vector can't be indexed, or null."""
    return F.when(v.isNull(), "missing").when(F.size(v) != dimensions, "dimensions").when(~finite(v), "not_finite").when(~nonzero(v), "zero")


QUERY_BLOCK = 2048  # queries that are compared together


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(qid, id, score, rank): exact nearest neighbours of each query (qid, qv) among vectors (id, v).

    Queries go to all tasks in blocks of ``QUERY_BLOCK``; vectors are read in place, without a shuffle, and each batch of
    them is one matrix product with the block, of which only the best k of a query (and ties) leave the task.
    A query is not its own neighbour.  Scores are rounded to six digits, ties go to the lower id.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    near = None
    for i in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        part = _knn_block(vectors, some, k, metric)
        near = part if near is None else near.unionByName(part)
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(order, "id")).cast("long")).where(F.col("rank") <= k)


CELL = 4096  # vectors, and queries, of a cell


def knn_within(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(qid, id, score): the ``k`` nearest by cosine among the vectors (by, id, v) of a query's (by, qid, qv) own group, of at least this score.

    A group is cut into cells of about ``CELL`` vectors and ``CELL`` queries; each cell is one matrix product in a task of its own, from which
    only the best ``k`` of a query (and ties) leave.  So a group of any size is spread, and no query meets another group.
    """
    cut = lambda df, n: df.groupBy(F.col("by").alias("of")).agg(F.ceil(F.count("*") / CELL).alias(n))
    sizes = cut(vectors, "cells").join(cut(queries, "askers").withColumnRenamed("of", "o"), F.col("of").eqNullSafe(F.col("o"))).select("of", "cells", "askers")
    here = lambda df, *cols: df.join(sizes, F.col("by").eqNullSafe(F.col("of"))).select(F.col("of").alias("of"), *cols)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    v = here(vectors, F.col("id").cast("long").alias("id"), "v", own("id", "cells").alias("cell"), every("askers").alias("asker"))
    q = here(queries, F.col("qid").cast("long").alias("qid"), "qv", own("qid", "askers").alias("by_asker"), every("cells").alias("by_cell")).withColumnRenamed("of", "by")

    def run(a, b):
        ids, qids = a["id"].to_numpy(), b["qid"].to_numpy()
        x, y = (c.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(n), -1) for c, n in ((a["v"], ids), (b["qv"], qids)))
        if not len(ids) or not len(qids):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        s = np.round((x @ y.T) / np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1))), 6)
        s[ids[:, None] == qids[None, :]] = -np.inf
        edge = np.maximum(least, np.partition(s, -k, axis=0)[-k] if len(s) > k else -np.inf)
        row, col = np.nonzero((s >= edge) & np.isfinite(s))
        return pa.table({"qid": qids[col], "id": ids[row], "score": s[row, col]})

    near = v.groupBy("of", "cell", "asker").cogroup(q.groupBy("by", "by_cell", "by_asker")).applyInArrow(run, "qid long, id long, score double")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).drop("rank")


def _knn_block(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    rows = queries.select(F.col("qid").cast("long").alias("qid"), "qv").collect()
    schema = "qid long, id long, score double"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), np.array([r.qv for r in rows], np.float64)))

    def run(batches):
        qi, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            b = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
            if metric == "cosine":
                s = (b @ q.T) / np.sqrt(np.outer((b * b).sum(1), (q * q).sum(1)))
            else:
                s = -np.sqrt(np.maximum((b * b).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * b @ q.T, 0))
            s = np.round(s, 6)
            s[ids[:, None] == qi[None, :]] = -np.inf
            least = np.partition(s, -k, axis=0)[-k] if len(s) > k else -np.inf
            row, col = np.nonzero((s >= least) & np.isfinite(s))
            got = s[row, col]
            yield pa.RecordBatch.from_arrays([pa.array(qi[col]), pa.array(ids[row]), pa.array(np.abs(got) if metric == "l2" else got)], names=["qid", "id", "score"])

    return vectors.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, schema)
