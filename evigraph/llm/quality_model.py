"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed words and character
trigrams, and of one vector for a word that repeats the word before it; a softmax
layer gives the probability of label 1.  Texts of few features are drawn towards
the share of label 1 among the training labels, which weighs ``PRIOR_FEATURES``.  Vectors and layer
are trained by stochastic gradient descent in numpy on a bounded sample of at
most about ``max_fit_rows`` labelled rows, chosen by a hash of the id.  Scoring
folds each vector into one number per bucket, which gives the same result.

Edge cases: null and empty texts have the learned prior as their score; white space alone counts as empty;
without labelled rows every text scores 0.5; very long texts go through in
pieces cut at white space.  Rows with a null label are not used.  Repeated rows
score alike, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import documents, fresh, held_out, values
from evigraph.llm.winnowing import _powers

BUCKETS = 1 << 16
DIM = 8
MAX_FIT_ROWS = 3000
EPOCHS = 12
RATE = 0.5
PRIOR_FEATURES = 40
AGAIN = 0  # bucket of a word equal to the one before
THRESHOLD = 0.7
PIECE = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def pieces(data: bytes):
    """The bytes in pieces of about PIECE, cut at white space where there is some."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield data[at:end]
        at = end


def features(text: str | None) -> np.ndarray:
    """Buckets of all words and character trigrams (bytes), repeats included."""
    found = []
    for piece in pieces((text or "").encode("utf-8", "surrogatepass")):
        b = np.frombuffer(piece, np.uint8)
        inside = np.flatnonzero(np.diff(np.concatenate(([True], _SPACES[b], [True])).astype(np.int8)))
        starts, ends = inside[::2], inside[1::2]
        if not len(starts):
            continue
        up, down = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        words = (sums[ends] - sums[starts]) * down[starts]
        again = np.count_nonzero((words[1:] == words[:-1]) & (ends[1:] - starts[1:] == ends[:-1] - starts[:-1]))
        found.append(np.full(again, AGAIN, np.int32))
        words = ((words ^ (words >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)
        found.append(words.astype(np.int32))
        c = b.astype(np.uint32)
        grams = (c[2:] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[:-2] * np.uint32(0xC2B2AE3D))
        grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        found.append(grams.astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of a bounded sample; each class gives half of it where it can."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for y, n in sorted(counts.items()) for x in (y, min(1.0, max_fit_rows / 2 / n))])
    lot = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = usable.where(lot < share[F.col("quality")])  # max_fit_rows rows of two numbers, so the side to broadcast is bounded
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text an id, so that a repeated id brings no more rows

    def run(batches):
        for batch in batches:
            found = [np.unique(features(t), return_counts=True) for t in values(batch.column(2))]
            arrays = [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *arrays], names=["doc_id", "quality", "bins", "counts"])

    rows = texts.mapInArrow(run, "doc_id long, quality int, bins array<int>, counts array<int>").toArrow()
    ids, y = rows["doc_id"].to_pylist(), rows["quality"].to_pylist()
    bins, counts = rows["bins"].combine_chunks(), rows["counts"].combine_chunks()
    return [(y[i], bins[i].values.to_numpy(), counts[i].values.to_numpy()) for i in sorted(range(len(ids)), key=lambda i: ids[i]) if len(bins[i])]


def label_share(labels: DataFrame) -> float:
    """Share of label 1 among the labels that may be learned from; 0.5 without any."""
    got = labels.where(F.col("quality").isin(0, 1) & ~held_out()).agg(F.avg("quality").alias("p")).first()["p"]
    return 0.5 if got is None else float(got)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float = 0.5, seed: int = 7) -> dict:
    """The model: ``table`` (number per bucket), ``bias`` and ``prior`` (log odds of label 1).

    With z = mean(table[features]) + bias, the score is the sigmoid of z, which
    n features weigh by n, and the prior, which weighs ``PRIOR_FEATURES``.
    """
    share = min(0.99, max(0.01, share))
    prior = math.log(share / (1 - share))
    if len({r[0] for r in rows}) < 2:
        return {"table": np.zeros(BUCKETS, np.float32), "bias": 0.0 if not rows else math.copysign(4.0, rows[0][0] - 0.5), "prior": prior}
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    scaled = [(y, bins, (counts / counts.sum()).astype(np.float32)) for y, bins, counts in rows]
    steps, step = EPOCHS * len(scaled), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(scaled)):
            y, bins, share = scaled[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ vectors[bins]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            vectors[bins] -= (rate * len(bins) ** 0.5) * share[:, None] * back[None, :]
    return {"table": (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0]), "prior": prior}


def score(text: str | None, model: dict) -> float:
    found = features(text)
    z = float(model["table"][found].mean(dtype=np.float64)) + model["bias"] if len(found) else 0.0  # an empty text is told by the prior alone
    z = (len(found) * z + PRIOR_FEATURES * model["prior"]) / (len(found) + PRIOR_FEATURES)
    return 1 / (1 + math.exp(-min(50.0, max(-50.0, z))))


def classify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` and score of every row, over its whole text."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket

    def run(batches):
        for batch in batches:
            scores = pa.array([score(t, shared.value) for t in values(batch.column(len(keep)))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(fresh(docs, "__text"))).mapInArrow(run, f"{schema}, score double")


def op4_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(training_rows(docs, labels), label_share(labels))
    scored = classify(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
