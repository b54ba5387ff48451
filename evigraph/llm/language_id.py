"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character n-grams (1 to 3
letters, any other character as one blank).  Each language has several centroids
from spherical k-means; a text takes the language of the centroid with the
greatest cosine, and is rejected when even that cosine is below a distance limit.
Cosines grow with the length of a text, so the limit does too: it is learned from
prefixes of the training texts, as ``REJECT_FACTOR`` times the ``REJECT_QUANTILE`` of their cosines at
each length.  Other scripts and letters without the order of a learned language fall below it; related
languages (Italian next to Spanish) do not.

The model is fitted on a bounded sample: at most about ``max_fit_rows`` labelled
rows in all, as many from each language, chosen by a hash of id and text; equal rows count once.  Every row
is classified, over its whole text.  One task fits it; the driver gets the model, not the sample.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; very long texts are counted in pieces; without labelled rows all texts
are ``und``.  Repeated rows are classified alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm.common import documents, fresh, held_out, values

BINS = 8192
CENTROIDS = 3
MAX_FIT_ROWS = 3000
REJECT_QUANTILE, REJECT_FACTOR = 0.001, 0.8
PREFIXES = (8, 32, 128, 512, 2048)  # code points
MAX_PREFIX_ROWS = 750  # texts whose prefixes are read as well
PIECE = 1 << 18
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of the hashed n-grams of a text; empty without a letter."""
    counts = np.zeros(BINS, np.int64)
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), PIECE):
        part = codes[max(0, at - 2) : at + PIECE]
        c = np.where(letters()[part], part, np.uint32(0))
        old = min(at, 2)  # grams that end in these were counted with the piece before
        pair = c[1:] * np.uint32(0x85EBCA6B) + c[:-1] * np.uint32(0x9E3779B1)
        triple = pair[1:] * np.uint32(0xC2B2AE35) + c[:-2] * np.uint32(0x27D4EB2F)
        for gram, filled, skip in ((c * np.uint32(0x165667B1), c, old), (pair, c[1:] | c[:-1], max(0, old - 1)), (triple, c[2:] | c[1:-1] | c[:-2], 0)):
            gram = gram[skip:][filled[skip:] > 0]
            gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(gram >> np.uint32(19), minlength=BINS)
    bins = np.flatnonzero(counts)
    return bins, counts[bins]


def _weights(bins, counts, idf) -> np.ndarray:
    x = np.log1p(counts) * idf[bins]
    return x / max(np.sqrt(x @ x), 1e-12)


def sampled(docs: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame | None:
    """lang, doc_id, size, bins and counts of the sample's texts (size 0) and, for about ``MAX_PREFIX_ROWS`` of them, of their prefixes of ``PREFIXES`` code points; None without labelled rows."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, max_fit_rows // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))])
    most = int(min(1.0, MAX_PREFIX_ROWS / sum(min(n, each) for n in counts.values())) * (1 << 20))
    text = F.col("text").cast("string")
    lot = F.pmod(F.xxhash64(F.lit("lang"), "doc_id", text), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.where(lot < share[F.col("lang")]).select("lang", F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 20)) < most).alias("prefixes")).distinct()

    def run(batches):
        for batch in batches:
            for lang, doc_id, whole, prefixes in zip(*(values(c) for c in batch.columns), strict=True):
                cut = [(0, whole)] + [(n, whole[:n]) for n in PREFIXES if prefixes and whole and len(whole) >= n]
                found = [(n, *profile(t)) for n, t in cut]
                arrays = [pa.array([x[i].astype(kind) for x in found], pa.list_(pa.from_numpy_dtype(kind))) for i, kind in ((1, np.int16), (2, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([doc_id] * len(found), pa.int64()), pa.array([n for n, _ in cut], pa.int32()), *arrays], names=["lang", "doc_id", "size", "bins", "counts"])

    return chosen.mapInArrow(run, "lang string, doc_id long, size int, bins array<short>, counts array<int>")


def _ordered(batches) -> list[tuple[str, np.ndarray, np.ndarray, int]]:
    """(lang, bins, counts, size) of the sample's rows, in the same order however they came; views of the batches, which are not copied."""
    found = []
    for batch in batches:
        bins, counts = batch.column("bins"), batch.column("counts")
        found += [(lang, b, counts[i].values.to_numpy(), size, doc_id) for i, (lang, doc_id, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "size")), strict=True)) if len(b := bins[i].values.to_numpy())]
    return [x[:4] for x in sorted(found, key=lambda x: (x[0], x[4] is None, x[4] or 0, x[3], x[1].tobytes(), x[2].tobytes()))]


def training_profiles(docs: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> list[tuple[str, np.ndarray, np.ndarray, int]]:
    """The rows of ``sampled``, collected."""
    rows = sampled(docs, max_fit_rows)
    return [] if rows is None else _ordered(rows.toArrow().to_batches())


def learned(docs: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> dict | None:
    """What ``fit`` makes of the sample, fitted in one task: the sample is bounded, and the driver gets the model only."""
    rows = sampled(docs, max_fit_rows)
    if rows is None:
        return None

    def run(batches):
        model = fit(_ordered(batches))
        if model:
            parts = [("idf", model["idf"]), *zip(model["langs"], model["centroids"], strict=True), *(("limits", x) for x in model["limits"])]
            for k, (name, x) in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([name]), pa.array([x], pa.list_(pa.float64()))], names=["k", "name", "x"])

    found = rows.repartition(1).mapInArrow(run, "k long, name string, x array<double>").toArrow().sort_by("k")
    if not len(found):
        return None
    names, x = found["name"].to_pylist(), [v.values.to_numpy() for v in found["x"]]
    return {"idf": x[0], "langs": names[1:-2], "centroids": np.array(x[1:-2]), "limits": (x[-2], x[-1])}


def fit(profiles: list[tuple[str, np.ndarray, np.ndarray, int]], centroids: int = CENTROIDS) -> dict | None:
    """The model: idf, langs (one per centroid), centroids, and limits: (log2 of the number of different n-grams, which repetition does not raise; least cosine)."""
    rows = [(lang, bins, counts) for lang, bins, counts, size in profiles if not size]
    if not rows:
        return None
    df = np.zeros(BINS)
    for _, bins, _ in rows:
        df[bins] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    langs, centres = [], []
    for lang in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == lang]
        x = np.zeros((len(own), BINS), np.float32)
        for i, (_, bins, counts) in enumerate(own):
            x[i, bins] = _weights(bins, counts, idf)
        c = [x.mean(0)]
        while len(c) < min(centroids, len(own)):  # the row farthest from all centroids so far
            c.append(x[np.argmin(np.max(x @ np.array(c).T, axis=1))])
        c = np.array(c)
        for _ in range(8):
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            near = np.argmax(x @ c.T, axis=1)
            c = np.array([np.sum(x, 0, where=(near == k)[:, None]) if np.any(near == k) else c[k] for k in range(len(c))])  # without copies of the rows
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        langs += [lang] * len(c)
        centres.append(c)
        del x  # before the next language's
    model = {"idf": idf, "langs": langs, "centroids": np.concatenate(centres).astype(np.float64)}
    points = []
    for size in PREFIXES:
        found = [(np.log2(len(bins)), max(c for c, of in zip(model["centroids"][:, bins] @ _weights(bins, counts, idf), langs, strict=True) if of == lang)) for lang, bins, counts, n in profiles if n == size]
        if found:
            logs, cosines = np.array(found).T
            points.append((float(np.median(logs)), REJECT_FACTOR * float(np.quantile(cosines, REJECT_QUANTILE))))
    points = points or [(0.0, 0.0)]  # only texts of a few letters: nothing is known of longer ones
    model["limits"] = tuple(np.array(x) for x in zip(*points, strict=True))
    return model


def predict(text: str | None, model: dict | None) -> tuple[str, float, bool]:
    """(language, cosine, rejected); the language is the nearest one also when rejected."""
    bins, counts = profile(text)
    if not len(bins) or model is None:
        return UNDETERMINED, 0.0, True
    cosines = model["centroids"][:, bins] @ _weights(bins, counts, model["idf"])
    i = int(np.argmax(cosines))
    score = min(1.0, max(0.0, float(cosines[i])))
    return model["langs"][i], score, score < float(np.interp(np.log2(len(bins)), *model["limits"]))


def identify(docs: DataFrame, model: dict | None, keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns in ``keep`` and, under ``names``, language, cosine and rejection of every row."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BINS times centroids

    twice = "text" not in keep or docs.schema["text"].dataType != T.StringType()  # a kept string isn't sent twice
    at = len(keep) if twice else keep.index("text")

    def run(batches):
        for batch in batches:
            found = [predict(t, shared.value) for t in values(batch.column(at))]
            arrays = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *names])

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col("text").cast("string").alias(fresh(docs, "__text"))] * twice).mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) that the classifier doesn't reject."""
    names = tuple(fresh(docs, f"__{n}") for n in ("lang", "score", "rejected"))
    return identify(docs, learned(docs), docs.columns, names).where(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_language_id(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learned(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
