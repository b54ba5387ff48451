"""Vector codes: product quantization by integer k-means, with Hamerly's bounds.

A component x becomes the integer floor(4096 x), a vector is cut into equal consecutive parts, and each part position has a codebook.
Beside its code, each part keeps two bounds between rounds: an upper bound of the distance to its entry and a lower bound of the
distance to the second-nearest one.  When entries move, the upper bound grows by the way of its own entry and the
lower one shrinks by the longest way of any.  As long as upper < lower, strictly, the entry is the only nearest one, and the part
is not compared with the codebook; if it fails, the upper bound is first made exact, and only if it fails again, all entries are
scanned in integers, where ties go to the lower index.  Bounds are doubles, rounded away from each other, so they never decide a
tie or a near tie: the codes are those of plain rounds.

State (integers, codes and bounds) is a table, written once a round from the last one, so a lost executor costs
one round of its rows.  Sums of parts are integers, added up in the tasks first; only sums and codebooks (parts times entries) meet
in the driver and go to the tasks.

Edge cases: rows whose vector is null or has null or non-finite components are dropped.  With fewer rows than entries,
the codebooks are that much smaller.  Repeated ids are rows of their own (equal ids order by their integers); null ids come last.
Vectors of another length than the first, or a length that the parts don't divide, are an error, and so is a
component of 4,096 or more in size, for which squares may not fit.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6  # fixed by the contract
LARGEST = 4096.0  # components must be smaller in size
AWAY = 1e-12  # relative rounding of bounds
SLICE = 4096  # parts that are scanned together


def integers(vectors: DataFrame, vector: str, keep: tuple[str, ...], scale: int = SCALE) -> DataFrame:
    """The kept columns and x, the integers, of rows with a finite vector."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    fits = lambda x: F.when(F.abs(x) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error("a component is too large for integer codes"))
    return vectors.where(sound).select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.transform(v, lambda x: fits(x).cast("int")).alias("x"))


def matrix(column: pa.Array, rows: int, *shape: int, kind=None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if kind is None else flat.astype(kind)).reshape(rows, *shape)


def lists(values: np.ndarray) -> pa.Array:
    rows = len(values)
    flat = values.reshape(rows, -1)
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, p) and entries (k, p)."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (lower index on ties), and squared distances to it and to the second-nearest entry (infinite without one)."""
    code, near, next_ = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    for low in range(0, len(x), SLICE):
        d = squares(x[low : low + SLICE], entries)
        at = d.argmin(1)
        code[low : low + SLICE], near[low : low + SLICE] = at, d[np.arange(len(d)), at]
        if len(entries) > 1:
            next_[low : low + SLICE] = np.partition(d, 1, axis=1)[:, 1]
    return code, near, next_


def ways(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of (parts, entries, p) moved, rounded up."""
    return np.sqrt(((new - old) ** 2).sum(2).astype(np.float64)) * (1 + AWAY)


def assign(x: np.ndarray, books: np.ndarray, moved: np.ndarray | None, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """Codes, bounds and how many parts were scanned, for parts (n, parts, p); without old codes all are scanned."""
    n, parts = x.shape[:2]
    if code is None:
        code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts))
    else:
        upper = (upper + moved[np.arange(parts), code]) * (1 + AWAY)
        lower = lower - moved.max(1)
        lower -= np.abs(lower) * AWAY
    scanned = np.zeros(n, np.int32)
    for j in range(parts):
        open_ = np.flatnonzero(~(upper[:, j] < lower[:, j]))
        if not len(open_):
            continue
        own = ((x[open_, j] - books[j][code[open_, j]]) ** 2).sum(1).astype(np.float64)
        upper[open_, j] = np.sqrt(own) * (1 + AWAY)
        open_ = open_[~(upper[open_, j] < lower[open_, j])]
        found, near, next_ = scan(x[open_, j], books[j])
        code[open_, j], upper[open_, j], lower[open_, j] = found, np.sqrt(near) * (1 + AWAY), np.sqrt(next_) * (1 - AWAY)
        scanned[open_] += 1
    return code, upper, lower, scanned


def _pass(books: np.ndarray, moved: np.ndarray | None, keep: int):
    """One assignment of all parts, from the state (kept columns, x, code, upper, lower) to the next state."""
    parts = len(books)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = matrix(batch.column(keep), n, parts, books.shape[2], kind=np.int64)
            old = (None, None, None) if moved is None else (matrix(batch.column(keep + 1), n, parts, kind=np.int64), matrix(batch.column(keep + 2), n, parts), matrix(batch.column(keep + 3), n, parts))
            code, upper, lower, scanned = assign(x, books, moved, *old)
            yield pa.RecordBatch.from_arrays([*batch.columns[: keep + 1], lists(code.astype(np.int32)), lists(upper), lists(lower), pa.array(scanned)], names=[*batch.schema.names[: keep + 1], "code", "upper", "lower", "scanned"])

    return run


def _sums(parts: int, entries: int, width: int, keep: int):
    """Sums and numbers of the parts of each entry, a row for each entry that a batch uses."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x, code = matrix(batch.column(keep), n, parts, width, kind=np.int64), matrix(batch.column(keep + 1), n, parts)
            slot = (np.arange(parts) * entries + code).ravel()
            total = np.zeros((parts * entries, width), np.int64)
            np.add.at(total, slot, x.reshape(-1, width))
            used = np.unique(slot)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.bincount(slot, minlength=parts * entries)[used]), lists(total[used])], names=["slot", "n", "total"])

    return run


def moved_books(state: DataFrame, books: np.ndarray, keep: int) -> np.ndarray:
    """Entries at floor(sum / count) of their parts; unused ones stay."""
    parts, entries, width = books.shape
    part = state.mapInArrow(_sums(parts, entries, width, keep), "slot long, n long, total array<long>")
    new = books.copy()
    for r in part.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")).collect():  # at most a row an entry
        new[divmod(r["slot"], entries)] = np.array(r["total"], np.int64) // r["n"]
    return new


def quantize(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(rows, books, scans): the key and the kept columns with code (an index a part) and error of each sound row, the
    codebooks (part, entry, position), and how many parts each assignment scanned."""
    scratch = Scratch(vectors.sparkSession, "codes")
    columns = [key, *keep]
    data = scratch.table(integers(vectors, vector, tuple(columns), scale), "integers")
    first = data.orderBy(F.col("k0").asc_nulls_last(), "x").limit(entries).select("x").collect()
    kept = [f"k{i} {t}" for i, t in enumerate(dict(data.dtypes)[f"k{i}"] for i in range(len(columns)))]
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(columns)]
    if not first:
        return data.select(*names, F.lit(None).cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64), []
    size = len(first[0]["x"])
    shapes = data.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if tuple(shapes) != (size, size) or size % parts:
        raise ValueError(f"vectors must have one length that {parts} divides, not {shapes[0]} to {shapes[1]}")
    width, n = size // parts, len(columns)
    books = np.array([r["x"] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    schema = ", ".join([*kept, "x array<int>", "code array<int>", "upper array<double>", "lower array<double>", "scanned int"])
    state = scratch.table(data.mapInArrow(_pass(books, None, n), schema), "state0")
    scratch.drop("integers")
    scans = [state.agg(F.sum("scanned")).first()[0]]
    for i in range(1, rounds + 1):
        old, books = books, moved_books(state, books, n)
        state = scratch.table(state.mapInArrow(_pass(books, ways(old, books), n), schema), f"state{i}")
        scratch.drop(f"state{i - 1}")
        scans.append(state.agg(F.sum("scanned")).first()[0])
    return state.mapInArrow(_errors(books, n), ", ".join([*kept, "code array<int>", "error long"])).select(*names, "code", "error"), books, scans


def _errors(books: np.ndarray, keep: int):
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x, code = matrix(batch.column(keep), n, parts, width, kind=np.int64), matrix(batch.column(keep + 1), n, parts)
            error = ((x - books[np.arange(parts), code]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], batch.column(keep + 1), pa.array(error)], names=[*batch.schema.names[:keep], "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir) -> DataFrame:
    rows, books, _ = quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=("label",))
    rows = Scratch(spark, "codes").table(rows, "errors")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    hexed = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """All rounds in full, without bounds."""
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) AS r(part)),
c0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))"""
    for i in range(ROUNDS + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT vec_id, part, min({ENTRIES} * list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c{i}.x[i]) * (p.x[i] - c{i}.x[i])))::BIGINT + entry) AS best FROM p JOIN c{i} USING (part) GROUP BY ALL)"""
        if i < ROUNDS:
            sql += f""",
s{i} AS (SELECT part, entry, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best % {ENTRIES} AS entry, unnest(x) AS y, unnest(range(len(x))) AS pos FROM p JOIN a{i} USING (vec_id, part)) GROUP BY ALL),
m{i} AS (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY pos) AS x FROM s{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (part, entry))"""
    return sql + f""",
e AS (SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id) CROSS JOIN h"""


OP13_SQL = _rounds_sql()
