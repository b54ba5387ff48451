import hashlib
import random

import duckdb
import numpy as np
import pytest

from evigraph.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x string, k0 string, slot long"


def saved(spark, tmp_path, vectors, ids=None, labels=None):
    """A table with extra columns whose names clash with internal ones."""
    n = len(vectors)
    rows = [(i, v, k, "c", "x", "k", 1) for i, v, k in zip(ids or range(n), vectors, labels or [0] * n, strict=True)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return spark.read.parquet(str(tmp_path / "embeddings.parquet"))


def plain(vectors, parts=8, entries=16, rounds=6):
    """Rounds in full, over vectors in the order of their ids."""
    x = np.floor(4096 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((x[:, j, None] - books[j][None]) ** 2).sum(2) for j in range(parts)], 1)
    for _ in range(rounds):
        code = near().argmin(2)
        for j in range(parts):
            for k in set(code[:, j].tolist()):
                mine = x[code[:, j] == k, j]
                books[j, k] = mine.sum(0) // len(mine)
    d = near()
    return d.argmin(2), d.min(2).sum(1), books


def vectors_of(seed, n, dims=16, close=False):
    rng = random.Random(seed)
    centres = [[rng.choice((-1, 1)) * rng.random() for _ in range(dims)] for _ in range(20)]
    grid = lambda x: round(x * 8) / 8 if close else x  # noqa: E731  many ties
    return [[grid(c + rng.gauss(0, 0.05)) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("close", [False, True])
def test_codes_match_rounds_in_full(spark, tmp_path, close):
    vectors = vectors_of(3, 300, close=close)
    vectors += vectors[:40]
    want, error, books = plain(vectors)
    rows, got, scans = vector_codes.quantize(saved(spark, tmp_path, vectors), keep=("label", "x"))
    found = {r["vec_id"]: (r["code"], r["error"], r["x"]) for r in rows.collect()}
    assert found == {i: (want[i].tolist(), error[i], "x") for i in range(len(vectors))}
    assert (got == books).all()
    assert scans[0] == 8 * len(vectors) and len(scans) == 7 and (close or scans[-1] < scans[0] / 2)


def test_query_matches_its_sql_with_unsound_rows_and_null_labels(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = vectors_of(4, 50) + [None, [None] + [0.5] * 15, [nan] * 16, [inf] + [0.0] * 15, [0.0] * 16, [-3.99] * 16]
    ids = random.Random(1).sample(range(1000), len(vectors))
    saved(spark, tmp_path, vectors, ids, [random.Random(i).choice((None, 1, 2)) for i in ids])
    got = vector_codes.op13_vector_codes(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(vector_codes.OP13_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall()) and len(rows) == 52


def test_small_and_empty_tables(spark, tmp_path):
    docs = saved(spark, tmp_path, [[1.0] * 8, [1.0] * 8, [2.0] * 8], ids=[5, 5, None])
    rows, books, _ = vector_codes.quantize(docs)
    assert sorted((str(r["vec_id"]), *r["code"]) for r in rows.collect()) == [("5", *[0] * 8), ("5", *[0] * 8), ("None", *[2] * 8)]
    assert books.shape == (8, 3, 1)
    rows, books, _ = vector_codes.quantize(docs.where("vec_id < 0"))
    assert rows.count() == 0 and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vector_codes.quantize(spark.createDataFrame([(1, [1.0] * 8), (2, [1.0] * 16)], "vec_id long, embedding array<float>"))
