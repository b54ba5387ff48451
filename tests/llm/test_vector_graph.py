import duckdb
import numpy as np
import pytest

from evigraph.llm import vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, shard string, id string"


def saved(spark, tmp_path, vectors, ids=None):
    """A table with extra columns whose names clash with internal ones."""
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "v", "s", "i") for i, v in zip(range(len(vectors)) if ids is None else ids, vectors, strict=True)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return spark.read.parquet(str(tmp_path / "embeddings.parquet"))


def copies(rng, centre, n, noise):
    return centre + rng.normal(size=(n, len(centre))) * noise * np.sqrt(centre @ centre / len(centre))


def by_hand(vectors, ids):
    x = vector_graph.unit(np.array(vectors, np.float32).astype(np.float64))
    near = x @ x.T >= 0.9
    a, b = np.nonzero(near)
    order = np.argsort(ids, kind="stable")
    back = np.argsort(order)
    root = vector_graph.lowest(len(x), back[a], back[b])
    return near.sum(1) - 1, np.array(ids)[order][root][back]


def mixed(seed=2, dims=32):
    """Random vectors, groups of some and of many copies, two crowds close to each other, a chain, and equal rows."""
    rng = np.random.default_rng(seed)
    plain = rng.normal(size=(400, dims))
    groups = [copies(rng, rng.normal(size=dims), n, 0.15) for n in (2, 3, 5, 40, 90)]
    crowd = rng.normal(size=dims)
    beside = crowd + rng.normal(size=dims) * 0.4
    chain = np.cumsum(np.concatenate((rng.normal(size=(1, dims)), rng.normal(size=(12, dims)) * 0.35)), 0)
    return np.concatenate((plain, *groups, copies(rng, crowd, 700, 0.1), copies(rng, beside, 300, 0.1), copies(rng, crowd, 60, 0.35), chain, plain[:3], plain[:1], 5 * plain[3:5]))


def test_links_and_components_match_brute_force_with_crowds_in_blocks(spark, tmp_path):
    vectors = mixed()
    ids = np.random.default_rng(3).permutation(5000)[: len(vectors)]
    rows, recall = vector_graph.near_vectors(saved(spark, tmp_path, vectors, ids.tolist()), shard=100)
    got = {r["vec_id"]: r for r in rows.collect()}
    links, component = by_hand(vectors, ids)
    assert len(got) == len(vectors)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * links.sum() and recall >= 0.9
    for i, n, c in zip(ids.tolist(), links, component, strict=True):
        assert got[i]["n_links"] <= n and got[i]["component_id"] >= c
    assert np.mean([got[i]["component_id"] == c for i, c in zip(ids.tolist(), component, strict=True)]) >= 0.98


def test_one_shard_finds_all(spark, tmp_path):
    vectors = mixed(4)
    rows, recall = vector_graph.near_vectors(saved(spark, tmp_path, vectors), shard=4000)
    links, component = by_hand(vectors, range(len(vectors)))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows.collect()} == {i: (n, c) for i, (n, c) in enumerate(zip(links, component, strict=True))}
    assert recall == 1.0


def test_query_matches_its_sql_with_unsound_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [*mixed(5)[380:560].tolist(), None, [None] * 32, [nan] * 32, [inf] * 32, [0.0] * 32, [1e38] * 32, [1e-38] * 32]
    saved(spark, tmp_path, vectors)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(vector_graph.OP12_SQL)
    got = vector_graph.op12_near_vectors(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("ids", [[7, 7, None, 3], [None, None, None, None]])
def test_repeated_and_null_ids_and_other_lengths(spark, tmp_path, ids):
    rows, _ = vector_graph.near_vectors(saved(spark, tmp_path, [[1, 0], [1, 0], [1, 0.1], [1, 0, 0]], ids))
    known = [i for i in ids[:3] if i is not None]
    want = sorted((str(i), 2, str(min(known) if known else None)) for i in ids[:3]) + [(str(ids[3]), 0, str(ids[3]))]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in rows.collect()) == sorted(want)


def test_empty_table(spark, tmp_path):
    rows, recall = vector_graph.near_vectors(saved(spark, tmp_path, [[1, 0]]).where("vec_id < 0"))
    assert rows.count() == 0 and recall is None
