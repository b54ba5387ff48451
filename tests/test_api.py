import pytest

from evigraph import api
from evigraph.functions import text as T
from evigraph.operators import config, curate, evidence, records, search
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def ws(spark):
    make = spark.createDataFrame
    units = make([("node:1", "node", "Alder", ["Tree of rivers"], "alder wood by the river", ["a"], "active"), ("node:2", "node", "Birch", [], "birch wood on the hill", ["b"], "active"), ("claim:9", "claim", "Old", [], "alder alder", ["a"], "retracted")],
                 "unit_id string, record_type string, title string, aliases array<string>, body string, tags array<string>, lifecycle_status string")
    tables = {
        "units": units,
        "nodes": make([("n1", "Alder", "Tree", ["a"], "active"), ("n2", "Birch", "Tree", ["b"], "retracted")], "id string, name string, node_type string, tags array<string>, lifecycle_status string"),
        "aliases": make([("n1", "Tree of Rivers")], "node_id string, alias string"),
        "relations": make([("r1", "n1", "near", "n2", False, "supported", "active")], "id string, src string, predicate string, dst string, directed boolean, evidence_status string, lifecycle_status string"),
        "evidence": make([("e1", "s1", "claim", "c1")], "id string, source_id string, kind string, assertion_id string"),
        "sources": make([("s1", None), ("s2", "2026")], "id string, removed_at string"),
        "syntheses": make([("y1", ["e1"], "2026-01-01"), ("y2", ["e9"], "2026-01-02")], "id string, evidence_ids array<string>, updated_at string"),
        "runs": make([("u1", "failed", 1, True, "2026")], "id string, status string, attempts_left int, retryable boolean, started_at string"),
    }
    return api.Workspace(spark, tables, 3)


def test_lookups_and_lists(ws):
    assert [ws.call("node.get", given=g).first()["id"] for g in ("n1", " ALDER", "tree of  rivers")] == ["n1"] * 3
    assert [r["id"] for r in ws.call("node.list").collect()] == ["n1"]
    assert ws.call("evidence.get", id="zz").first()["outcome"] == "NOT_FOUND" and ws.call("evidence.get", id="e1").first()["outcome"] == "found"
    assert [r["id"] for r in ws.call("source.list").collect()] == ["s1"] and ws.call("source.list", history=True).count() == 2
    assert [(r["kind"], r["id"]) for r in ws.call("source.impact", id="s1").collect()] == [("claim", "c1"), ("synthesis", "y1")]
    assert [r["id"] for r in ws.call("synthesis.list").collect()] == ["y2", "y1"]
    assert ws.call("run.get", id="u1").first()["allowed_actions"] == ["resume"]
    assert {r["node"] for r in ws.call("graph.neighbors", node="n2").collect()} == {"n1", "n2"}
    assert ws.call("graph.path", source="n1", target="n2").first()["nodes"] == ["n1", "n2"]
    with pytest.raises(LookupError):
        ws.call("claim.get", id="c1")


def test_search_and_ask(ws):
    got = ws.call("knowledge.search", query="alder").collect()
    assert [r["unit_id"] for r in got][0] == "node:1" and got[0]["channels"] == ["word", "trigram"] and "claim:9" not in {r["unit_id"] for r in got}
    assert ws.call("knowledge.search", query="node:2").first()["tier"] == 1
    bundle, left = ws.call("knowledge.ask", query="wood", budget=6)
    assert bundle.count() == 1 and {r["reason"] for r in left.collect()} == {"budget"}


def test_registry(ws):
    rows = {r["operation"]: r for r in ws.call("schema.list").collect()}
    assert rows["source.remove"]["dry_run"] and rows["knowledge.ask"]["effect"] == "runtime-write" and rows["graph.path"]["inputs"][:2] == ["source", "target"]
    assert ws.call("capabilities") == {"word_fts": True, "trigram_fts": True, "vector": False, "graph_paths": True}
    assert {r["table"]: r["rows"] for r in ws.call("status").collect()}["nodes"] == 2


def test_env_lines(spark):
    lines = ["A=1", "export B = 'x # y' # z", "# C=2", "D", 'E="q"', "F= v # note", "G=", "H=`b`", ""]
    got = {r["key"]: r["value"] for r in config.env_entries(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {"A": "1", "B": "x # y", "E": "q", "F": "v", "G": "", "H": "b"}


def test_channel_keeps_the_best_of_a_unit_that_comes_twice(spark):
    hits = spark.createDataFrame([(1, "u", 0.2), (1, "u", 0.9), (1, "v", 0.5)], "qid long, unit_id string, score double")
    assert [(r["unit_id"], r["rank"]) for r in search.rank_candidates(hits).orderBy("rank").collect()] == [("u", 1), ("v", 2)]
    with pytest.raises(ValueError):
        search.rank_candidates(hits, 501)


def test_patterns_cursors_and_ids(spark):
    assert [T.pattern_error(p) for p in ("a+b", "(a+)+", "(", "x" * 300)] == [None, "nested_repeat", "invalid", "too_long"]
    row = spark.range(1).select(T.cursor_parts(F.lit("no cursor!"), "a int").alias("bad"), T.id_time(F.lit("run_" + "0" * 8 + "10" + "0" * 16)).cast("double").alias("at")).first()
    assert row["bad"] is None and row["at"] == 0.032


def test_review_modes(spark):
    items = spark.createDataFrame([(1, "accepted", True), (1, "pending", True), (2, "accepted", False)], "proposal_id long, decision string, valid boolean")
    may = lambda mode: {r["proposal_id"]: r["may_apply"] for r in curate.review_summary(items, mode).collect()}
    assert may("strict") == {1: False, 2: True} and may("relaxed") == {1: True, 2: False}


def test_bundle_rules(spark):
    rows = [(1, "a", 1, "s", "r1", 0, 10, 5, True, None), (1, "b", 2, "s", "r1", 2, 8, 5, True, None), (1, "c", 3, "s", "r2", 0, 9, 5, True, None), (1, "d", 4, "t", "r3", 0, 9, 50, True, "con"), (1, "e", 5, "t", "r4", 0, 9, 5, False, None), (1, "f", 6, "t", "r5", 0, 9, 5, True, None)]
    hits = spark.createDataFrame(rows, "qid long, unit_id string, rank long, source string, revision string, s long, e long, tokens long, available boolean, side string")
    got, left = evidence.bundle(hits, size=4, share=0.25, budget=20)
    assert [r["unit_id"] for r in got.orderBy("position").collect()] == ["a", "f", "c"] or [r["unit_id"] for r in got.orderBy("position").collect()] == ["a", "c", "f"]
    assert {(r["unit_id"], r["reason"]) for r in left.collect()} == {("b", "repeated"), ("e", "unavailable"), ("d", "budget")}


def test_units_of_kinds(spark):
    rows = spark.createDataFrame([(1, "A", None)], "id long, name string, body string")
    unit = records.unit("node", rows, "id", F.col("name"), F.col("body")).first()
    assert unit["unit_id"] == "node:1" and unit["body"] == "" and tuple(unit.asDict()) == records.UNIT
    with pytest.raises(ValueError):
        records.unit("nothing", rows, "id", F.col("name"), F.col("body"))
