import datetime as dt

import pytest
from pyspark.sql import functions as F

from evigraph.functions import vector as V
from evigraph.operators import checks, curate, evidence, lineage, proposals
from evigraph.sources.workspace import Versions
from evigraph.streaming import watch


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_run_moves_over_several_batches(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "run_id long, event_id long, ts timestamp, status string"
    batches = [[(1, 1, at(1), "queued"), (1, 3, at(3), "running"), (1, 2, at(2), "succeeded"), (2, 4, at(1), "running")], [(1, 5, at(2), "failed"), (1, 6, at(4), "failed"), (1, 7, at(4), "queued"), (2, 8, at(9), "queued")]]
    got = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = watch.run_moves(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
        got = rows(watch.replayed(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")), "event_id", "was", "outcome")
    want = [(1, None, "moved"), (2, "queued", "refused"), (3, "queued", "moved"), (4, None, "refused"), (5, "running", "late"), (6, "running", "moved"), (7, "failed", "moved"), (8, None, "moved")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_debounced_bursts_are_told_once(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    for part in ([("a", at(1)), ("a", at(2)), ("b", at(1)), ("a", at(10))], [("b", at(30))], [("b", at(50))]):
        spark.createDataFrame(part, "path string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = watch.debounced(spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "events")), "path", "5 seconds")
        got = rows(watch.replayed(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")), "path", "last", "n")
    assert got == [("a", at(2), 2), ("a", at(10), 1), ("b", at(1), 1), ("b", at(30), 1)]


def test_hash_trees_name_the_rows_that_differ(spark):
    a = spark.range(3000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    b = a.where("k <> 7").unionByName(a.where("k = 8")).withColumn("v", F.when(F.col("k") == 9, "y").otherwise(F.col("v")))
    assert rows(checks.tree_differences(a, b, "k", "v")) == [(7, "missing", 1), (8, "extra", 1), (9, "extra", 1), (9, "missing", 1)]
    assert rows(checks.tree_differences(a, a.repartition(7), "k", "v")) == []
    assert 1 <= len(checks.unequal_leaves(checks.hash_tree(a, "k", "v"), checks.hash_tree(b, "k", "v"))) <= 3
    assert rows(checks.tree_differences(a.where("k < 2"), a.where("k < 0"), "k", "v")) == [(0, "missing", 1), (1, "missing", 1)]


def test_duplicates_of_one_subject_in_several_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 5)
    vector = lambda i: [float(i % 7), 1.0, float(i % 3)]
    claims = [("s" if i % 3 else None, i, vector(i)) for i in range(60)]
    known = spark.createDataFrame(claims, "subject string, id long, v array<double>")
    got = rows(curate.possible_duplicates(known.where("id < 20"), known, 0.999, 4))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = []
    for subject, i, v in claims[:20]:
        near = sorted((-round(cos(v, w), 6), j) for other, j, w in claims if other == subject and j != i)
        want += [(i, j, -s) for s, j in near[:4] if -s >= 0.999]
    assert got == sorted(want) and len(want) > 10


def test_impact_hands_reasons_on_and_pages_are_pinned(spark):
    revisions = spark.createDataFrame([("s", "r1", "r2", False), ("s", "r2", "r2", False), ("t", "r3", "r3", True)], "source_id string, revision_id string, head string, removed boolean")
    held = spark.createDataFrame([("e1", "r1"), ("e2", "r2"), ("e3", "r3"), ("e4", "other")], "evidence_id string, revision_id string")
    said = spark.createDataFrame([("claim", "c1", "e1"), ("claim", "c1", "e2"), ("relation", "l1", "e3"), ("claim", "c9", "e4")], "kind string, id string, evidence_id string")
    written = spark.createDataFrame([("y1", None, "claim", "c1"), ("y2", "e3", None, None), ("y2", None, "relation", "l1")], "id string, evidence_id string, assertion_kind string, assertion_id string")
    items, dependencies = lineage.impact_items(revisions, held, said, written)
    behind = ["referenced", "source_revision_behind"]
    assert rows(items) == [
        ("s", "claim", "c1", 2, behind), ("s", "evidence", "e1", 1, ["source_revision_behind"]), ("s", "evidence", "e2", 1, ["referenced"]), ("s", "synthesis", "y1", 1, behind),
        ("t", "evidence", "e3", 1, ["source_removed"]), ("t", "relation", "l1", 1, ["source_removed"]), ("t", "synthesis", "y2", 2, ["source_removed"]),
    ]
    assert ("t", "synthesis", "y2", "relation", "l1") in rows(dependencies)
    assert rows(lineage.impact_page(items.where("source_id = 's'"), 3, 2, ("claim", "c1"), 3), "kind", "id", "position", "generation") == [("evidence", "e1", 1, 3), ("evidence", "e2", 2, 3)]
    with pytest.raises(ValueError, match="CURSOR_STALE"):
        lineage.impact_page(items, 3, 2, None, 2)


def test_bundle_limits_and_context(spark):
    hits = spark.createDataFrame([(1, "claim", "a", 1), (1, "synthesis", "y", 2), (1, "chunk", "k", 3), (1, "claim", "d", 4)], "qid long, kind string, id string, rank long")
    support = spark.createDataFrame([("claim", x, "e" + x) for x in "abcd"], "kind string, id string, evidence_id string")
    cites = spark.createDataFrame([("y", "claim", "b"), ("y", "evidence", "ec")], "id string, kind string, member string")
    members = spark.createDataFrame([("g", "pro", "claim", "d"), ("g", "con", "claim", "lost")], "group string, side string, kind string, id string")
    pieces = spark.createDataFrame([("ea", "s1", "r1", 0, 10, 5, True, True), ("eb", "s2", "r2", 0, 10, 100, True, True), ("ec", "s3", "r3", 0, 10, 5, True, False), ("ed", "s1", "r1", 2, 8, 5, True, True)], "evidence_id string, source string, revision string, s long, e long, tokens long, available boolean, allowed boolean")
    bundle, omitted = evidence.assemble(hits, support, cites, members, pieces, sources=2, most=3, tokens=50)
    assert rows(bundle, "evidence_id", "position") == [("ea", 2), ("ed", 1)]  # a side of a conflict comes first and is kept though it lies in a better span
    assert rows(omitted, "item", "reason") == [("chunk:k", "no_evidence"), ("eb", "max_tokens"), ("ec", "filtered_out"), ("side:g:con", "unavailable")]
    paragraphs = spark.createDataFrame([("r1", 0, 0, 0, 100), ("r1", 0, 1, 101, 120), ("r1", 1, 2, 121, 140)], "revision string, section long, ordinal long, p_start long, p_end long")
    spans = spark.createDataFrame([("r1", 105, 110), ("r1", 125, 130), ("r9", 3, 5)], "revision string, s long, e long")
    assert rows(evidence.with_context(spans, paragraphs, 50)) == [("r1", 105, 110, 55, 120, True, False), ("r1", 125, 130, 121, 140, False, False), ("r9", 3, 5, 3, 5, False, False)]


def test_proposals_are_applied_as_a_whole_and_published_once(spark, tmp_path):
    records = spark.createDataFrame([("node", "n1", {"name": "a"}), ("claim", "c1", {"lifecycle_status": "active"})], "kind string, id string, state map<string,string>")
    held = {r["id"]: r["h"] for r in records.select("id", proposals.state_hash(F.col("state")).alias("h")).collect()}
    item = lambda p, i, op, target, payload=None, before=None, decision="accepted", valid=True: (p, i, i, op, target, payload, before, valid, decision)
    items = spark.createDataFrame(
        [
            item("p1", 1, "update_node_summary", "n1", {"summary": "old"}, held["n1"]), item("p1", 2, "update_node_summary", "n1", {"summary": "new", "lifecycle_status": "x"}, held["n1"]), item("p1", 3, "add_claim", "c2", {"t": "x"}),
            item("p2", 1, "update_node_summary", "n1", {"summary": "late"}, held["n1"]), item("p3", 1, "retract_claim", "c1", None, held["c1"]), item("p3", 2, "delete_all", "c1"), item("p4", 1, "add_claim", "c3", {}, None, "pending"),
            item("p5", 1, "add_claim", "c4", {}, None, "rejected"), item("p6", 1, "retract_claim", "zz"), item("p7", 1, "add_claim", "c5", {}, None, "accepted", False), item("p8", 1, "retract_claim", "c1", None, "other", "rejected"),
        ],
        "proposal_id string, item_id long, ordinal long, op string, target_id string, payload map<string,string>, before_sha256 string, valid boolean, decision string",
    )
    versions = Versions(spark, str(tmp_path / "versions"))
    base = versions.rebuild({"records": records, "runs": records.limit(1)})
    got = {r["proposal_id"]: (r["state"], r["problem"]) for r in proposals.publish(versions, items, base).collect()}
    assert got == {"p1": ("applied", None), "p2": ("stale", "twice"), "p3": ("reviewing", "unknown_op"), "p4": ("reviewing", None), "p5": ("rejected", None), "p6": ("reviewing", "missing"), "p7": ("reviewing", "invalid"), "p8": ("rejected", None)}
    now = {r["id"]: r["state"] for r in versions.current("records").collect()}
    assert now == {"n1": {"name": "a", "summary": "new"}, "c1": {"lifecycle_status": "active"}, "c2": {"t": "x", "lifecycle_status": "active"}}
    with pytest.raises(RuntimeError):  # a second writer that began from the same version
        proposals.publish(versions, items, base)
    assert versions.numbers() == [base, base + 1] and versions.at("records", base).count() == 2
    versions.rebuild({"records": records}, carry=("verdicts",))
    assert versions.current("verdicts").count() == 8
    with pytest.raises(LookupError, match="CURSOR_STALE"):
        versions.at("records", 99)
