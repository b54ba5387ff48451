import pytest

from evigraph.sources import formats, workspace
from evigraph.streaming import watch

pytest.importorskip("yaml")

PAGE = """---
version: 1
id: kn_1
kind: node
name: Alder
---

# Alder

Free notes, kept as they are.

<!-- ws:claims:begin -->
```yaml
version: 1
items:
  - id: clm_1
    statement: It works.
    evidence_status: supported
    evidence:
      - id: evd_1
```
<!-- ws:claims:end -->
tail
"""


def test_round_trip_is_byte_identical_and_changes_stay_inside():
    items = workspace.parse_node(PAGE)["claims"]
    assert workspace.render_node(PAGE, "claims", items) == PAGE
    changed = workspace.render_node(PAGE, "claims", [{"id": "clm_2"}, *items])
    assert [x["id"] for x in workspace.parse_node(changed)["claims"]] == ["clm_1", "clm_2"]
    assert changed.split("<!-- ws:claims:begin -->")[0] == PAGE.split("<!-- ws:claims:begin -->")[0] and changed.endswith("tail\n")


@pytest.mark.parametrize("broken", [PAGE.replace("<!-- ws:claims:end -->", ""), PAGE + PAGE[PAGE.index("<!--") :]])
def test_broken_markers(broken):
    with pytest.raises(ValueError, match="INVALID_MANAGED_BLOCK"):
        workspace.parse_node(broken)


def test_scan_and_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(PAGE)
    (tmp_path / "in" / "b.md").write_text("no front matter")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in workspace.assertions(workspace.files(spark, str(tmp_path / "in"))).collect()}
    assert rows["a.md"]["id"] == "clm_1" and rows["a.md"]["evidence_ids"] == ["evd_1"] and rows["b.md"]["error"] == "MISSING_FRONT_MATTER"
    for n in (2, 3):
        watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / f"c{n}.md").write_text(str(n))


def test_chunks_keep_the_text(spark):
    text = "# a\n" + "\n".join("x" * 300 for _ in range(20)) + "\n# b\n" + "y" * 9000
    rows = workspace.structural_chunks(spark.createDataFrame([(1, text), (2, None)], "owner_id long, text string")).collect()
    mine = sorted((r["ordinal"], r["text"], r["tokens"]) for r in rows if r["owner_id"] == 1)
    assert "".join(x.replace("\n", "") for _, x, _ in mine) == text.replace("\n", "") and max(n for *_, n in mine) <= 1000


def test_csv_rejects_nested_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        workspace.write_csv(spark.sql("SELECT array(1) AS a"), str(tmp_path / "x"))


SOURCE = """version: 1
id: src_1
kind: paper
title: One
tags: [a, b]
current_revision_id: rev_2
revisions:
  - {id: rev_1, path: r/1, sha256: aa, byte_size: 3, captured_at: 2026-01-01T00:00:00Z}
  - {id: rev_2, path: r/2, sha256: bb, byte_size: 4, captured_at: 2026-01-02T00:00:00Z}
"""
SYNTHESIS = """---
id: syn_1
kind: synthesis
title: T
evidence_ids: [evd_1]
dependency_snapshot:
  assertions: [{kind: claim, id: clm_1, semantic_sha256: aa}]
  source_heads: [{source_id: src_1, revision_id: rev_1}]
---
Text [@evd_1] and [@evd_2] [@evd_1].
"""
PACK = """id: mine
version: 1
extends: [base@1]
node_types:
  Tree: {label: Tree, properties: {height: {type: number, required: true}, note: {type: string}}}
predicates:
  near: {source_types: [Tree], target_types: [Tree], directed: false}
"""


def test_sources_syntheses_and_purpose(spark, tmp_path):
    root = tmp_path / "ws"
    for name, text in {"sources/a/source.yaml": SOURCE, "sources/b/source.yaml": "version: 9\nid: x\n", "syn/s.md": SYNTHESIS, "syn/t.md": SYNTHESIS.replace("syn_1", "syn_2").replace("dependency_snapshot", "other"), "n.md": PAGE, "purpose.md": "p" * 20_000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    manifest = workspace.files(spark, str(root))
    rows = workspace.sources(manifest).orderBy("revision_id").collect()
    assert [(r["revision_id"], r["is_current"], r["captured_at"], r["error"]) for r in rows] == [(None, None, None, "UNSUPPORTED_VERSION"), ("rev_1", False, "2026-01-01T00:00:00Z", None), ("rev_2", True, "2026-01-02T00:00:00Z", None)]
    got = {(r["id"], r["has_snapshot"], r["dependency_id"], r["source_id"]) for r in workspace.syntheses(manifest).where("error IS NULL").collect()}
    assert got == {("syn_1", True, "clm_1", None), ("syn_1", True, None, "src_1"), ("syn_2", False, None, None)}
    assert workspace.syntheses(manifest).where("id = 'syn_1'").first()["cited"] == ["evd_1", "evd_2"]
    told = workspace.purpose(manifest, "purpose.md").first()
    assert told["text"] is None and told["error"] == "PURPOSE_TOO_LARGE"


def test_config_and_packs(spark):
    settings, missing = workspace.config("a: ${X}\nb: {c: '${Y}-z', d: [1, '${X}']}", {"X": "one"})
    assert settings == {"a": "one", "b": {"c": "-z", "d": [1, "one"]}} and missing == ["Y"]
    base = "id: base\nversion: 1\n"
    types, predicates = workspace.schema_pack(spark, base, PACK)
    assert types.first()["required"] == ["height"] and predicates.first()["directed"] is False
    assert workspace.pack_edges(base, PACK) == [("mine@1", "base@1")]
    for wrong in ((PACK,), (base, base)):
        with pytest.raises(ValueError):
            workspace.schema_pack(spark, *wrong)


def test_versions_are_switched_and_old_ones_go(spark, tmp_path):
    store = workspace.Versions(spark, f"file://{tmp_path}/v", keep=2)
    assert store.current("t") is None
    for i in range(3):
        store.rebuild({"t": spark.range(i + 1)})
    assert store.numbers() == [2, 3] and store.current("t").count() == 3

    def refuse(tables):
        raise ValueError("not whole")

    with pytest.raises(ValueError):
        store.rebuild({"t": spark.range(9)}, refuse)
    assert store.current("t").count() == 3


def test_formats(spark, tmp_path):
    text = "---\nx: 1\n---\n# A\npara one\nstill\n\n- i\n- j\n\n## B\n```\n# code\n\n```\n> q\n"
    found = formats.blocks_of(text)
    assert [(k, s) for k, _, s, _, _ in found] == [("heading", ["A"]), ("paragraph", ["A"]), ("list", ["A"]), ("heading", ["A", "B"]), ("code", ["A", "B"]), ("quote", ["A", "B"])]
    assert all(text[a:b] == t for _, t, _, a, b in found)
    rows = formats.text_blocks(spark.createDataFrame([(1, b"a\n\nb c"), (2, b"\xff\xfe")], "id long, content binary"), "id").orderBy("id", "pos").collect()
    assert [(r["id"], r["text"], r["error"]) for r in rows] == [(1, "a", None), (1, "b c", None), (2, None, "ENCODING_REQUIRED")]
    (tmp_path / "e.jsonl").write_text('{"query":"q","relevant_ids":["u1","u2"],"tags":["t"]}\n{broken\n')
    got = formats.evaluation_set(spark, str(tmp_path / "e.jsonl")).collect()
    assert {(r["query"], r["unit_id"]) for r in got} == {("q", "u1"), ("q", "u2"), (None, None)} and sum(r["error"] is not None for r in got) == 1


def test_envelopes(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "id long, name string")
    assert workspace.envelope(rows.orderBy("id"), command="node.list")["data"] == [{"id": 1}, {"id": 2, "name": "x"}]
    body, code = workspace.error_envelope("not_found", "NOT_FOUND", "no node")
    assert code == 3 and body["ok"] is False
    assert workspace.as_table(rows.orderBy("id")) == "id  name\n1\n2   x"
    assert workspace.cache_key(a=1, b={"y": 1, "x": 2}) == workspace.cache_key(b={"x": 2, "y": 1}, a=1)


def test_changes_of_a_watched_folder(spark, tmp_path):
    rows = [("a", 1, "x", "2026-01-01"), ("a", 1, "y", "2026-01-02"), ("b", 2, "z", "2026-01-01")]
    spark.createDataFrame(rows, "path string, byte_size long, sha256 string, seen string").write.parquet(str(tmp_path / "m"))
    assert {(r["path"], r["change"]) for r in watch.changes(spark, str(tmp_path / "m")).collect()} == {("a", "changed"), ("b", "added")}
