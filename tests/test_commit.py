import os

import pytest

from evigraph.sources import commit, workspace

OLD = {"a.md": b"one", "sub/b.md": b"two", "c.md": b"three"}
NEW = [("a.md", b"ONE"), ("sub/b.md", None), ("deep/er/d.md", b"\x00\xff"), ("e.md", b""), ("c.md", b"three")]
AFTER = {"a.md": b"ONE", "deep/er/d.md": b"\x00\xff", "e.md": b"", "c.md": b"three"}


def workspace_of(path):
    for name, content in OLD.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(content)
    return str(path)


def contents(root):
    return {os.path.relpath(f"{d}/{f}", root): open(f"{d}/{f}", "rb").read() for d, _, fs in os.walk(root) for f in fs if "/." not in f"{d}/{f}"}


def wanted(spark, rows=NEW):
    return spark.createDataFrame([(p, c, "x") for p, c in rows], "path string, content binary, extra string").repartition(3)


def test_files_change_together(spark, tmp_path):
    root = workspace_of(tmp_path / "w")
    commits = commit.Commits(spark, root)
    assert commits.apply(wanted(spark)) == 4 and contents(root) == AFTER and commits.unfinished() == []
    assert commits.apply(wanted(spark)) == 0 and commits.apply(wanted(spark, [])) == 0
    seen = {r["path"].split("/w/")[1] for r in workspace.files(spark, f"file://{root}").select("path").collect()}
    assert seen == {p for p, c in AFTER.items() if c}  # Spark has no row for an empty file


@pytest.mark.parametrize("done", range(5))
def test_recovery_after_a_crash_between_any_two_renames(spark, tmp_path, done):
    root = workspace_of(tmp_path / "w")
    commits = commit.Commits(spark, root)
    name = commits.stage(wanted(spark))
    rows = sorted(r for r in commits.actions(name).collect() if r["action"] == "roll_forward")
    for r in rows[:done]:
        commit.put(root, f"{commits.staging}/{name}", r["path"], r["after"])
    with pytest.raises(commit.Conflict, match="UNFINISHED"):
        commits.stage(wanted(spark))
    assert commit.Commits(spark, root).recover() == {name: 4 - done}
    assert contents(root) == AFTER and os.listdir(commits.staging) == []


def test_foreign_changes_are_conflicts_and_nothing_is_touched(spark, tmp_path):
    root = workspace_of(tmp_path / "w")
    commits = commit.Commits(spark, root)
    name = commits.stage(wanted(spark))
    (tmp_path / "w" / "a.md").write_bytes(b"someone else")
    with pytest.raises(commit.Conflict, match="a.md"):
        commits.recover()
    assert contents(root) == {**OLD, "a.md": b"someone else"} and commits.unfinished() == [name]


def test_what_has_no_manifest_never_was(spark, tmp_path):
    root = workspace_of(tmp_path / "w")
    os.makedirs(f"{root}/.staging/half/building")
    commits = commit.Commits(spark, root)
    assert commits.recover() == {} and contents(root) == OLD and os.listdir(commits.staging) == []
    for path in ("/etc/x", "../x", ".staging/x", "", "a/../b"):
        with pytest.raises(ValueError, match="INVALID_PATH"):
            commits.stage(wanted(spark, [(path, b"")]))
    with pytest.raises(ValueError, match="INVALID_PATH"):
        commits.stage(wanted(spark, [("x", b"1"), ("x", b"2")]))
