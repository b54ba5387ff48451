"""Files of a workspace that change together.

The new contents are staged beside the workspace with a manifest of each file's hash before and after; the
manifest is the commit.  Then every file is put in place by a rename, in tasks.  After a crash at any point ``recover`` goes on where
it stopped: a file that is as it was before is replaced, one that is as it should be is left, and any
other is a conflict, which stops the recovery before it touches a file.  A retried task does the same.

The workspace is a folder that the driver and all executors see under the same path.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.scratch import Scratch
from evigraph.operators import runs

ABSENT = ""  # the hash of a file that is not there


class Conflict(RuntimeError):
    """A file is neither as the commit found it nor as it leaves it."""


def _hash(path: str) -> str:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except FileNotFoundError:
        return ABSENT


def _staged(folder: str, path: str) -> str:
    return f"{folder}/{hashlib.sha256(path.encode()).hexdigest()}"


def put(root: str, folder: str, path: str, after: str) -> None:
    """One file's step: its staged content takes its place, or it goes."""
    target, staged = f"{root}/{path}", _staged(folder, path)
    if after == ABSENT:
        if os.path.exists(target):
            os.remove(target)
    elif os.path.exists(staged):
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.replace(staged, target)
    elif _hash(target) != after:
        raise Conflict(f"TRANSACTION_CONFLICT: {path}")


class Commits:
    """Commits of the workspace in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.staging = f"{self.root}/.staging"  # readers of the workspace skip names with a dot

    def unfinished(self) -> list[str]:
        """Commits that have a manifest and were not ended."""
        return sorted(t for t in (os.listdir(self.staging) if os.path.isdir(self.staging) else []) if os.path.isdir(f"{self.staging}/{t}/manifest"))

    def stage(self, wanted: DataFrame) -> str:
        """Stages files (path, relative and unique, and content; null deletes) and returns the commit's name."""
        if found := self.unfinished():
            raise Conflict(f"TRANSACTION_UNFINISHED: {found[0]}")
        bad = wanted.groupBy("path").agg(F.count("*").alias("n")).where(r"n > 1 OR path IS NULL OR path = '' OR path RLIKE '^/|(^|/)\\.{1,2}(/|$)|^\\.staging(/|$)'").take(1)
        if bad:
            raise ValueError(f"INVALID_PATH: {bad[0]['path']}")
        name = uuid.uuid4().hex
        root, folder = self.root, f"{self.staging}/{name}"
        os.makedirs(folder)

        def write(frames):
            for frame in frames:
                rows = []
                for path, content in zip(frame["path"], frame["content"], strict=True):
                    after = ABSENT
                    if content is not None:
                        after = hashlib.sha256(content).hexdigest()
                        own = f"{_staged(folder, path)}.{uuid.uuid4().hex}"
                        with open(own, "wb") as f:
                            f.write(content)
                            f.flush()
                            os.fsync(f.fileno())
                        os.replace(own, _staged(folder, path))
                    rows.append((path, _hash(f"{root}/{path}"), after))
                yield pd.DataFrame(rows, columns=["path", "before", "after"])

        manifest = wanted.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(write, "path string, before string, after string")
        manifest.write.parquet(f"file://{folder}/building")
        os.rename(f"{folder}/building", f"{folder}/manifest")
        return name

    def actions(self, name: str) -> DataFrame:
        """(path, before, after, actual, action) of the manifest's files as they are now; only these are read."""
        root = self.root

        def look(frames):
            for frame in frames:
                yield frame.assign(actual=[_hash(f"{root}/{p}") for p in frame["path"]])

        found = self.spark.read.parquet(f"file://{self.staging}/{name}/manifest").mapInPandas(look, "path string, before string, after string, actual string")
        return found.withColumn("action", runs.recovery(F.col("actual"), F.col("before"), F.col("after")))

    def finish(self, name: str) -> int:
        """Puts the files of a staged commit in place, and returns how many were still to do."""
        scratch = Scratch(self.spark, "commit")
        actions = scratch.table(self.actions(name), "actions")
        if bad := actions.where("action = 'conflict'").take(1):
            raise Conflict(f"TRANSACTION_CONFLICT: {bad[0]['path']}")
        root, folder = self.root, f"{self.staging}/{name}"

        def place(frames):
            for frame in frames:
                for path, after in zip(frame["path"], frame["after"], strict=True):
                    put(root, folder, path, after)
                yield pd.DataFrame({"n": [len(frame)]})

        done = actions.where("action = 'roll_forward'").select("path", "after").mapInPandas(place, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        scratch.drop()
        shutil.rmtree(folder)
        return done

    def apply(self, wanted: DataFrame) -> int:
        return self.finish(self.stage(wanted))

    def recover(self) -> dict[str, int]:
        """Ends all commits that have a manifest; what was staged without one never was a commit and goes."""
        done = {name: self.finish(name) for name in self.unfinished()}
        for name in os.listdir(self.staging) if os.path.isdir(self.staging) else []:
            shutil.rmtree(f"{self.staging}/{name}")
        return done
