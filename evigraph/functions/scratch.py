"""Intermediate tables in a folder that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A folder of intermediate tables.

    It lies under ``spark.checkpoint.dir`` of the session.  Only where that is
    unset (single-machine tests) a temporary folder takes its place.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.gettempdir() + "/evigraph-scratch"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def table(self, frame: DataFrame, name: str, *by: str) -> DataFrame:
        """Write the frame once, in folders by the columns in ``by``, and return a reader over the files, which cuts the lineage."""
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").partitionBy(*by).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _folder(self, name: str = ""):
        spark = self.spark.sparkContext
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def drop(self, name: str = "") -> None:
        """Delete a table, or the whole folder."""
        fs, path = self._folder(name)
        fs.delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these, once nothing reads them any more."""
        fs, path = self._folder()
        for found in fs.listStatus(path):
            if found.getPath().getName() not in names:
                fs.delete(found.getPath(), True)
