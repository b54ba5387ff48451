"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.scratch import Scratch

#: White space of every contract in this package: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"

#: Held-out remainder of crc32(doc_id as text) mod 4.
HELD_OUT = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents no model may learn from (a null id is held out as well)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def values(column):
    """The values of an Arrow column, one at a time, so that a batch of long texts is never held twice."""
    for value in column:
        yield value.as_py()


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(frame: DataFrame, name: str, scratch: Scratch | None) -> DataFrame:
    """The frame with row numbers in a column.

    They are written with the rows once, since numbers that are made again (by a retry, or by
    a second reading) may differ.  Without a scratch folder the frame must be read straight from files: a row's number is then made of its file's place
    in the order of paths and its place in that file, which hold however the files are split and whichever executors read them.
    """
    if scratch is not None:
        return scratch.table(frame.withColumn(name, F.monotonically_increasing_id()), "numbered")
    spark = frame.sparkSession
    paths = sorted(r[0] for r in frame.select(F.col("_metadata.file_path")).distinct().collect())  # one a file
    path, file = fresh(frame, "__path"), fresh(frame, "__file")
    files = spark.createDataFrame(list(enumerate(paths)), f"{file} long, {path} string")
    rows = frame.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(name))
    return rows.join(F.broadcast(files), path).withColumn(name, F.shiftleft(file, 40) + F.col(name)).drop(path, file)
