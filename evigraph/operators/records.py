"""Records: lookups, lists, the search units of every kind, pages and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.constants import MAX_PAGE, PAGE, RECORD_TYPES
from evigraph.functions import text as T
from evigraph.functions.scratch import Scratch

UNIT = ("unit_id", "record_type", "record_id", "title", "aliases", "body", "tags", "language", "lifecycle_status", "content_sha256")
HIDDEN = ("rowid", "embedding")
FEW = 500_000  # keys that may be broadcast


def get(asked: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """The records asked for by id (also removed ones), with outcome found or NOT_FOUND."""
    found = records.withColumn("outcome", F.lit("found"))
    return asked.select(key).join(found, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("NOT_FOUND")))


def find_nodes(asked: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, node_id, by): nodes (node_id, name) that are asked for (qid, given) by id, name or alias (node_id, alias); of several ways the first counts."""
    norm = lambda c: T.normalize_name(F.col(c))
    keys = nodes.select(F.col("node_id").alias("k"), "node_id", F.lit(0).alias("way")).unionByName(nodes.select(norm("name").alias("k"), "node_id", F.lit(1).alias("way"))).unionByName(aliases.select(norm("alias").alias("k"), "node_id", F.lit(2).alias("way")))
    scratch = Scratch(asked.sparkSession, "find")
    asks = scratch.table(asked.select("qid", F.explode(F.array_distinct(F.array(F.col("given"), norm("given")))).alias("k")).distinct(), "asks")
    wanted = asks.select("k").distinct()
    known = keys.join(F.broadcast(wanted) if asks.count() <= FEW else wanted, "k", "left_semi").groupBy("k", "node_id").agg(F.min("way").alias("way"))
    known = scratch.table(known, "known")
    # a node can only come twice for a question that finds nodes by two keys; the others' nodes, which may be many, are told as they are met
    held = asks.join(known.select("k").distinct(), "k", "left_semi").withColumn("n", F.count("*").over(W.partitionBy("qid")))
    held = scratch.table(held, "held")
    best = held.where("n = 1").join(known, "k").select("qid", "node_id", "way").unionByName(held.where("n > 1").join(known, "k").groupBy("qid", "node_id").agg(F.min("way").alias("way")))
    return best.select("qid", "node_id", F.element_at(F.array(F.lit("id"), F.lit("name"), F.lit("alias")), F.col("way") + 1).alias("by"))


def listed(records: DataFrame, *, record_types=None, node_types=None, tags=None, lifecycle=("active",), evidence_status=None, source_ids=None) -> DataFrame:
    """The records that pass every filter given; one that a record has no column for is no filter of it.

    Tags pass with any of those given; node types only restrict nodes; evidence status and sources are those of the record.
    """
    rows = records
    for column, wanted in (("record_type", record_types), ("lifecycle_status", lifecycle), ("evidence_status", evidence_status)):
        if wanted is not None and column in records.columns:
            rows = rows.where(F.col(column).isin(*wanted))
    if node_types is not None and "node_type" in records.columns:
        restricted = F.col("record_type") == "node" if "record_type" in records.columns else F.lit(True)
        rows = rows.where(~restricted | F.col("node_type").isin(*node_types))
    for column, wanted in (("tags", tags), ("source_ids", source_ids)):
        if wanted is not None and column in records.columns:
            rows = rows.where(F.arrays_overlap(column, F.array(*map(F.lit, wanted))))
    return rows


def of_present_sources(records: DataFrame, sources: DataFrame, history: bool = False) -> DataFrame:
    """Records (source_id) without those of removed sources (source_id, removed_at), unless history is asked for."""
    return records if history else records.join(sources.where("removed_at IS NOT NULL").select("source_id"), "source_id", "left_anti")


def with_evidence(assertions: DataFrame, evidence: DataFrame, source_ids=None) -> DataFrame:
    """Assertions (id) that some evidence (assertion_id, source_id) supports, of the sources given if any are."""
    held = evidence if source_ids is None else evidence.where(F.col("source_id").isin(*source_ids))
    return assertions.join(held.select(F.col("assertion_id").alias("id")), "id", "left_semi")


def recent(records: DataFrame, time: str, key: str, limit: int = PAGE) -> DataFrame:
    """The newest records first, at most a page."""
    return records.orderBy(F.desc(time), key).limit(min(limit, MAX_PAGE))


def allowed_actions(status: Column, attempts_left: Column, retryable: Column) -> Column:
    """What may be done with a run: pause and cancel while it works, resume when it stopped and may go on."""
    resume = status.isin("paused", "interrupted") | ((status == "failed") & retryable & (attempts_left > 0))
    return F.array_compact(F.array(F.when(status == "running", "pause"), F.when(status.isin("queued", "running", "paused"), "cancel"), F.when(resume, "resume")))


def unit(kind: str, rows: DataFrame, key: str, title: Column, body: Column, aliases: Column | None = None, tags: Column | None = None, language: Column | None = None, lifecycle: Column | None = None) -> DataFrame:
    """Search units of one kind of record."""
    if kind not in RECORD_TYPES:
        raise ValueError(f"no record type: {kind}")
    none = F.array().cast("array<string>")
    text = F.coalesce(body, F.lit(""))
    return rows.select(
        F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("unit_id"), F.lit(kind).alias("record_type"), F.col(key).cast("string").alias("record_id"), title.cast("string").alias("title"),
        (aliases if aliases is not None else none).alias("aliases"), text.alias("body"), (tags if tags is not None else none).alias("tags"), (language if language is not None else F.lit(None).cast("string")).alias("language"),
        (lifecycle if lifecycle is not None else F.lit("active")).alias("lifecycle_status"), F.sha2(F.concat_ws("\x1f", title.cast("string"), text), 256).alias("content_sha256"),
    )


def index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(unit_id, change): what an index of the units (unit_id, content_sha256) before must insert, delete or update."""
    a, b = before.select("unit_id", F.col("content_sha256").alias("was")), after.select("unit_id", F.col("content_sha256").alias("now"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") != F.col("now"), "update")
    return a.join(b, "unit_id", "full_outer").select("unit_id", change.alias("change")).where("change IS NOT NULL")


def public(records: DataFrame) -> DataFrame:
    """Without row numbers and raw vectors."""
    return records.drop(*HIDDEN)


def record_json(*columns: Column) -> Column:
    """A record as JSON; fields that aren't set are left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def error_json(kind: Column, message: Column, request: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("ok"), F.struct(kind.alias("type"), message.alias("message")).alias("error"), F.struct(request.alias("request_id")).alias("meta")))
