"""Proposals: which may be applied, and what the records are afterwards, as joins over whole tables of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions.scratch import Scratch

# The patch operations, the kind of record each is for, and what it does.
OPERATIONS = {
    "create_node": ("node", "create"),
    "update_node_summary": ("node", "set"),
    "add_alias": ("alias", "create"),
    "add_claim": ("claim", "create"),
    "supersede_claim": ("claim", "superseded"),
    "retract_claim": ("claim", "retracted"),
    "add_relation": ("relation", "create"),
    "supersede_relation": ("relation", "superseded"),
    "retract_relation": ("relation", "retracted"),
    "add_evidence": ("evidence", "create"),
    "create_synthesis": ("synthesis", "create"),
    "update_source_metadata": ("source", "set"),
}


def _of(op: Column, place: int) -> Column:
    return F.create_map(*[F.lit(x) for name, found in OPERATIONS.items() for x in (name, found[place])])[op]


def state_hash(state: Column) -> Column:
    return F.sha2(T.canonical_map(state), 256)


def judged(items: DataFrame, records: DataFrame) -> DataFrame:
    """Adds kind, action and problem to items (proposal_id, item_id, ordinal, op, target_id, payload, before_sha256, valid, decision).

    records (kind, id, state).  Problems, of which the first counts: unknown_op; invalid (evidence, schema or an ambiguous entity); exists, for a
    new record whose id is taken; missing; stale, if the record is no longer what the item was made for; twice, if an earlier accepted
    item of another proposal changes the same record.
    """
    known = items.withColumn("kind", _of(F.col("op"), 0)).withColumn("action", _of(F.col("op"), 1))
    held = records.select(F.col("kind").alias("of"), F.col("id").alias("target"), state_hash(F.col("state")).alias("now"))
    joined = known.join(held, (F.col("kind") == F.col("of")) & (F.col("target_id") == F.col("target")), "left")
    firsts = known.where("decision = 'accepted'").groupBy(F.col("kind").alias("k"), F.col("target_id").alias("t")).agg(F.min("proposal_id").alias("first"))
    joined = joined.join(firsts, (F.col("kind") == F.col("k")) & (F.col("target_id") == F.col("t")), "left")
    create, there = F.col("action") == "create", F.col("target").isNotNull()
    problem = (
        F.when(F.col("kind").isNull(), "unknown_op").when(~F.coalesce("valid", F.lit(True)), "invalid").when(create & there, "exists").when(~create & ~there, "missing")
        .when(~create & ~F.col("before_sha256").eqNullSafe(F.col("now")), "stale").when(F.col("first") < F.col("proposal_id"), "twice")
    )
    return joined.withColumn("problem", problem).drop("of", "target", "now", "k", "t", "first")


def verdicts(items: DataFrame, mode: str = "strict") -> DataFrame:
    """(proposal_id, pending, accepted, rejected, problem, state) of judged items.

    A proposal is applied as a whole or not at all: stale if an accepted item is; reviewing while something is pending (in strict mode) or an accepted
    item has another problem; rejected if nothing is accepted; approved otherwise.
    """
    if mode not in ("strict", "relaxed"):
        raise ValueError(f"mode must be strict or relaxed, not {mode}")
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    taken = F.when(F.col("decision") == "accepted", F.col("problem"))
    sums = items.groupBy("proposal_id").agg(count("pending"), count("accepted"), count("rejected"), F.min(taken).alias("problem"), F.bool_or(taken.isin("stale", "twice")).alias("old"))
    waits = F.col("problem").isNotNull() | ((F.col("pending") > 0) & F.lit(mode == "strict"))
    state = F.when(F.coalesce("old", F.lit(False)), "stale").when(waits, "reviewing").when(F.col("accepted") == 0, F.when(F.col("pending") > 0, "reviewing").otherwise("rejected")).otherwise("approved")
    return sums.withColumn("state", state).drop("old")


def applied(items: DataFrame, records: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(records, verdicts) after all approved proposals: accepted items change states field by field, the last ordinal of a field decides.

    Retraction and supersession only set the lifecycle status; nothing is deleted.
    """
    scratch = Scratch(items.sparkSession, "proposals")
    told = scratch.table(judged(items, records), "judged")
    found = scratch.table(verdicts(told, mode), "verdicts")
    ready = told.where("decision = 'accepted'").join(found.where("state = 'approved'").select("proposal_id"), "proposal_id", "left_semi")
    ended = F.when(F.col("action").isin("superseded", "retracted"), F.create_map(F.lit("lifecycle_status"), F.col("action"))).when(F.col("action") == "create", F.create_map(F.lit("lifecycle_status"), F.lit("active")))
    payload = F.map_filter(F.coalesce("payload", F.create_map().cast("map<string,string>")), lambda k, v: k != "lifecycle_status")
    fields = ready.select("kind", F.col("target_id").alias("id"), "ordinal", F.explode(F.map_entries(F.when(ended.isNull(), payload).otherwise(F.map_concat(payload, ended)))).alias("x"))
    last = fields.groupBy("kind", "id", "x.key").agg(F.max_by("x.value", "ordinal").alias("value"))
    change = last.groupBy(F.col("kind").alias("of"), F.col("id").alias("target")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("change"))  # the fields of one record
    both = records.join(change, (F.col("kind") == F.col("of")) & (F.col("id") == F.col("target")), "full_outer")
    kept = F.map_filter("state", lambda k, v: ~F.array_contains(F.map_keys("change"), k))
    state = F.when(F.col("change").isNull(), F.col("state")).when(F.col("state").isNull(), F.col("change")).otherwise(F.map_concat(kept, "change"))
    return both.select(F.coalesce("kind", "of").alias("kind"), F.coalesce("id", "target").alias("id"), state.alias("state")), found.withColumn("state", F.when(F.col("state") == "approved", "applied").otherwise(F.col("state")))


def publish(versions, items: DataFrame, base: int, mode: str = "strict") -> DataFrame:
    """Applies proposals to the records of a versioned projection (``sources.workspace.Versions``) and returns the verdicts.

    The new version is put in place only if ``base`` is still the current one.
    """
    records, found = applied(items, versions.at("records", base), mode)
    versions.rebuild({"records": records, "verdicts": found}, base=base)
    return versions.current("verdicts")
