"""Freshness, impact and refresh comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.constants import MAX_PAGE


def freshness(claims: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds freshness and reasons to claims (source_id, revision_id) by the current heads (source_id, head, removed).

    Without a recorded revision the freshness is unknown.
    """
    joined = claims.join(heads, "source_id", "left")
    removed, behind = F.coalesce("removed", F.lit(True)), F.col("head") != F.col("revision_id")
    reasons = F.array_compact(F.array(F.when(behind, "source_revision_behind"), F.when(removed, "source_removed")))
    known = F.col("revision_id").isNotNull()
    return joined.withColumn("reasons", F.when(known, reasons).otherwise(F.array().cast("array<string>"))).withColumn("freshness", F.when(~known, "unknown").when(F.size("reasons") > 0, "needs_review").otherwise("current")).drop("head", "removed")


def dependency_freshness(items: DataFrame, dependencies: DataFrame, current: DataFrame, sources: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, freshness, reasons) of items (id, has_snapshot), for instance syntheses.

    dependencies (id, dependency_id, recorded_hash) against current (dependency_id, semantic_hash);
    sources (id, source_id, revision_id) against heads (source_id, head, removed).  Without a snapshot the freshness is unknown.
    """
    changed = dependencies.join(current, "dependency_id", "left").where(~F.col("recorded_hash").eqNullSafe(F.col("semantic_hash"))).select("id", F.lit("dependency_changed").alias("reason"))
    against = sources.join(heads, "source_id", "left")
    behind = against.where(F.col("head") != F.col("revision_id")).select("id", F.lit("source_revision_behind").alias("reason"))
    removed = against.where(F.coalesce("removed", F.lit(True))).select("id", F.lit("source_removed").alias("reason"))
    reasons = changed.unionByName(behind).unionByName(removed).distinct().groupBy("id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))  # three at most
    none = F.array().cast("array<string>")
    joined = items.join(reasons, "id", "left")
    return joined.select("id", F.when(~F.col("has_snapshot"), "unknown").when(F.col("reasons").isNotNull(), "needs_review").otherwise("current").alias("freshness"), F.when(F.col("has_snapshot"), F.coalesce("reasons", none)).otherwise(none).alias("reasons"))


def impact(evidence: DataFrame, assertions: DataFrame, syntheses: DataFrame) -> DataFrame:
    """(source_id, kind, id): everything that rests on a source, once, however it is reached.

    evidence (source_id, evidence_id); assertions (kind, id, evidence_id); syntheses (id, evidence_id, assertion_id).
    """
    direct = evidence.join(assertions, "evidence_id").select("source_id", "kind", "id")
    cited = evidence.join(syntheses, "evidence_id").select("source_id", F.lit("synthesis").alias("kind"), "id")
    through = direct.withColumnRenamed("id", "assertion_id").join(syntheses, "assertion_id").select("source_id", F.lit("synthesis").alias("kind"), "id")
    return direct.unionByName(cited).unionByName(through).distinct()


def impact_items(revisions: DataFrame, evidence: DataFrame, assertions: DataFrame, syntheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, dependencies) of everything that rests on the given revisions, level by level, and why it is touched.

    revisions (source_id, revision_id, head, removed); evidence (evidence_id, revision_id); assertions (kind, id, evidence_id);
    syntheses (id, evidence_id, assertion_kind, assertion_id), one row for each thing a synthesis was written from, either column null.
    Items have (source_id, kind, id, n_dependencies, reasons), dependencies (source_id, kind, id, dependency_kind, dependency_id).
    A reason is handed on from level to level: source_revision_behind, source_removed, or referenced, where the source itself has not
    changed.  Each level only joins what the one before touched, so the work follows the revisions asked for.
    """
    behind = (F.col("revision_id") != F.col("head")).eqNullSafe(True)
    why = F.array_compact(F.array(F.when(behind, "source_revision_behind"), F.when(F.coalesce("removed", F.lit(True)), "source_removed")))
    level = revisions.select("source_id", "revision_id", F.explode(F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("referenced")))).alias("reason"))
    steps, touched = [], None

    def rest(found: DataFrame) -> DataFrame:
        """Notes (source_id, kind, id, dependency_kind, dependency_id, reason) and gives what the next level joins."""
        steps.append(found)
        return found.select("source_id", F.col("kind").alias("dependency_kind"), F.col("id").alias("dependency_id"), "reason").distinct()

    shape = ("source_id", "kind", "id", "dependency_kind", "dependency_id", "reason")
    on_revision = level.join(evidence, "revision_id").select("source_id", F.lit("evidence").alias("kind"), F.col("evidence_id").cast("string").alias("id"), F.lit("revision").alias("dependency_kind"), F.col("revision_id").cast("string").alias("dependency_id"), "reason")
    touched = rest(on_revision)
    said = assertions.select("kind", F.col("id").cast("string").alias("id"), F.col("evidence_id").cast("string").alias("dependency_id"))
    claims = rest(touched.join(said, "dependency_id").select(*shape))
    written = syntheses.select(F.lit("synthesis").alias("kind"), F.col("id").cast("string").alias("id"), F.when(F.col("evidence_id").isNotNull(), "evidence").otherwise(F.col("assertion_kind")).alias("dependency_kind"), F.coalesce(F.col("evidence_id").cast("string"), F.col("assertion_id").cast("string")).alias("dependency_id"))
    rest(touched.unionByName(claims).join(written, ["dependency_kind", "dependency_id"]).select(*shape))
    edges = steps[0]
    for step in steps[1:]:
        edges = edges.unionByName(step)
    items = edges.groupBy("source_id", "kind", "id").agg(F.countDistinct("dependency_kind", "dependency_id").alias("n_dependencies"), F.array_sort(F.collect_set("reason")).alias("reasons"))  # three reasons at most
    return items, edges.drop("reason").distinct()


def impact_page(items: DataFrame, generation: int, size: int, after: tuple[str, str] | None = None, given: int | None = None) -> DataFrame:
    """The items of a source after the last (kind, id), in that order, with the generation they were read at; a cursor of another generation is stale."""
    if given is not None and given != generation:
        raise ValueError("CURSOR_STALE")
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} records")
    if after is not None:
        items = items.where((F.col("kind") > after[0]) | ((F.col("kind") == after[0]) & (F.col("id") > after[1])))
    place = F.row_number().over(W.partitionBy("source_id").orderBy("kind", "id"))
    return items.withColumn("position", place.cast("long")).where(F.col("position") <= size).withColumn("generation", F.lit(generation).cast("long"))


def compare_refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, outcome) of assertions (key, hash) before and after: nothing not mentioned again is ever retracted."""
    both = old.select(F.col("key"), F.col("hash").alias("was")).join(new.select("key", F.col("hash").alias("now")), "key", "full_outer")
    outcome = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "not_mentioned").when(F.col("was") == F.col("now"), "evidence_added").otherwise("changed")
    return both.select("key", outcome.alias("outcome"))
