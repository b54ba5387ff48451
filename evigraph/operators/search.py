"""Hybrid ranked retrieval: lexical channels, weighted reciprocal rank fusion, boosts, tiers and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.constants import BOOST_ALIAS, BOOST_CAP, BOOST_NAME, BOOST_PREFIX, CANDIDATES, CHANNEL_WEIGHTS, MAX_CANDIDATES, MAX_PAGE, MAX_SNIPPET, RRF_K
from evigraph.functions import text as T
from evigraph.functions.scratch import Scratch
from evigraph.operators.index import TextIndex


def rank_candidates(hits: DataFrame, n: int = CANDIDATES, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Ranks from 1 by rounded score, ties by unit_id; filters belong before this.  A unit that comes twice keeps its best score."""
    if not 1 <= n <= MAX_CANDIDATES:
        raise ValueError(f"candidates must be 1 to {MAX_CANDIDATES}")
    best = hits.groupBy(*keys, "unit_id").agg(F.max("score").alias("score"))
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "unit_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def bm25(units: DataFrame, queries: DataFrame, tokens, text: str = "body", where: Column | None = None, n: int = CANDIDATES) -> DataFrame:
    """(qid, unit_id, score) as ``TextIndex.search`` gives it, for units that are asked once: the index is built for them and not kept."""
    index = TextIndex(units.sparkSession, Scratch(units.sparkSession, "bm25").root, tokens)
    return index.update(units, text).search(queries, where, n)


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] = CHANNEL_WEIGHTS, k: int = RRF_K, executed: tuple[str, ...] | None = None, able: dict[str, DataFrame] | None = None) -> DataFrame:
    """(qid, unit_id, raw, bound, normalized, ranks, degraded) from ranked channels.

    ``executed`` names the channels that ran, hits or not; a failed or disabled
    one must not be listed.  Without any there is no result.  ``able`` has, for a channel that not every
    query can use, the queries (qid) that can; for the others it counts as not executed, and
    ``degraded`` names it.
    """
    executed, able = executed if executed is not None else tuple(channels), able or {}
    parts = [df.select("qid", "unit_id", F.lit(name).alias("channel"), "rank", F.lit(weights[name]).alias("weight")) for name, df in channels.items() if name in executed]
    fixed = sum(weights[name] / (k + 1) for name in executed if name not in able)
    if not parts or not (fixed or able):
        raise ValueError("no channel ran")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("qid", "unit_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("raw"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"))
    bound, missing = F.lit(float(fixed)), []
    for name in (c for c in executed if c in able):
        fused = fused.join(able[name].select("qid", F.lit(True).alias(f"able_{name}")).distinct(), "qid", "left")
        bound = bound + F.when(F.col(f"able_{name}"), weights[name] / (k + 1)).otherwise(0.0)
        missing.append(F.when(F.col(f"able_{name}").isNull(), name))
    fused = fused.withColumn("bound", bound).withColumn("degraded", F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>"))
    return fused.where("bound > 0").withColumn("normalized", F.round(F.col("raw") / F.col("bound"), 6)).withColumn("raw", F.round("raw", 6)).drop(*[f"able_{c}" for c in able])


def boost(name: Column, alias: Column, prefix: Column) -> Column:
    part = lambda test, value: F.when(test, value).otherwise(0.0)
    return F.least(part(name, BOOST_NAME) + part(alias, BOOST_ALIAS) + part(prefix, BOOST_PREFIX), F.lit(BOOST_CAP))


def with_boosts(fused: DataFrame, units: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds title, boost and final."""
    joined = fused.join(units.select("unit_id", "title", "aliases"), "unit_id").join(queries.select("qid", "query"), "qid")
    q, title = T.normalize_name(F.col("query")), T.normalize_name(F.col("title"))
    alias = F.exists("aliases", lambda a: T.normalize_name(a) == q)
    return joined.withColumn("boost", boost(title == q, alias, title.startswith(q))).withColumn("final", F.round(F.col("normalized") + F.col("boost"), 6)).drop("aliases")


def with_exact_ids(ranked: DataFrame, units: DataFrame, wanted: DataFrame, where: Column | None = None) -> DataFrame:
    """Tier 1 for units named by id in ``wanted`` (qid, unit_id), also without a hit, if the filter lets them pass."""
    allowed = units.where(where) if where is not None else units
    named = wanted.join(allowed.select("unit_id"), "unit_id", "left_semi")
    tiers = named.select("qid", "unit_id", F.lit(1).alias("t"))
    return ranked.join(tiers, ["qid", "unit_id"], "full_outer").select("qid", "unit_id", F.coalesce("t", F.lit(0)).alias("tier"), F.coalesce("normalized", F.lit(0.0)).alias("normalized"), F.coalesce("final", F.lit(0.0)).alias("final"))


def final_order(ranked: DataFrame, score: str = "final") -> DataFrame:
    """Position in the result: tier, score, unit_id."""
    w = W.partitionBy("qid").orderBy(F.desc("tier"), F.desc(score), "unit_id")
    return ranked.withColumn("position", F.row_number().over(w).cast("long"))


def after_cursor(ranked: DataFrame, cursors: DataFrame, size: int, score: str = "final") -> DataFrame:
    """The page after (last_score, last_id) of each query; keyset, no offset."""
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} records")
    rest = ranked.join(cursors, "qid").where((F.col(score) < F.col("last_score")) | ((F.col(score) == F.col("last_score")) & (F.col("unit_id") > F.col("last_id"))))
    w = W.partitionBy("qid").orderBy(F.desc(score), "unit_id")
    return rest.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= size).drop("last_score", "last_id")


def short_match(units: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact title or substring of the title for queries of at most two characters, which meet titles by their characters or pairs."""
    short = queries.where(F.length("query").between(1, 2)).select("qid", F.lower("query").alias("q"))
    title = F.lower("title")
    pieces = F.transform(F.sequence(F.lit(1), F.length(title)), lambda i: F.array(F.substring(title, i, F.lit(1)), F.substring(title, i, F.lit(2))))
    keyed = units.where(F.length("title") > 0).select("unit_id", title.alias("t"), F.explode(F.array_distinct(F.flatten(pieces))).alias("q"))
    return keyed.join(short, "q").select("qid", "unit_id", (F.col("t") == F.col("q")).alias("exact"))


def resolve_query(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, normalized, resolved): the query in its normal form, and the nodes (names: name, node_id) of that name in order."""
    known = names.select(T.normalize_name(F.col("name")).alias("normalized"), "node_id").distinct().groupBy("normalized").agg(F.array_sort(F.collect_list("node_id")).alias("resolved"))  # nodes of one name
    asked = queries.select("qid", T.normalize_name(F.col("query")).alias("normalized"))
    return asked.join(known, "normalized", "left").select("qid", "normalized", F.coalesce("resolved", F.array().cast("array<string>")).alias("resolved"))


def fingerprint(query: Column, filters: Column, generation: Column) -> Column:
    """What a page cursor is good for: a query, its filters and the generation of the index."""
    return F.sha2(F.concat_ws("\x1f", T.normalize_name(query), filters, generation.cast("string")), 256)


def cursor_state(cursors: DataFrame, generation: int) -> DataFrame:
    """Adds state to cursors (query_fingerprint, given_fingerprint, given_generation): ok, CURSOR_STALE (older index) or CURSOR_QUERY_MISMATCH."""
    other = F.col("query_fingerprint") != F.col("given_fingerprint")
    return cursors.withColumn("state", F.when(F.col("given_generation") != generation, "CURSOR_STALE").when(other, "CURSOR_QUERY_MISMATCH").otherwise("ok"))


def snippet(body, term, around: int = 40, most: int = MAX_SNIPPET) -> Column:
    """The first place of the term with what stands around it, cut at ``most`` characters."""
    at = F.instr(F.lower(body), F.lower(term))
    return F.when(at > 0, F.substring(body, F.greatest(at - around, F.lit(1)), F.least(F.length(term) + 2 * around, F.lit(most))))
