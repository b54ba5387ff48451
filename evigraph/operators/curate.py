"""Curation: dedup, conflicts, entity resolution, mentions, proposals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.constants import DUPLICATE_SIMILARITY, RESOLUTION_MARGIN
from evigraph.functions import text as T
from evigraph.functions.scratch import Scratch
from evigraph.functions import vector as V


def dedup_claims(claims: DataFrame) -> DataFrame:
    """Active claims by (subject, normalized hash): the least id stays, with the evidence of all copies in order."""
    hashed = claims.where("lifecycle_status = 'active'").withColumn("normalized_hash", T.normalized_hash(F.col("statement")))
    evidence = hashed.select("subject", "normalized_hash", "evidence_id").where("evidence_id IS NOT NULL").distinct()
    gathered = evidence.groupBy("subject", "normalized_hash").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))  # the evidence of one claim
    merged = hashed.groupBy("subject", "normalized_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return merged.join(gathered, ["subject", "normalized_hash"], "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def semantic_hash(assertions: DataFrame, *meaning: str) -> DataFrame:
    """Adds semantic_hash: of the named columns (a statement or endpoints, qualifiers as a map, statuses) and of evidence_ids in order; not of times, paths or layout."""
    kinds = dict(assertions.dtypes)
    canonical = lambda c: T.canonical_map(F.col(c)) if kinds[c].startswith("map") else F.col(c).cast("string")
    part = lambda x: F.coalesce(x, F.lit("\x1e"))
    bound = F.array_join(F.array_sort(F.array_distinct("evidence_ids")), ",")
    return assertions.withColumn("semantic_hash", F.sha2(F.concat_ws("\x1f", *[part(canonical(c)) for c in meaning], part(bound)), 256))


def possible_duplicates(new: DataFrame, known: DataFrame, similarity: float = DUPLICATE_SIMILARITY, k: int = 10) -> DataFrame:
    """(id, other, score): the ``k`` nearest known claims (subject, id, v) of each new one (id, subject, v) that have its subject and at least the similarity.

    One plan for all subjects, exact, in cells of a subject; nothing is merged.
    """
    near = V.knn_within(known.select(F.col("subject").alias("by"), "id", "v"), new.select(F.col("subject").alias("by"), F.col("id").alias("qid"), F.col("v").alias("qv")), k, similarity)
    return near.select(F.col("qid").alias("id"), F.col("id").alias("other"), "score")


def conflicts(claims: DataFrame) -> DataFrame:
    """(subject, qualifier, id, polarity, side, size) of claims whose subject and qualifier have claims of another polarity.

    Every two members of different polarity contradict each other; they are given as the members of a group with its sides, named by their
    least id and with how many claims they have, and not pair by pair.
    """
    sides = claims.groupBy("subject", "qualifier", "polarity").agg(F.min("id").alias("side"), F.count("*").alias("size"))
    groups = sides.groupBy("subject", "qualifier").agg(F.count("*").alias("n")).where("n > 1").select("subject", "qualifier")
    told = sides.join(groups, ["subject", "qualifier"], "left_semi")
    return claims.select("subject", "qualifier", "polarity", "id").join(told, ["subject", "qualifier", "polarity"]).select("subject", "qualifier", "id", "polarity", "side", "size")


def merge_relations(relations: DataFrame) -> DataFrame:
    """Relations of the same ends, predicate and qualifiers (a map is taken in canonical form) as one."""
    if dict(relations.dtypes)["qualifiers"].startswith("map"):
        relations = relations.withColumn("qualifiers", T.canonical_map(F.col("qualifiers")))
    return relations.groupBy("source", "predicate", "target", "qualifiers").agg(F.min("id").alias("id"), F.count("*").alias("merged"), F.countDistinct("evidence_id").alias("n_evidence"))


def resolve_mentions(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Adds outcome and target to mentions (surface): one node by name or alias (names: name, node_id) is a mention, none unresolved, several ambiguous."""
    node = "node" if "node" in names.columns else "node_id"
    known = names.groupBy(T.normalize_name(F.col("name")).alias("k")).agg(F.countDistinct(node).alias("n"), F.min(node).alias("node"))
    joined = mentions.join(known, T.normalize_name(F.col("surface")) == F.col("k"), "left")
    outcome = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "mentions").otherwise("ambiguous")
    return joined.withColumn("outcome", outcome).withColumn("target", F.when(F.col("n") == 1, F.col("node"))).drop("k", "n", "node")


def link_mentions(bodies: DataFrame, names: DataFrame) -> DataFrame:
    """(node_id, surface, outcome, target) of the [[links]] in the bodies (node_id, body), each once a body."""
    links = bodies.select("node_id", F.explode(F.array_distinct(T.node_links(F.col("body")))).alias("surface"))
    return resolve_mentions(links, names.select("name", F.col("node_id").alias("node"))).select("node_id", "surface", "outcome", "target")


def resolve_entities(mentions: DataFrame, channels: list[DataFrame], margin: float = RESOLUTION_MARGIN) -> DataFrame:
    """(mention_id, decision, target): candidates (mention_id, node_id, score) by falling priority.

    The first channel with a candidate decides; two best candidates within the margin are ambiguous.
    """
    union = None
    for i, channel in enumerate(channels):
        part = channel.select("mention_id", "node_id", "score", F.lit(i).alias("priority"))
        union = part if union is None else union.unionByName(part)
    decided = settle(union.withColumn("least", F.min("priority").over(W.partitionBy("mention_id"))).where("priority = least"), margin)
    return mentions.select("mention_id").join(decided, "mention_id", "left").select("mention_id", F.coalesce("decision", F.lit("new")).alias("decision"), "target")


def equal(mentions: DataFrame, nodes: DataFrame, score: float) -> DataFrame:
    """(mention_id, node_id, score): candidates of mentions (mention_id, wanted) by an equal key (nodes: node_id, key).

    All have one score, so the first two nodes of a key tell all that ``settle`` asks: which is first, and whether there is another.
    """
    w = W.partitionBy("key").orderBy("node_id")
    first = nodes.select("node_id", "key").distinct().withColumn("i", F.row_number().over(w)).where(F.col("i") <= 2)
    return mentions.join(first, F.col("wanted") == F.col("key")).select("mention_id", "node_id", F.lit(score).alias("score"))


def settle(candidates: DataFrame, margin: float = RESOLUTION_MARGIN) -> DataFrame:
    """(mention_id, decision, target) of candidates (mention_id, node_id, score): the best one, unless the next is within the margin."""
    best = candidates.groupBy("mention_id", "node_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("mention_id").orderBy(F.desc("score"), "node_id")
    top = best.withColumn("next", F.lead("score").over(w)).withColumn("i", F.row_number().over(w)).where("i = 1")
    close = F.col("next").isNotNull() & (F.round(F.col("score") - F.col("next"), 9) < margin)
    return top.select("mention_id", F.when(close, "ambiguous").otherwise("existing").alias("decision"), F.when(~close, F.col("node_id")).alias("target"))


def cascade(mentions: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], margin: float = RESOLUTION_MARGIN) -> DataFrame:
    """(mention_id, decision, target, channel) of mentions (mention_id, which is unique, and what the steps need).

    A step is a channel's name and a function from mentions to candidates (mention_id, node_id, score); those for which it has any are decided.
    What is left after a step is a table, so that a dear channel (full text, vectors) is
    only asked for mentions that the cheap ones before it could not settle.
    """
    scratch = Scratch(mentions.sparkSession, "cascade")
    left, decided = mentions, []
    for i, (name, candidates) in enumerate(steps):
        decided.append(scratch.table(settle(candidates(left), margin).withColumn("channel", F.lit(name)), f"decided{i}"))
        left = scratch.table(left.join(decided[-1].select("mention_id"), "mention_id", "left_anti"), f"left{i}")
    out = left.select("mention_id", F.lit("new").alias("decision"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("channel"))
    for part in decided:
        out = out.unionByName(part)
    return out


def review_summary(items: DataFrame, mode: str = "strict") -> DataFrame:
    """Decisions per proposal.

    Strict mode lets it apply only when nothing is pending; relaxed mode applies what is accepted,
    if anything is.  Items marked invalid can't be accepted and count as rejected.
    """
    if mode not in ("strict", "relaxed"):
        raise ValueError(f"mode must be strict or relaxed, not {mode}")
    if "valid" in items.columns:
        items = items.withColumn("decision", F.when(F.col("valid"), F.col("decision")).otherwise("rejected"))
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return items.groupBy("proposal_id").agg(count("pending"), count("accepted"), count("rejected")).withColumn("may_apply", F.col("pending") == 0 if mode == "strict" else F.col("accepted") > 0)


def stale_proposals(proposals: DataFrame, targets: DataFrame, generation: int) -> DataFrame:
    """Adds stale: another base generation, or a target whose content hash changed since."""
    return proposals.join(targets, "target_id", "left").withColumn("stale", (F.col("base_generation") != generation) | ~F.col("before_sha256").eqNullSafe(F.col("current_sha256"))).drop("current_sha256")


def fold_patches(patches: DataFrame) -> DataFrame:
    """(target_id, state): set and remove operations (target_id, ordinal, op, key, value) applied in order to a map.

    The last operation on each key decides, which needs no sequential fold.
    """
    last = patches.groupBy("target_id", "key").agg(F.max_by(F.struct("op", "value"), "ordinal").alias("x")).where("x.op = 'set'")
    return last.groupBy("target_id").agg(T.canonical_map(F.map_from_entries(F.collect_list(F.struct("key", "x.value")))).alias("state"))
