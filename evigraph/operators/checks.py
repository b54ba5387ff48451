"""Integrity: constraints, manifests, snapshots, caches and the results of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of manifests (path, byte_size, sha256)."""
    a = before.select("path", F.col("byte_size").alias("s0"), F.col("sha256").alias("h0"))
    b = after.select("path", F.col("byte_size").alias("s1"), F.col("sha256").alias("h1"))
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when((F.col("s0") != F.col("s1")) | (F.col("h0") != F.col("h1")), "changed").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def check_violations(df: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """(table, constraint, id) of rows for which a rule is false; null counts as passed, as in SQL."""
    bad = F.explode(F.array_compact(F.array(*[F.when(~rule, name) for name, rule in rules.items()])))
    return df.select(F.lit(table).alias("table"), bad.alias("constraint"), F.col(key).cast("string").alias("id"))


def duplicate_keys(df: DataFrame, table: str, *keys: str) -> DataFrame:
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.lit(table).alias("table"), F.lit("unique(" + ",".join(keys) + ")").alias("constraint"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("id"))


def orphans(child: DataFrame, table: str, key: str, ref: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference names no parent."""
    parents = parent.select(F.col(parent_key).alias(ref)).distinct()
    return child.where(F.col(ref).isNotNull()).join(parents, ref, "left_anti").select(F.lit(table).alias("table"), F.lit(f"fk({ref})").alias("constraint"), F.col(key).cast("string").alias("id"))


def snapshot(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """(projection, n, digest): count and order-free digest of a projection, by sums over pieces of each row's SHA-256."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns]), 256)
    piece = lambda at: F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", *[F.coalesce(piece(at).cast("string"), F.lit("0")) for at in (1, 9, 17, 25)]).alias("digest")).select(F.lit(name).alias("projection"), "n", "digest")


TREE_BITS, TREE_LEVELS = 4, 4  # children of a tree node as a power of two, levels below the root


def hash_tree(df: DataFrame, key: str, *columns: str, levels: int = TREE_LEVELS) -> DataFrame:
    """(level, node, n, digest) of a projection as a tree over its keys' hashes: a node sums up the rows whose key hashes begin with it.

    The leaves come from one aggregation with partial sums, the levels above them from the leaves, so rows are read once; there are at most
    16 to the power of ``levels`` leaves, however many rows there are.  Digests are sums of row hashes (order-free, repeats counted).
    """
    row = F.xxhash64(F.struct(*[F.col(c) for c in (key, *columns)]))
    low, high = row.bitwiseAND(0xFFFFFFFF).cast("decimal(38,0)"), F.shiftrightunsigned(row, 32).cast("decimal(38,0)")
    leaf = F.shiftrightunsigned(F.xxhash64(key), 64 - TREE_BITS * levels)
    leaves = df.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"))
    above = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "leaf", "n", "low", "high")
    above = above.withColumn("node", F.expr(f"shiftrightunsigned(leaf, {TREE_BITS} * ({levels} - level))"))
    return above.groupBy("level", "node").agg(F.sum("n").alias("n"), F.concat_ws("-", F.sum("low").cast("string"), F.sum("high").cast("string")).alias("digest"))


def unequal_leaves(a: DataFrame, b: DataFrame, levels: int = TREE_LEVELS) -> list[int]:
    """The leaves in which two hash trees differ, found from the root down: only children of unequal nodes are compared."""
    nodes = [0]
    for level in range(levels + 1):
        inside = lambda t: t.where((F.col("level") == level) & F.col("node").isin(nodes)).select("node", "n", "digest")  # noqa: E731, B023
        mine, theirs = inside(a), inside(b).select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("digest").alias("d"))
        differ = mine.join(theirs, F.col("node") == F.col("other"), "full_outer").where(~F.col("n").eqNullSafe(F.col("m")) | ~F.col("digest").eqNullSafe(F.col("d")))
        found = [r[0] for r in differ.select(F.coalesce("node", "other")).collect()]
        if level == levels or not found:
            return sorted(found)
        nodes = [(x << TREE_BITS) + k for x in found for k in range(1 << TREE_BITS)]


def tree_differences(a: DataFrame, b: DataFrame, key: str, *columns: str, levels: int = TREE_LEVELS) -> DataFrame:
    """(key, side, n): rows that one projection has more often than the other (side: missing in b, or extra in b).

    Two trees of a few rows tell which ranges of key hashes differ at all; only rows of those are compared.
    """
    leaves = unequal_leaves(hash_tree(a, key, *columns, levels=levels), hash_tree(b, key, *columns, levels=levels), levels)
    leaf = F.shiftrightunsigned(F.xxhash64(key), 64 - TREE_BITS * levels)
    some = lambda df, sign: df.where(leaf.isin(leaves)).select(F.col(key).alias("key"), F.xxhash64(F.struct(*[F.col(c) for c in columns])).alias("row"), F.lit(sign).alias("sign"))
    counted = some(a, 1).unionByName(some(b, -1)).groupBy("key", "row").agg(F.sum("sign").alias("n")).where("n <> 0")
    return counted.select("key", F.when(F.col("n") > 0, "missing").otherwise("extra").alias("side"), F.abs("n").alias("n"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(missing, extra): rows only in a and only in b, repeats counted."""
    return a.exceptAll(b).agg(F.count("*").alias("missing")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("extra")))  # one row each


def cache_lookup(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds outcome: hit only if the stored product still has the expected hash."""
    joined = wanted.join(manifest, "cache_key", "left")
    return joined.withColumn("outcome", F.when(F.col("expected_hash").isNull(), "miss").when(F.col("expected_hash") == F.col("actual_hash"), "hit").otherwise("damaged")).drop("expected_hash", "actual_hash")


def doctor(checks: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """(check, ok, optional, violations) from DataFrames that hold what each check found."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), (F.col("violations") == 0).alias("ok"), F.lit(optional).alias("optional"), "violations") for name, df, optional in checks]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def exit_code(results: DataFrame) -> DataFrame:
    return results.agg(F.when(F.bool_or(~F.col("ok") & ~F.col("optional")), 1).otherwise(0).alias("exit_code"))
