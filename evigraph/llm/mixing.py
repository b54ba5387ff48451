"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points, mapped through the cumulative target shares, name the
source of every slot.  Slots are ranked per source; the documents of a source,
shuffled by a hash, are cut into blocks of equally many tokens; slot number r of
a source takes its block ``r mod blocks`` in epoch ``r div blocks``.  The mix is the
blocks in the order of the slots: one row per slot and span of a document.

Ranks and running sums never gather a source in one task: slots are counted per
stretch of the schedule and documents per hash prefix, only those counts are
summed over a source, and ranks within stretches and prefixes are added.

Edge cases: null text has size 0; a document of size 0 takes nothing; a null
source is a source of its own, the last; repeated rows are documents of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.llm.common import Scratch, documents, fresh, numbered, whole_text

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK_TOKENS = 512
STRETCH = 1 << 16
GOLDEN = 0x9E3779B97F4A7C15  # 2^64 / golden ratio, odd


def water_fill(sizes: list[int], weights: list[float], most: int = MAX_EPOCHS) -> list[float]:
    """Targets that sum to all sizes in proportion to the weights, none above ``most`` times its size."""
    left, total, target = set(range(len(sizes))), float(sum(sizes)), [0.0] * len(sizes)
    while left:
        share = total / sum(weights[i] for i in left)
        full = [i for i in left if share * weights[i] >= most * sizes[i]]
        if not full:
            for i in left:
                target[i] = share * weights[i]
            break
        for i in full:
            target[i] = float(most * sizes[i])
            total -= target[i]
            left.remove(i)
    return target


def sized(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """(rid, doc_id, source, size, key): key is the shuffling hash; rid numbers the rows, if it isn't given."""
    rid = F.monotonically_increasing_id() if rid is None else rid
    words = F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(rid.alias("rid"), "doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"))


def source_plan(rows: DataFrame, weights=WEIGHTS, most: int = MAX_EPOCHS, block: int = BLOCK_TOKENS) -> list[dict]:
    """One entry per source (as many as the table has sources), in the order of their names: index, size, target, tokens to take, blocks, slots."""
    found = {r.source: r.size for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted(found, key=lambda s: (s is None, s or ""))
    targets = water_fill([found[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], most)
    plan = []
    for i, (name, target) in enumerate(zip(names, targets, strict=True)):
        size, take = found[name], min(int(target), most * found[name])
        blocks = max(1, math.ceil(size / block))
        epochs = take // size if size else 0
        slots = epochs * blocks + (math.ceil((take - epochs * size) / block) if size else 0)
        plan.append({"i": i, "source": name, "size": size, "target": target, "take": take, "blocks": blocks, "slots": slots})
    return plan


def slot_sources(first: int, n: int, shares: np.ndarray) -> np.ndarray:
    """Index of the source of the slots first .. first + n - 1."""
    points = np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    u = (points >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.minimum(np.searchsorted(shares, u, "right"), len(shares) - 1)


def schedule(spark, plan: list[dict], block: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, i, rank): the slots of the mix, ranked per source from 0.

    A source that comes a few slots short of its need gets them after the last point.
    """
    total = sum(p["target"] for p in plan)
    n = math.ceil(total / block)
    schema = "slot long, i int, rank long"
    if not n:
        return spark.createDataFrame([], schema)
    shares = np.cumsum([p["target"] for p in plan]) / total
    needs = np.array([p["slots"] for p in plan], np.int64)
    stretches = math.ceil(n / STRETCH)
    frame = spark.range(0, stretches, 1, min(stretches, 4096))
    span = lambda s: (s * STRETCH, min(STRETCH, n - s * STRETCH))

    def count(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                got = np.bincount(slot_sources(*span(s), shares), minlength=len(shares))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), s)), pa.array(np.arange(len(got)), pa.int32()), pa.array(got, pa.int64())], names=["stretch", "i", "n"])

    counts = frame.mapInArrow(count, "stretch long, i int, n long")
    before = W.partitionBy("i").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per_stretch = offsets.groupBy("stretch").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "before"))), lambda x: x["before"]).alias("before"))  # one number a source

    def slots(batches):
        for batch in batches:
            for s, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = slot_sources(*span(s), shares)
                order = np.argsort(i, kind="stable")
                starts = np.searchsorted(i[order], np.arange(len(shares)))
                rank = np.empty(len(i), np.int64)
                rank[order] = np.arange(len(i)) - starts[i[order]]
                rank += np.array(base, np.int64)[i]
                keep = rank < needs[i]
                yield pa.RecordBatch.from_arrays([pa.array((np.arange(len(i)) + s * STRETCH)[keep]), pa.array(i[keep].astype(np.int32)), pa.array(rank[keep])], names=["slot", "i", "rank"])

    planned = per_stretch.mapInArrow(slots, schema)
    need = spark.createDataFrame([(p["i"], p["slots"]) for p in plan], "i int, slots long")
    short = counts.groupBy("i").agg(F.sum("n").alias("n")).join(need, "i").where("n < slots")
    late = short.select("i", "n", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("rank"))
    return planned.unionByName(late.select((F.lit(n) + (F.col("rank") - F.col("n")) * len(plan) + F.col("i")).alias("slot"), "i", "rank"))  # in turn, each slot once


def placed(rows: DataFrame, plan: list[dict]) -> DataFrame:
    """rows with i and start: where the document begins among the shuffled tokens of its source."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(p["i"], p["source"]) for p in plan], "i int, name string")
    named = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("prefix", F.substring("key", 1, 3))
    sums = named.groupBy("i", "prefix").agg(F.sum("size").alias("n"))
    sums = sums.select("i", "prefix", F.coalesce(F.sum("n").over(W.partitionBy("i").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("i", "prefix").orderBy("key", "doc_id", "size", "rid").rowsBetween(W.unboundedPreceding, -1)
    within = named.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(sums, ["i", "prefix"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "prefix")


def scheduled(rows: DataFrame, plan: list[dict], block: int = BLOCK_TOKENS) -> DataFrame:
    """slot, at, rid, doc_id, source, first, last: the mix, in the order of slot and at.

    In each slot the words first .. last - 1 of a document are taken; at is where they
    begin among the shuffled words of the source.
    """
    spark = rows.sparkSession
    facts = spark.createDataFrame([(p["i"], p["size"], p["take"], p["blocks"], p["slots"]) for p in plan], "i int, all long, take long, blocks long, slots long")
    slots = schedule(spark, plan, block).join(facts, "i")
    # The last slot of a source is cut so that the source meets its target.
    cut = F.when(F.col("rank") == F.col("slots") - 1, F.col("take") - F.expr("rank DIV blocks") * F.col("all") - (F.col("rank") % F.col("blocks")) * block)
    uses = slots.select("slot", "i", (F.col("rank") % F.col("blocks")).alias("b"), F.coalesce(cut, F.lit(block)).alias("width"))
    spread = F.explode(F.sequence(F.expr(f"start DIV {block}"), F.expr(f"(start + size - 1) DIV {block}")))
    parts = placed(rows, plan).where("size > 0").withColumn("b", spread).join(uses, ["i", "b"])
    low, high = F.greatest(F.col("start"), F.col("b") * block), F.least(F.col("start") + F.col("size"), F.col("b") * block + F.col("width"))
    return parts.where(high > low).select("slot", low.alias("at"), "rid", "doc_id", "source", (low - F.col("start")).alias("first"), (high - F.col("start")).alias("last"))


def taken(rows: DataFrame, plan: list[dict], block: int = BLOCK_TOKENS) -> DataFrame:
    """rid, doc_id, source, size, i, taken: the words that the scheduled blocks take from each document, repeats counted.

    starts has the (slot, at) of every time that the mix begins the document, in order.
    """
    names = rows.sparkSession.createDataFrame([(p["i"], p["source"]) for p in plan], "i int, name string")
    begin = F.when(F.col("first") == 0, F.struct("slot", "at"))
    sums = scheduled(rows, plan, block).groupBy("rid").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.array_sort(F.collect_list(begin)).alias("starts"))  # as many as epochs at most
    named = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).select("rid", "doc_id", "source", "size", "i")
    return named.join(sums, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MAX_EPOCHS, block: int = BLOCK_TOKENS, rid: Column | None = None) -> tuple[DataFrame, list[dict]]:
    """(taken rows, plan of the sources)."""
    rows = Scratch(docs.sparkSession, "mix").table(sized(docs, rid), "rows")
    plan = source_plan(rows, weights, most, block)
    if not plan:
        return rows.withColumn("i", F.lit(0)).withColumn("taken", F.lit(0).cast("long")).drop("key"), plan
    return taken(rows, plan, block), plan


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MAX_EPOCHS, block: int = BLOCK_TOKENS, stored: bool = False) -> DataFrame:
    """The documents (all their columns) as often as the mix takes them, to the nearest whole number; a document that it takes less than half of goes.

    They are sorted by the slots in which the mix begins them.  Rows are numbered once, unless ``stored`` says that they are
    read straight from files.
    """
    rid, starts, start = (fresh(docs, c) for c in ("__rid", "__starts", "__start"))
    base = numbered(docs, rid, None if stored else Scratch(docs.sparkSession, "mix"))
    rows, plan = mix(base, weights, most, block, F.col(rid))
    if not plan:
        return docs
    times = F.expr("CAST(floor(taken / size + 0.5) AS INT)")
    wanted = rows.where("size > 0").select(F.col("rid").alias(rid), F.slice("starts", F.lit(1), times).alias(starts)).where(F.size(starts) > 0)
    again = base.join(wanted, rid).withColumn(start, F.explode(starts))
    return again.sort(f"{start}.slot", f"{start}.at", rid).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, sf_dir) -> DataFrame:
    rows, plan = mix(documents(spark, sf_dir))
    facts = spark.createDataFrame([(p["i"], p["size"], float(p["target"])) for p in plan], "i int, source_size long, target double")
    return rows.join(facts, "i").select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
s1 AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY 3 * size / w, i) AS k FROM s1),
s3 AS (SELECT *, (sum(size) OVER () - coalesce(sum({MAX_EPOCHS} * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s2),
s4 AS (SELECT *, coalesce((SELECT min(k) FROM s3 AS x WHERE x.share * x.w < {MAX_EPOCHS} * x.size), 1000000000) AS free FROM s3),
s5 AS (SELECT i, source, size, CASE WHEN k < free THEN ({MAX_EPOCHS} * size)::DOUBLE ELSE (SELECT share FROM s3 AS x WHERE x.k = s4.free) * w END AS target FROM s4),
s6 AS (SELECT *, least(CAST(floor(target) AS BIGINT), {MAX_EPOCHS} * size) AS take, greatest(1, (size + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) AS blocks FROM s5),
s AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE take // size * blocks + (take - take // size * size + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS} END AS slots,
        sum(target) OVER (ORDER BY i) / sum(target) OVER () AS upto FROM s6),
p AS (SELECT j, ((((j + 1)::HUGEINT * {GOLDEN}::HUGEINT) % 18446744073709551616::HUGEINT) // 2048)::DOUBLE / 9007199254740992.0::DOUBLE AS u
      FROM range(0, (SELECT CAST(ceil(sum(target) / {BLOCK_TOKENS}) AS BIGINT) FROM s)) AS r(j)),
q AS (SELECT j, (SELECT coalesce(min(i), (SELECT max(i) FROM s)) FROM s WHERE s.upto > p.u) AS i FROM p),
r1 AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS rank FROM q),
c AS (SELECT i, count(*) AS n FROM r1 GROUP BY i),
r2 AS (SELECT r1.i, r1.rank FROM r1 JOIN s USING (i) WHERE rank < slots
       UNION ALL SELECT s.i, unnest(range(coalesce(c.n, 0), s.slots)) FROM s LEFT JOIN c USING (i)),
u AS (SELECT i, rank % blocks AS b, CAST(count(*) FILTER (WHERE rank < slots - 1) AS BIGINT) AS whole,
        coalesce(max(CASE WHEN rank = slots - 1 THEN take - rank // blocks * size - rank % blocks * {BLOCK_TOKENS} END), 0) AS cut
      FROM r2 JOIN s USING (i) GROUP BY ALL),
o AS (SELECT d.*, s.i, s.size AS source_size, s.target, coalesce(sum(d.size) OVER (PARTITION BY s.i ORDER BY key, doc_id, d.size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
x AS (SELECT o.*, unnest(CASE WHEN size > 0 THEN range(CAST(a // {BLOCK_TOKENS} AS BIGINT), CAST((a + size - 1) // {BLOCK_TOKENS} + 1 AS BIGINT)) ELSE [-1] END) AS b FROM o)
SELECT doc_id, x.size, source_size, target, CAST(sum(CASE WHEN x.b < 0 THEN 0 ELSE
    (least(a + x.size, (x.b + 1) * {BLOCK_TOKENS}) - greatest(a, x.b * {BLOCK_TOKENS})) * coalesce(whole, 0)
    + greatest(0, least(a + x.size, (x.b + 1) * {BLOCK_TOKENS}, x.b * {BLOCK_TOKENS} + coalesce(cut, 0)) - greatest(a, x.b * {BLOCK_TOKENS})) END) AS BIGINT) AS taken
FROM x LEFT JOIN u ON u.i = x.i AND u.b = x.b GROUP BY rid, doc_id, x.size, source_size, target
"""
