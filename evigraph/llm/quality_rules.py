"""Quality rules as a bitmask ledger, in DataFrame functions only.

``evaluate`` runs every rule once per document and stores the measurements and
one failure bit per rule.  ``apply_policy`` turns a versioned policy (a set of
rule names) into a verdict by one bitwise AND over the stored ledger, and
``ablation`` tells from the grouped bit patterns what each rule of a policy
removes in all and alone.  Neither reads a text again.

Edge cases: a null text counts as empty, and an empty text has all measurements
0 and fails ``few_words``.  Repeated rows are judged each on their own.  Columns
of the input other than ``doc_id`` and ``text`` are ignored, so clashing names
do no harm; an empty table gives an empty ledger.  A window of five words is
compared by a 64-bit hash of its words within one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, documents, whole_text, word_array

WINDOW = 5

#: name, SQL predicate over the measurements that is true when the rule fails.
#: The position in this list is the bit; new rules are appended, never inserted.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("repeated_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
]

#: version: rules whose failure drops a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting"),
}

MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row.

    The work is done in steps, each a projection over arrays that the step
    before has made, so that no lambda evaluates a split or a hash again.
    """
    text = docs.select("doc_id", whole_text().alias("_t"))
    words = text.select("doc_id", "_t", word_array(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    hashed = words.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    at = ", ".join(f"_h[i + {k}]" if k else "_h[i]" for k in range(WINDOW))
    windows = hashed.select(*kept, F.expr(f"CASE WHEN size(_h) < {WINDOW} THEN array() ELSE transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64({at})) END").alias("_g"))
    # Only documents with a repeated window pay for the sort.
    pairs = windows.select(*kept, F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN sort_array(transform(_g, (h, i) -> struct(h, i))) ELSE array() END").alias("_s"))
    twice = pairs.select(*kept, F.expr("sort_array(transform(filter(_s, (x, j) -> (j > 0 AND get(_s, j - 1).h = x.h) OR (j + 1 < size(_s) AND get(_s, j + 1).h = x.h)), x -> x.i))").alias("_p"))
    covered = f"aggregate(_p, named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(p, a.e), 'e', p + {WINDOW}), a -> a.n)"
    return twice.select(*kept, F.expr(covered).alias("n_repeat_words"))


def evaluate(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, measurements, fail_bits (bit i set: rule i fails)."""
    bits = " | ".join(f"CASE WHEN {test} THEN {1 << i}L ELSE 0L END" for i, (_, test) in enumerate(RULES))
    return measure(docs).select("doc_id", *MEASUREMENTS, F.expr(bits).alias("fail_bits"))


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that only it drops, rows kept without it.

    One aggregation to at most 2^rules bit patterns; the rest is arithmetic on those.
    """
    names, whole = [name for name, _ in RULES], mask(policy)
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("x")
    each = patterns.select("bits", "n", rules).select("bits", "n", "x.rule", "x.bit")
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).alias
    return each.groupBy("rule").agg(count(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"), count(F.col("bits") == F.col("bit"))("failed_alone"), count(without == 0)("kept_without"))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written once; policies and ablations read it and not the texts."""
    return Scratch(docs.sparkSession, "quality-ledger").table(evaluate(docs), "ledger")


def op10_quality_rules(spark, sf_dir) -> DataFrame:
    ledger = apply_policy(stored(documents(spark, sf_dir)), "base").withColumn("base_failed", ~F.col("kept"))
    return apply_policy(ledger, "v1").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablation(spark, sf_dir) -> DataFrame:
    """Both policies' ablations from one stored ledger."""
    ledger = stored(documents(spark, sf_dir))
    of = lambda policy: ablation(ledger, policy).withColumn("policy", F.lit(policy))
    return of("base").unionByName(of("v1"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END)
      + (CASE WHEN n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
      + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END)
      + (CASE WHEN 100 * n_upper > 50 * word_chars THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

QUALITY_ABLATION_SQL = (
    "WITH l AS ("
    + OP10_SQL.strip()
    + """), r(policy, whole, rule, bit) AS (VALUES ('base', 3, 'few_words', 1), ('base', 3, 'repeated_windows', 2), ('v1', 63, 'few_words', 1), ('v1', 63, 'repeated_windows', 2),
  ('v1', 63, 'symbols', 4), ('v1', 63, 'repeated_lines', 8), ('v1', 63, 'word_length', 16), ('v1', 63, 'shouting', 32))
SELECT policy, rule, CAST(sum(CASE WHEN fail_bits & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN fail_bits & whole = bit THEN 1 ELSE 0 END) AS BIGINT) AS failed_alone,
  CAST(sum(CASE WHEN fail_bits & (whole - bit) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept_without FROM l, r GROUP BY policy, rule"""
)
