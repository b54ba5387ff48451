"""Line dedup by a segment-partition edit join, in DataFrame functions only.

The edit distance at which two lines link follows the length of the shorter one: nothing but
equality below 12 code points, 1 from there on, 2 from 40 (``THRESHOLDS``).  Each distinct line is cut into
one segment more than its threshold.  Two lines within the distance agree in a segment of the
shorter one, at a place that the multi-match-aware windows of the longer one bound, so the join key
is a hash of (length, segment number, segment).  A pair must also have nearly the same
counts of ten letters, whose sum of differences an edit changes by at most two; this is part
of the join condition, so that pairs of a crowded segment don't leave the join.
Candidates are verified by a banded bit-parallel edit distance.

A line is dropped when an equal line, or a distinct line linked to it, occurs
earlier (by doc_id, then position).  Lines without a word are never dropped.

Equal lines are found by a 64-bit hash and told apart by a second one: in the
event of a collision the later line is kept.  Row numbers tell repeated rows apart; they are written with
the rows unless ``stored`` says that the documents are read straight from files.  Edge cases: null text counts as
empty (one empty line); repeated rows are documents of their own, and the later one loses its lines; other
columns are ignored; an empty table gives an empty result.  A null doc_id sorts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, documents, fresh, numbered, whole_text

#: (least code points of the shorter line, edits), by falling length.
THRESHOLDS = ((40, 2), (12, 1))


def lines_of(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, pos, line, h1, h2) of every line with a word in rows (rid, doc_id, text)."""
    rows = rows.select("rid", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, place, sig, line, copies): each distinct line at its first place (doc_id, pos, rid).  Copies meet before the shuffle."""
    first = lines.groupBy("h1").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "pos", "rid", "h2", F.expr(SIGNATURE).alias("sig"), "line")).alias("f"))
    return first.select("h1", F.col("f.h2").alias("h2"), F.struct("f.doc_id", "f.pos", "f.rid").alias("place"), F.col("f.sig").alias("sig"), F.col("f.line").alias("line"), "copies").where("copies > 0")  # always true: so every reader needs the count, and all share one shuffle


def meeting_places(edits: int) -> list[tuple[bool, int, int, int]]:
    """(probes, d, i, shift): a line meets segment i of lines of d characters less, at its own place moved by shift; its own segments come first."""
    own = [(False, 0, i, 0) for i in range(1, edits + 2)]
    return own + [
        (True, d, i, shift)
        for d in range(edits + 1)
        for i in range(1, edits + 2)
        for shift in range(max(-(i - 1), d - (edits + 1 - i)), min(i - 1, d + (edits + 1 - i)) + 1)
        if d or shift  # a line's own segments serve as these probes
    ]


def keys(sized: DataFrame, probes: bool, thresholds=THRESHOLDS) -> DataFrame:
    """(h, sig, key) of a line's own segments, or of the places where it meets those of lines up to its length.

    The places are constant arrays, so that one small expression makes the key of each; a line takes
    those of every threshold that lines of its length, or a little less, have.
    """
    place = lambda k, d, i, shift: F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift"))
    parts, high = [], None
    for least, edits in thresholds:
        mine = F.array(*[place(edits + 1, d, i, shift) for side, d, i, shift in meeting_places(edits) if side == probes])
        reach = F.col("n") >= least if high is None else (F.col("n") >= least) & (F.col("n") < high + edits)
        parts.append(F.when(reach, mine).otherwise(F.array().cast(PLACES)))
        high = least
    bounds = " OR ".join(f"m.k = {edits + 1} AND n - m.d >= {least}" + (f" AND n - m.d < {above}" if above else "") for (least, edits), above in zip(thresholds, [None, *[t[0] for t in thresholds]], strict=False))
    each = sized.select("h1", "sig", "line", "n", F.explode(F.concat(*parts)).alias("m")).where(bounds)
    each = each.select("h1", "sig", "line", "n", F.col("m.k").alias("k"), (F.col("n") - F.col("m.d")).alias("length"), F.col("m.i").alias("i"), F.col("m.shift").alias("shift"))
    each = each.withColumn("longer", F.expr("k - length % k"))  # segments from this one on have one character more
    each = each.withColumn("start", F.expr("(i - 1) * (length DIV k) + 1 + greatest(0, i - 1 - longer) + shift")).withColumn("size", F.expr("length DIV k + CASE WHEN i > longer THEN 1 ELSE 0 END"))
    return each.where("start >= 1 AND start + size - 1 <= n").select(F.col("h1").alias("h"), "sig", F.expr("xxhash64(length, i, substr(line, CAST(start AS INT), CAST(size AS INT)))").alias("key"))


PLACES = "array<struct<k:int,d:int,i:int,shift:int>>"


#: The letters counted in a line's signature, five bits each.
LETTERS = "etaonirshd"
SIGNATURE = " | ".join(f"shiftleft(cast((octet_length(line) - octet_length(replace(line, '{c}', ''))) & 31 AS BIGINT), {5 * k})" for k, c in enumerate(LETTERS))


def count_gap(a: str, b: str) -> str:
    """SQL of the sum of differences of two signatures, each on a circle of 32; one edit changes it by at most two."""
    gaps = [f"abs((shiftright({a}, {5 * k}) & 31) - (shiftright({b}, {5 * k}) & 31))" for k in range(len(LETTERS))]
    return " + ".join(f"least({gap}, 32 - {gap})" for gap in gaps)


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def banded_distance(text: str, pattern: str, edits: int) -> str:
    """SQL of the edit distance of two arrays of characters, exact up to ``edits``; text is the longer by 0 to ``edits``.

    Bit r of the vectors stands for row ``column - edits + r`` of the table, so the
    band moves down by one each column and fits a few bits (Hyyrö's form of Myers' algorithm).
    The distance is summed along the diagonal that ends in the last cell.
    """
    band = (1 << (2 * edits + 1)) - 1
    apart = f"(size({text}) - size({pattern}))"
    match = " | ".join(f"CASE WHEN j - {edits + 1} + {r} >= 0 AND get({pattern}, j - {edits + 1} + {r}) = get({text}, j - 1) THEN {1 << r} ELSE 0 END" for r in range(2 * edits + 1))
    down = f"named_struct('vp', (hn | ~(shiftright(d, 1) | hp)) & {band}, 'vn', shiftright(d, 1) & hp, 'n', v.n + CASE WHEN j > {apart} AND shiftright(d, {edits} - {apart}) & 1 = 0 THEN 1 ELSE 0 END)"
    step = _let("m", f"({match})", _let("d", f"(((((m & v.vp) + v.vp) ^ v.vp) | m | v.vn) & {band})", _let("hp", f"((v.vn | ~(d | v.vp)) & {band})", _let("hn", "(d & v.vp)", down))))
    return f"aggregate(sequence(1, size({text})), named_struct('vp', {band & ~((1 << edits) - 1)}, 'vn', 0, 'n', {apart}), (v, j) -> {step}, v -> v.n)"


def links(distinct: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(a, b, place_a, place_b): all pairs of distinct lines within the edit distance, by h1; each pair once."""
    edits = max(e for _, e in thresholds)
    sized = distinct.select("h1", "sig", "line", F.length("line").alias("n")).where(F.col("n") >= min(n for n, _ in thresholds))
    side = lambda probes, h: keys(sized, probes, thresholds).select(F.col("h").alias(h), F.col("sig").alias(f"sig_{h}"), F.col("key").alias(f"key_{h}"))
    near = (F.col("key_a") == F.col("key_b")) & F.expr(f"{count_gap('sig_a', 'sig_b')} <= {2 * edits}")
    same = side(False, "a").join(side(False, "b"), near & (F.col("a") > F.col("b"))).select("a", "b")
    moved = side(True, "a").join(side(False, "b"), near & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = same.unionByName(moved).distinct()
    side = lambda name: distinct.select(F.col("h1").alias(name), F.col("place").alias(f"place_{name}"), F.col("line").alias(f"line_{name}"))
    texts = pairs.join(side("a"), "a").join(side("b"), "b")
    longer = "length(line_a) >= length(line_b)"
    split = lambda first, second: f"split(CASE WHEN {longer} THEN {first} ELSE {second} END, '')"
    distance = _let("t", split("line_a", "line_b"), _let("p", split("line_b", "line_a"), banded_distance("t", "p", edits)))  # bound, so that no step splits again
    allowed = "CASE " + " ".join(f"WHEN least(length(line_a), length(line_b)) >= {least} THEN {e}" for least, e in thresholds) + " END"
    return texts.where(F.expr(f"{distance} <= {allowed}")).select("a", "b", "place_a", "place_b")


def judged(docs: DataFrame, thresholds=THRESHOLDS, stored: bool = False) -> DataFrame:
    """(rid, pos, n_links, dropped) of every line with a word; rid numbers the rows of docs."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return judged_rows(numbered(rows, "rid", None if stored else scratch), scratch, thresholds)


def judged_rows(rows: DataFrame, scratch: Scratch, thresholds=THRESHOLDS) -> DataFrame:
    """(rid, pos, n_links, dropped) of every line with a word in rows (rid, doc_id, text)."""
    lines = lines_of(rows)
    distinct = distinct_lines(lines)
    found = links(distinct, thresholds)
    ends = F.explode(F.array(F.struct(F.col("a").alias("h1"), F.col("place_b").alias("other")), F.struct(F.col("b").alias("h1"), F.col("place_a").alias("other"))))
    both = found.select(ends.alias("x")).select("x.h1", "x.other")  # one pass: a union would verify every pair twice
    linked = both.groupBy("h1").agg(F.count("*").alias("n_links"), F.min("other").alias("other"))
    told = distinct.join(linked, "h1", "left").where("copies > 1 OR n_links IS NOT NULL")  # of the other lines there is nothing to tell
    told = told.select(F.col("h1").alias("k"), F.col("h2").alias("k2"), F.col("place.pos").alias("at"), F.col("place.rid").alias("of"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("other") < F.col("place"), F.lit(False)).alias("late"))
    told = scratch.table(told, "told")  # both sides of the join are then plain shuffles, whose hot partitions the skew join can split
    placed = lines.select("rid", "pos", "h1", "h2").join(told, F.col("h1") == F.col("k"), "left")
    again = (F.col("pos") != F.col("at")) | (F.col("rid") != F.col("of"))
    same = F.coalesce(F.col("h2") == F.col("k2"), F.lit(False))
    return placed.select("rid", "pos", F.when(same, F.col("n_links")).otherwise(0).alias("n_links"), (same & (again | F.col("late"))).alias("dropped"))


def deduped(docs: DataFrame, thresholds=THRESHOLDS, stored: bool = False) -> DataFrame:
    """The documents (all their columns) without their dropped lines; documents that lose every line with a word go.

    Documents without any word stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rid, drop, total, lines, new = (fresh(docs, c) for c in ("__rid", "__drop", "__total", "__all", "__new"))
    base = numbered(docs, rid, None if stored else scratch)
    found = judged_rows(base.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), scratch, thresholds)
    flags = found.groupBy(F.col("rid").alias(rid)).agg(F.sort_array(F.collect_list(F.when(F.col("dropped"), F.col("pos")))).alias(drop), F.count("*").alias(total))  # positions of one document
    rows = base.join(flags, rid, "left")
    rows = rows.where(F.col(total).isNull() | (F.size(drop) < F.col(total)))
    # The kept stretches between dropped positions are slices, so the work is linear in the lines.
    cut = F.expr(f"array_join(flatten(transform(sequence(0, size({drop})), i -> slice({lines}, CASE WHEN i = 0 THEN 1 ELSE {drop}[i - 1] + 2 END, CASE WHEN i = size({drop}) THEN size({lines}) ELSE {drop}[i] END - CASE WHEN i = 0 THEN 0 ELSE {drop}[i - 1] + 1 END))), '\n')")
    changed = rows.withColumn(lines, F.split(whole_text(), "\n", -1)).withColumn(new, F.when(F.coalesce(F.size(drop), F.lit(0)) > 0, cut).otherwise(F.col("text")))
    return changed.select(*[F.col(new).alias("text") if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark, sf_dir) -> DataFrame:
    """One row per document: lines with a word, how many of them are dropped and linked, and the dropped line numbers."""
    docs = documents(spark, sf_dir)
    flags = judged(docs, stored=True).groupBy(F.col("rid").alias("k")).agg(
        F.count("*").alias("n_lines"), F.sum("n_links").alias("n_links"), F.count_if("dropped").alias("n_dropped"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("dropped"), F.col("pos")))), lambda x: x.cast("string")), ",").alias("dropped"),
    )
    rows = numbered(docs.select("doc_id"), "rid", None)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(flags, F.col("rid") == F.col("k"), "left").select("doc_id", zero("n_lines"), zero("n_links"), zero("n_dropped"), F.coalesce("dropped", F.lit("")).alias("dropped"))


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT line, length(line) AS n, min({{'d': doc_id, 'p': pos, 'r': rid}}) AS place FROM w GROUP BY line),
v AS (SELECT *, CASE WHEN n >= 40 THEN 2 ELSE 1 END AS e, CASE WHEN n >= 40 THEN 3 ELSE 2 END AS k FROM u WHERE n >= 12),
g3 AS (SELECT *, substr(line, 1, n // k) AS s1, substr(line, n // k + 1, n // k) AS s2, substr(line, (k - 1) * (n // k) + 1) AS s3 FROM v),
p AS (SELECT a.line AS a, b.line AS b, a.place AS pa, b.place AS pb FROM g3 AS a JOIN g3 AS b
      ON a.n - b.n BETWEEN 0 AND b.e AND a.line <> b.line AND (a.n > b.n OR a.line > b.line)
      WHERE (contains(a.line, b.s1) OR contains(a.line, b.s2) OR contains(a.line, b.s3)) AND levenshtein(a.line, b.line) <= b.e),
k AS (SELECT line, count(*) AS n_links, min(other) AS other FROM (SELECT a AS line, pb AS other FROM p UNION ALL SELECT b, pa FROM p) GROUP BY line),
j AS (SELECT w.rid, w.pos, coalesce(k.n_links, 0) AS n_links, (u.place <> {{'d': w.doc_id, 'p': w.pos, 'r': w.rid}}) OR coalesce(k.other < u.place, false) AS dropped
      FROM w JOIN u USING (line) LEFT JOIN k USING (line)),
g AS (SELECT rid, count(*) AS n_lines, sum(n_links) AS n_links, count(*) FILTER (WHERE dropped) AS n_dropped,
      string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE dropped) AS dropped FROM j GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, coalesce(dropped, '') AS dropped
FROM d LEFT JOIN g USING (rid)
"""
