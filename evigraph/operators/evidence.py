"""Evidence: locate and verify quotes, repair locators, assemble bundles, check citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.constants import MAX_BUNDLE, MAX_PAGE, MAX_QUOTE, REPAIR_WINDOW
from evigraph.functions import text as T
from evigraph.functions.scratch import Scratch

_KEY = 4


def locate(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, text_id, char_start): every text that holds a quote, with its first place (from 0).

    No quote is compared with every text.  They meet by a hash of words that stand inside the quote (its first and
    last may be parts of words): four of them, or as many as it has; quotes of one or two words meet by
    their first characters, up to three.
    """
    split = lambda c: F.array_remove(F.split(c, r"[\x20\x09-\x0D]+", -1), "")
    q = quotes.select("quote_id", "quote", split("quote").alias("w")).where(F.length("quote").between(1, MAX_QUOTE))
    inner = F.least(F.size("w") - 2, F.lit(_KEY))
    words = F.array_join(F.slice("w", 2, F.greatest(inner, F.lit(1))), " ")
    keyed = q.select("quote_id", F.when(inner > 0, inner).otherwise(-F.least(F.length("quote"), F.lit(3))).alias("kind"), F.when(inner > 0, words).otherwise(F.substring("quote", 1, 3)).alias("k"))
    keyed = keyed.select("quote_id", "kind", F.xxhash64("k").alias("key"))
    kinds = [r.kind for r in keyed.select("kind").distinct().collect()]  # -3 to 4
    t = texts.select("text_id", "text", split("text").alias("w"))
    at = lambda n: F.sequence(F.lit(1), n)
    meets = None
    for kind in kinds:
        if kind > 0:
            windows = F.when(F.size("w") >= kind, F.transform(at(F.size("w") - (kind - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(kind)), " "))))  # noqa: B023
        else:
            windows = F.when(F.length("text") >= -kind, F.transform(at(F.length("text") + (kind + 1)), lambda i: F.xxhash64(F.substring("text", i, F.lit(-kind)))))  # noqa: B023
        keys = t.select("text_id", F.explode(F.array_distinct(windows)).alias("key"))
        part = keys.join(keyed.where(F.col("kind") == kind).select("quote_id", "key"), "key").select("quote_id", "text_id")
        meets = part if meets is None else meets.unionByName(part)
    place = (F.instr("text", F.col("quote")) - 1).cast("long")
    if meets is None:
        return texts.crossJoin(q.limit(0)).select("quote_id", "text_id", place.alias("char_start"))  # no quotes
    found = meets.distinct().join(q.select("quote_id", "quote"), "quote_id").join(texts.select("text_id", "text"), "text_id")
    return found.select("quote_id", "text_id", place.alias("char_start")).where("char_start >= 0")


def verify(claims: DataFrame, window: int = REPAIR_WINDOW) -> DataFrame:
    """Adds status and repaired_start to rows (text, quote, char_start, char_end).

    exact: the span holds the quote; repaired: it does not, but the quote occurs exactly once
    within ``window`` code points around it; failed: anything else.
    """
    around = F.greatest(F.col("char_start") - window, F.lit(0))
    near = F.substring("text", (around + 1).cast("int"), (F.length("quote") + 2 * window).cast("int"))
    held = T.span(F.col("text"), F.col("char_start").cast("int"), F.col("char_end").cast("int")) == F.col("quote")
    once = T.occurrences(near, F.col("quote")) == 1
    status = F.when(held, "exact").when(once, "repaired").otherwise("failed")
    return claims.withColumn("status", status).withColumn("repaired_start", F.when(F.col("status") == "exact", F.col("char_start")).when(F.col("status") == "repaired", around + F.instr(near, F.col("quote")) - 1))


def quality_gate(pages: DataFrame, least_visible: int = 20, broken: float = 0.05, blank: float = 0.5) -> DataFrame:
    """(revision, pages, blank, needs_ocr): why the extracted pages (revision, text) can't be used as they are, or null.

    Few visible characters a page, many replacement characters, or mostly blank pages.
    """
    visible = F.length(F.regexp_replace("text", r"\s", ""))
    lost = F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit("")))
    sums = pages.groupBy("revision").agg(F.count("*").alias("pages"), F.count_if(visible == 0).alias("blank"), F.sum(visible).alias("visible"), F.sum(lost).alias("lost"))
    reason = F.when(F.col("visible") < least_visible * F.col("pages"), "few_visible_characters").when(F.col("lost") > broken * F.col("visible"), "replacement_characters").when(F.col("blank") > blank * F.col("pages"), "blank_pages")
    return sums.select("revision", "pages", "blank", reason.alias("needs_ocr"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans (revision, s, e) of one revision as islands (revision, s, e, n)."""
    w = W.partitionBy("revision").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = spans.withColumn("fresh", F.when(reach.isNull() | (F.col("s") >= reach), 1).otherwise(0))
    islands = flagged.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("revision", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("island")


def source_share(hits: DataFrame, size: int, share: float = 0.5) -> DataFrame:
    """At most floor(share * size) hits of a source go first; the rest fill up what is left, by rank."""
    per = F.row_number().over(W.partitionBy("qid", "source").orderBy("rank", "unit_id"))
    ranked = hits.withColumn("late", per > F.lit(max(1, int(share * size))))
    w = W.partitionBy("qid").orderBy("late", "rank", "unit_id")
    return ranked.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= size)


def budget_prefix(items: DataFrame, budget: int) -> DataFrame:
    """Adds running and fits: items by rank as long as their tokens stay within the budget."""
    w = W.partitionBy("qid").orderBy("rank", "unit_id").rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("running", F.sum("tokens").over(w)).withColumn("fits", F.col("running") <= budget)


def budget_greedy(items: DataFrame, budget: int) -> DataFrame:
    """(qid, unit_id, tokens, taken): by rank, skipping what does not fit and going on.

    An aggregation over each query's items in order; ranks above ``MAX_BUNDLE`` are refused, so that a bundle stays small.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "unit_id", "tokens")))
    none = F.array().cast("array<struct<unit_id:string,tokens:bigint,taken:boolean>>")
    fits = lambda s, x: x["tokens"] <= s["left"]
    step = lambda s, x: F.struct((s["left"] - F.when(fits(s, x), x["tokens"]).otherwise(0)).alias("left"), F.concat(s["out"], F.array(F.struct(x["unit_id"], x["tokens"].alias("tokens"), fits(s, x).alias("taken")))).alias("out"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), none.alias("out"))
    some = items.select("qid", "unit_id", F.when(F.col("rank") > MAX_BUNDLE, F.raise_error(F.lit(f"a bundle has at most {MAX_BUNDLE} items"))).otherwise(F.col("rank")).alias("rank"), F.col("tokens").cast("long").alias("tokens"))
    filled = some.groupBy("qid").agg(F.aggregate(ordered, start, step, lambda s: s["out"]).alias("x"))
    return filled.select("qid", F.explode("x").alias("x")).select("qid", "x.unit_id", "x.tokens", "x.taken")


def bundle_places(hits: DataFrame, size: int = 20, share: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, repeated, unavailable) for ranked evidence, written once.

    hits (qid, unit_id, rank, source, revision, s, e, tokens, available, side): side is null or names a side of a conflict.
    Only available hits go on; the best of each conflict side comes first; a hit whose span lies in that of a better one of
    the same revision repeats it; a source fills at most its share of the bundle while others are left.
    """
    hits = Scratch(hits.sparkSession, "bundle").table(hits, "hits")
    usable = hits.where("available")
    sides = usable.where("side IS NOT NULL").withColumn("i", F.row_number().over(W.partitionBy("qid", "side").orderBy("rank", "unit_id"))).where("i = 1").select("qid", "unit_id", F.lit(0).alias("first"))
    a, b = usable.alias("a"), usable.alias("b")
    inside = (F.col("a.qid") == F.col("b.qid")) & (F.col("a.revision") == F.col("b.revision")) & (F.col("a.s") >= F.col("b.s")) & (F.col("a.e") <= F.col("b.e")) & (F.col("b.rank") < F.col("a.rank"))
    repeated = a.join(b, inside, "left_semi").select("qid", "unit_id").join(sides.select("qid", "unit_id"), ["qid", "unit_id"], "left_anti")
    fresh = usable.join(repeated, ["qid", "unit_id"], "left_anti").join(sides, ["qid", "unit_id"], "left").withColumn("first", F.coalesce("first", F.lit(1)))
    per = F.row_number().over(W.partitionBy("qid", "source").orderBy("first", "rank", "unit_id"))
    shared = fresh.withColumn("late", (F.col("first") == 1) & (per > max(1, int(share * size))))
    placed = shared.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("first", "late", "rank", "unit_id")).cast("long"))
    return placed, repeated, hits.where("NOT available").select("qid", "unit_id")


def bundle(hits: DataFrame, size: int = 20, share: float = 0.5, budget: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(bundle, omissions): ``bundle_places``, of which whole quotes are taken in order as long as they fit the budget.

    The bundle has (qid, unit_id, position, tokens); the omissions have (qid, unit_id, reason): unavailable, repeated, size or budget.
    """
    placed, repeated, unavailable = bundle_places(hits, size, share)
    chosen = placed.where(F.col("place") <= size).select("qid", "unit_id", F.col("place").alias("rank"), "tokens")
    filled = budget_greedy(chosen, budget)
    taken = filled.where("taken").join(chosen.select("qid", "unit_id", "rank"), ["qid", "unit_id"])
    out = taken.select("qid", "unit_id", F.row_number().over(W.partitionBy("qid").orderBy("rank")).cast("long").alias("position"), "tokens")
    reason = lambda df, why: df.select("qid", "unit_id", F.lit(why).alias("reason"))
    left = reason(unavailable, "unavailable").unionByName(reason(repeated, "repeated")).unionByName(reason(placed.where(F.col("place") > size), "size")).unionByName(reason(filled.where("NOT taken"), "budget"))
    return out, left


def traced(hits: DataFrame, support: DataFrame, cites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, omitted): the evidence behind ranked hits (qid, kind, id, rank), with the best rank of a hit that leads to it.

    support (kind, id, evidence_id) binds assertions to evidence; cites (id, kind, member) says from which assertions, or which
    pieces of evidence (kind ``evidence``), a synthesis was written.  A synthesis is traced back to them and is no evidence itself.  Hits without any are omitted.
    """
    direct = hits.join(support, ["kind", "id"]).select("qid", "kind", "id", "rank", "evidence_id")
    cited = hits.where("kind = 'synthesis'").select("qid", "id", "rank").join(cites.withColumnRenamed("kind", "of"), "id")
    own = cited.where("of = 'evidence'").select("qid", F.lit("synthesis").alias("kind"), "id", "rank", F.col("member").alias("evidence_id"))
    through = cited.join(support.select(F.col("kind").alias("of"), F.col("id").alias("member"), "evidence_id"), ["of", "member"]).select("qid", F.lit("synthesis").alias("kind"), "id", "rank", "evidence_id")
    led = direct.unionByName(own).unionByName(through)
    omitted = hits.join(led.select("qid", "kind", "id").distinct(), ["qid", "kind", "id"], "left_anti").select("qid", F.concat_ws(":", "kind", "id").alias("item"), F.lit("no_evidence").alias("reason"))
    return led.groupBy("qid", "evidence_id").agg(F.min("rank").alias("rank")), omitted


def sides_of(hits: DataFrame, members: DataFrame, support: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sides, missing) of the conflict groups that the hits touch: (qid, group, side, evidence_id) of usable evidence, and the sides without any.

    members (group, side, kind, id) are the assertions of a conflict; evidence has (evidence_id, available, allowed).  Both
    sides of a touched group are fetched, hit or not.  A missing side is unavailable, or filtered_out if only the filter keeps it away.
    """
    touched = hits.join(members, ["kind", "id"]).select("qid", "group").distinct()
    held = touched.join(members, "group").join(support, ["kind", "id"], "left").join(evidence, "evidence_id", "left")
    usable = F.coalesce(F.col("available") & F.col("allowed"), F.lit(False))
    missing = held.groupBy("qid", "group", "side").agg(F.bool_or(usable).alias("ok"), F.bool_or(F.coalesce(F.col("available"), F.lit(False))).alias("there")).where("NOT ok")
    missing = missing.select("qid", F.concat_ws(":", F.lit("side"), "group", "side").alias("item"), F.when(F.col("there"), "filtered_out").otherwise("unavailable").alias("reason"))
    return held.where(usable).select("qid", "group", "side", "evidence_id").distinct(), missing


def budgets(items: DataFrame, sources: int, most: int, tokens: int) -> DataFrame:
    """Adds taken and reason to items (qid, evidence_id, place, source, tokens): in the order of their places, each is taken if the
    bundle then still has at most so many sources, pieces of evidence and tokens; otherwise the first limit that fails is the reason.

    One aggregation over a query's places, of which at most ``MAX_BUNDLE`` are allowed.
    """
    shape = "array<struct<evidence_id:string,place:bigint,source:string,tokens:bigint,reason:string>>"
    ordered = F.array_sort(F.collect_list(F.struct("place", "evidence_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "tokens")))
    start = F.struct(F.lit(tokens).cast("long").alias("left"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("sources"), F.array().cast(shape).alias("out"))

    def step(s, x):
        known = F.array_contains(s["sources"], x["source"])
        reason = F.when(s["n"] >= most, "max_evidence").when(~known & (F.size(s["sources"]) >= sources), "max_sources").when(x["tokens"] > s["left"], "max_tokens")
        ok = reason.isNull()
        told = F.struct(x["evidence_id"].alias("evidence_id"), x["place"].alias("place"), x["source"].alias("source"), x["tokens"].alias("tokens"), reason.alias("reason"))
        return F.struct((s["left"] - F.when(ok, x["tokens"]).otherwise(0)).alias("left"), (s["n"] + F.when(ok, 1).otherwise(0)).alias("n"), F.when(ok & ~known, F.concat(s["sources"], F.array(x["source"]))).otherwise(s["sources"]).alias("sources"), F.concat(s["out"], F.array(told)).alias("out"))

    some = items.select("qid", "evidence_id", F.when(F.col("place") > MAX_BUNDLE, F.raise_error(F.lit(f"a bundle has at most {MAX_BUNDLE} candidates"))).otherwise(F.col("place")).cast("long").alias("place"), "source", F.col("tokens").cast("long").alias("tokens"))
    filled = some.groupBy("qid").agg(F.aggregate(ordered, start, step, lambda s: s["out"]).alias("x")).select("qid", F.inline("x"))
    return filled.withColumn("taken", F.col("reason").isNull())


def assemble(hits: DataFrame, support: DataFrame, cites: DataFrame, members: DataFrame, evidence: DataFrame, sources: int = 12, most: int = 30, share: float = 0.5, tokens: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(bundle, omitted) by all rules: traced evidence, spans that a better one holds go, the best evidence of each conflict
    side first, then by rank with the sources' soft share, under all budgets at once.

    evidence (evidence_id, source, revision, s, e, tokens, available, allowed).  The bundle has (qid, evidence_id, position,
    source, tokens, share_relaxed), the last for pieces beyond their source's share; omitted has (qid, item, reason).
    """
    if not (1 <= sources <= MAX_PAGE and 1 <= most <= MAX_PAGE and 0 < share <= 1):
        raise ValueError(f"limits are 1 to {MAX_PAGE} sources and pieces of evidence, and a share above 0 to 1")
    scratch = Scratch(hits.sparkSession, "assemble")
    found, without = traced(hits, support, cites)
    fetched, missing = sides_of(hits, members, support, evidence)
    rows = found.select("qid", "evidence_id").unionByName(fetched.select("qid", "evidence_id")).distinct().join(found, ["qid", "evidence_id"], "left").join(evidence, "evidence_id")
    rows = scratch.table(rows, "rows")
    fetched = scratch.table(fetched, "sides")
    late = F.coalesce("rank", F.lit(1 << 30))  # fetched only for its side
    usable = rows.where("available AND allowed").withColumn("rank", late)
    one = fetched.join(usable.select("qid", "evidence_id", "rank"), ["qid", "evidence_id"]).withColumn("i", F.row_number().over(W.partitionBy("qid", "group", "side").orderBy("rank", "evidence_id"))).where("i = 1")
    first = one.select("qid", "evidence_id").distinct().withColumn("first", F.lit(0))
    fresh = usable.join(first, ["qid", "evidence_id"], "left").withColumn("first", F.coalesce("first", F.lit(1))).where(f"first = 0 OR rank < {1 << 30}")
    # of one question's spans in one revision, those inside a better one: whose end lies before the furthest end of better ones that begin no later
    a, b = fresh.alias("a"), fresh.alias("b")
    inside = (F.col("a.qid") == F.col("b.qid")) & (F.col("a.revision") == F.col("b.revision")) & (F.col("a.s") >= F.col("b.s")) & (F.col("a.e") <= F.col("b.e")) & (F.struct("b.rank", "b.evidence_id") < F.struct("a.rank", "a.evidence_id"))
    repeated = a.where("a.first = 1").join(b, inside, "left_semi").select("qid", "evidence_id")
    kept = fresh.join(repeated, ["qid", "evidence_id"], "left_anti")
    own = F.row_number().over(W.partitionBy("qid", "source").orderBy("first", "rank", "evidence_id"))
    shared = kept.withColumn("beyond", own > max(1, int(share * most)))
    placed = shared.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("first", F.col("beyond") & (F.col("first") == 1), "rank", "evidence_id")).cast("long"))
    placed = scratch.table(placed.select("qid", "evidence_id", "place", "source", "tokens", "beyond"), "placed")
    judged = scratch.table(budgets(placed, sources, most, tokens), "judged")
    position = F.row_number().over(W.partitionBy("qid").orderBy("place")).cast("long")
    bundle = judged.where("taken").join(placed.select("qid", "evidence_id", "beyond"), ["qid", "evidence_id"]).select("qid", "evidence_id", position.alias("position"), "source", "tokens", F.col("beyond").alias("share_relaxed"))
    told = lambda df, why: df.select("qid", F.col("evidence_id").alias("item"), why.alias("reason"))
    shut = fetched.join(judged.where("taken").select("qid", "evidence_id"), ["qid", "evidence_id"], "left").groupBy("qid", "group", "side").agg(F.count_if(F.lit(True)).alias("n"))
    taken = fetched.join(judged.where("taken").select("qid", "evidence_id"), ["qid", "evidence_id"], "left_semi").select("qid", "group", "side").distinct()
    over = shut.join(taken, ["qid", "group", "side"], "left_anti").select("qid", F.concat_ws(":", F.lit("side"), "group", "side").alias("item"), F.lit("budget").alias("reason"))
    why = F.when(~F.col("available"), "unavailable").otherwise("filtered_out")
    omitted = without.unionByName(missing).unionByName(over).unionByName(told(rows.where("NOT (available AND allowed)"), why)).unionByName(told(repeated, F.lit("repeated"))).unionByName(told(judged.where("NOT taken"), F.col("reason")))
    return bundle, omitted


def with_context(bundle: DataFrame, paragraphs: DataFrame, around: int = 400) -> DataFrame:
    """Adds context_start, context_end, truncated_start and truncated_end to quoted spans (revision, s, e).

    A quote is kept whole and gets the paragraphs (revision, section, ordinal, p_start, p_end) it lies in, and the ones before and after them if they are of
    the same section.  At most ``around`` characters are added on either side; a flag says where that cut the context.
    """
    near = W.partitionBy("revision", "section").orderBy("ordinal")
    wide = paragraphs.select("revision", "p_start", "p_end", F.coalesce(F.lag("p_start").over(near), "p_start").alias("from"), F.coalesce(F.lead("p_end").over(near), "p_end").alias("to"))
    met = bundle.join(wide, "revision", "left").withColumn("meets", F.coalesce((F.col("p_start") < F.col("e")) & (F.col("p_end") > F.col("s")), F.lit(False)))
    sums = met.groupBy(*bundle.columns).agg(F.min(F.when(F.col("meets"), F.col("from"))).alias("from"), F.max(F.when(F.col("meets"), F.col("to"))).alias("to"))
    begin, end = F.least(F.coalesce("from", "s"), F.col("s")), F.greatest(F.coalesce("to", "e"), F.col("e"))
    return sums.select(
        *bundle.columns, F.greatest(begin, F.col("s") - around).alias("context_start"), F.least(end, F.col("e") + around).alias("context_end"),
        (begin < F.col("s") - around).alias("truncated_start"), (end > F.col("e") + around).alias("truncated_end"),
    )


def conflict_sides(members: DataFrame) -> DataFrame:
    """Adds keep_first: the best member of each side of a conflict goes before relevance."""
    w = W.partitionBy("group", "side").orderBy("rank", "id")
    return members.withColumn("keep_first", F.row_number().over(w) == 1)


def unknown_citations(bodies: DataFrame, bundle: DataFrame) -> DataFrame:
    """(id, evidence_id) cited in a body but not in the bundle (evidence_id)."""
    cited = bodies.select("id", F.explode(F.array_distinct(T.citations(F.col("body")))).alias("evidence_id"))
    return cited.join(bundle.select("evidence_id").distinct(), "evidence_id", "left_anti").select("id", "evidence_id")
