"""Chunks of structured texts as one windowed plan.

Lines make blocks: fenced code and tables are kept whole, paragraphs end at blank lines and headings.  A chunk begins at every ``STEP``-th
token of a run of blocks, and repeats the end of the chunk before it.  A run ends where a top-level section
does, and around code and tables that are too big to stand beside others; these are chunks of their own.  So where a chunk begins follows
from sums over the blocks before it, never from the chunk before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.constants import CHUNK_MAX, CHUNK_OVERLAP, CHUNK_TARGET

CHARS = 4  # of a token
STEP = CHUNK_TARGET - CHUNK_OVERLAP
PIECE = (CHUNK_MAX - CHUNK_TARGET) * CHARS - 20  # characters of a paragraph's piece, so that no chunk passes CHUNK_MAX


def blocks(texts: DataFrame) -> DataFrame:
    """(owner_id, block, section, kind, text) of texts (owner_id, which is unique, and text); section counts the top-level headings so far."""
    w = W.partitionBy("owner_id").orderBy("k")
    lines = texts.select("owner_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "line"))
    mark = F.startswith("line", F.lit("```"))
    fenced = lines.withColumn("mark", mark).withColumn("fences", F.sum(F.col("mark").cast("int")).over(w))
    code = F.concat(F.lit("code"), F.expr("(fences + 1) div 2"))
    kind = F.when((F.col("fences") % 2 == 1) | F.col("mark"), code).when(F.startswith("line", F.lit("|")), "table").when(F.rlike("line", F.lit(r"^[\x20\x09-\x0D]*$")), "blank").otherwise("text")
    kinds = fenced.withColumn("kind", kind).withColumn("was", F.lag("kind").over(w))
    heading = (F.col("kind") == "text") & F.rlike("line", F.lit("^#{1,6} "))
    top = (F.col("kind") == "text") & F.startswith("line", F.lit("# "))
    begins = F.col("was").isNull() | (F.col("was") != F.col("kind")) | heading
    marked = kinds.withColumn("block", F.sum(begins.cast("int")).over(w)).withColumn("section", F.sum(top.cast("int")).over(w))
    held = marked.where("kind <> 'blank'").groupBy("owner_id", "block").agg(F.max("section").alias("section"), F.min("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    return held.select("owner_id", "block", "section", F.regexp_replace("kind", "[0-9]+$", "").alias("kind"), F.array_join("lines.line", "\n").alias("text"))


def section_chunks(texts: DataFrame) -> DataFrame:
    """(owner_id, ordinal, section, text, tokens, overlap): overlap is the number of characters repeated from the chunk before.

    Texts without a line that is not blank have no chunk.  Code and tables above the greatest size are cut there.
    """
    width = F.when(F.col("kind") == "text", F.lit(PIECE)).otherwise(F.lit(CHUNK_MAX * CHARS))
    cut = blocks(texts).withColumn("width", width).withColumn("i", F.explode(F.expr("sequence(0, (length(text) - 1) div width)")))
    own = (F.col("kind") != "text") & (F.length("text") > PIECE)
    pieces = cut.select("owner_id", "section", "block", "i", own.alias("own"), F.expr("substr(text, CAST(i * width + 1 AS INT), width)").alias("text"))
    w = W.partitionBy("owner_id").orderBy("block", "i")
    ends = F.col("own") | F.lag("own").over(w) | (F.col("section") != F.lag("section").over(w))
    runs = pieces.withColumn("ends", F.coalesce(ends, F.lit(True)).cast("int")).withColumn("run", F.sum("ends").over(w)).withColumn("n", F.ceil((F.length("text") + 2) / CHARS))
    before = F.coalesce(F.sum("n").over(W.partitionBy("owner_id", "run").orderBy("block", "i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("at", F.floor(before / STEP))
    whole = placed.groupBy("owner_id", "run", "at").agg(F.max("section").alias("section"), F.array_sort(F.collect_list(F.struct("block", "i", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x, k: F.concat(F.when((k > 0) & (x["i"] == 0), "\n\n").otherwise(""), x["text"])), "")
    chunks = whole.select("owner_id", "run", "at", "section", (F.col("parts")[0]["i"] == 0).alias("fresh"), joined.alias("body"))
    last = F.right(F.lag("body").over(W.partitionBy("owner_id", "run").orderBy("at")), F.lit(CHUNK_OVERLAP * CHARS))
    tail = chunks.withColumn("tail", F.coalesce(last, F.lit("")))
    text = F.concat("tail", F.when((F.col("tail") != "") & F.col("fresh"), "\n\n").otherwise(""), "body")
    ordinal = F.row_number().over(W.partitionBy("owner_id").orderBy("run", "at")).cast("long") - 1
    return tail.withColumn("whole", text).select("owner_id", ordinal.alias("ordinal"), F.col("section").cast("long").alias("section"), F.col("whole").alias("text"), F.ceil(F.length("whole") / CHARS).cast("long").alias("tokens"), F.length("tail").cast("long").alias("overlap"))
