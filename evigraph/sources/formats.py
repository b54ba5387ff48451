"""Source formats: which parser takes a file, Markdown and plain-text blocks, model output and evaluation sets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parsers by extension, and formats that are known and refused.
PARSERS = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "pdf": "pdf"}
REFUSED = ("docx", "pptx", "epub")


def parser_of(path: Column) -> Column:
    """struct(parser, error) by the extension of a path."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    parser = F.element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), ext)
    return F.struct(parser.alias("parser"), F.when(ext.isin(*REFUSED), "UNSUPPORTED_FORMAT").when(parser.isNull(), "UNKNOWN_FORMAT").alias("error"))


def text_blocks(texts: DataFrame, key: str) -> DataFrame:
    """(key, pos, text, error) of the paragraphs of contents (binary); what isn't UTF-8 needs an encoding and is one row with its error."""
    valid = F.is_valid_utf8(F.col("content"))
    parts = F.split(F.try_validate_utf8(F.col("content").cast("string")), r"\n\s*\n", -1)
    rows = texts.select(key, F.when(valid, parts).otherwise(F.array(F.lit(None).cast("string"))).alias("p"), F.when(~valid, "ENCODING_REQUIRED").alias("error"))
    return rows.select(key, F.posexplode("p").alias("pos", "text"), "error").select(key, F.col("pos").cast("long").alias("pos"), "text", "error")


def blocks_of(text: str) -> list[tuple[str, str, list[str], int, int]]:
    """(kind, text, section path, start, end) of a Markdown text, in code points; front matter is left out."""
    front = re.match(r"---\n.*?\n---\n", text, re.S)
    at, fence, held, sections, out = front.end() if front else 0, None, None, [], []

    def close(end: int):
        nonlocal held
        if held:
            out.append((held[0], text[held[1] : end].rstrip("\n"), [s for _, s in sections], held[1], held[1] + len(text[held[1] : end].rstrip("\n"))))
        held = None

    for line in text[at:].splitlines(keepends=True):
        end, bare = at + len(line), line.strip()
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark[1].startswith(fence) and bare == mark[1]:
                fence = None
                close(end)
        elif mark:
            close(at)
            fence, held = mark[1], ("code", at)
        elif heading := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            close(at)
            level = len(heading[1])
            sections = [s for s in sections if s[0] < level] + [(level, heading[2])]
            held = ("heading", at)
            close(end)
        elif not bare:
            close(at)
        else:
            kind = "quote" if bare.startswith(">") else "list" if re.match(r"([-*+]|\d+[.)])\s", bare) else "table" if bare.startswith("|") else "paragraph"
            if held and held[0] != kind and kind != "paragraph":
                close(at)
            held = held or (kind, at)
        at = end
    close(at)
    return out


def markdown_blocks(texts: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, text, section_path, char_start, char_end) of the contents (string)."""

    def run(frames):
        for frame in frames:
            rows = [(k, i, *b) for k, text in zip(frame[key], frame["content"], strict=True) for i, b in enumerate(blocks_of(text or ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", "kind", "text", "section_path", "char_start", "char_end"])

    return texts.select(key, "content").mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, pos long, kind string, text string, section_path array<string>, char_start long, char_end long")


_LOCATOR = "page:int,section_path:array<string>,paragraph:int,char_start:int,char_end:int"
_EVIDENCE = f"array<struct<stance:string,quote:string,locator:struct<{_LOCATOR}>>>"
MODEL_OUTPUT = (
    f"entities array<struct<temp_id:string,type:string,canonical_name:string,aliases:array<string>,description:string,mentions:array<struct<quote:string,locator:struct<{_LOCATOR}>>>,confidence:double>>, "
    f"claims array<struct<temp_id:string,subject_ref:string,statement:string,qualifiers:map<string,string>,evidence:{_EVIDENCE},confidence:double>>, "
    f"relations array<struct<temp_id:string,source_ref:string,predicate:string,target_ref:string,qualifiers:map<string,string>,evidence:{_EVIDENCE},confidence:double>>, warnings array<string>"
)


def model_rows(outputs: DataFrame, key: str) -> DataFrame:
    """(key, kind, temp_id, statement, name, predicate, source_ref, target_ref, confidence, evidence) of a model's structured answers (content).

    One row an entity, claim, relation or warning; an answer that isn't JSON is one row of kind error.
    """
    parsed = outputs.select(key, F.try_parse_json("content").isNotNull().alias("ok"), F.from_json("content", MODEL_OUTPUT).alias("x"))
    names = ["temp_id", "statement", "name", "predicate", "source_ref", "target_ref", "confidence", "evidence"]
    kinds = {"temp_id": "string", "statement": "string", "name": "string", "predicate": "string", "source_ref": "string", "target_ref": "string", "confidence": "double", "evidence": _EVIDENCE}

    def rows(kind: str, column: str, **fields):
        made = parsed.where("ok").select(key, F.explode(column).alias("e"))
        return made.select(key, F.lit(kind).alias("kind"), *[(F.col(fields[n]) if n in fields else F.lit(None)).cast(kinds[n]).alias(n) for n in names])

    out = rows("entity", "x.entities", temp_id="e.temp_id", name="e.canonical_name", confidence="e.confidence")
    out = out.unionByName(rows("claim", "x.claims", temp_id="e.temp_id", statement="e.statement", source_ref="e.subject_ref", confidence="e.confidence", evidence="e.evidence"))
    out = out.unionByName(rows("relation", "x.relations", temp_id="e.temp_id", predicate="e.predicate", source_ref="e.source_ref", target_ref="e.target_ref", confidence="e.confidence", evidence="e.evidence"))
    out = out.unionByName(rows("warning", "x.warnings", statement="e"))
    wrong = parsed.where("NOT ok").select(key, F.lit("error").alias("kind"), *[(F.lit("not_json") if n == "statement" else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
    return out.unionByName(wrong)


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query, unit_id, tags) of a JSONL file of queries with their relevant ids; broken lines go to (null query, error)."""
    rows = spark.read.schema("query string, relevant_ids array<string>, tags array<string>, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.select(F.xxhash64("query").alias("qid"), "query", F.explode_outer("relevant_ids").alias("unit_id"), "tags", F.col("broken").alias("error"))
