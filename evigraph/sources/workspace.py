"""Canonical workspace files as DataFrames, and the writer of managed blocks.

A file is front matter, free Markdown and managed blocks between the markers
``<!-- NAME:claims:begin -->`` and ``<!-- NAME:claims:end -->`` (likewise relations),
where NAME is any one word.  A missing or repeated marker is an error row, never an exception.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.constants import CHUNK_MAX, CHUNK_TARGET, MAX_PAGE, PAGE

try:
    import yaml
except ImportError:  # files can then be listed and hashed, but not parsed
    yaml = None

FRONT = re.compile(r"\A---\n(.*?)\n---\n", re.S)
MAX_PURPOSE_BYTES = 16 * 1024


def managed_block(text: str, kind: str) -> tuple[int, int] | None:
    """Start and end of the YAML inside a managed block; None without markers; ValueError if they are not one pair."""
    begin = list(re.finditer(rf"<!-- \w+:{kind}:begin -->\n```yaml\n", text))
    end = list(re.finditer(rf"```\n<!-- \w+:{kind}:end -->", text))
    marks = len(re.findall(rf"<!-- \w+:{kind}:(?:begin|end) -->", text))
    if not marks:
        return None
    if len(begin) != 1 or len(end) != 1 or marks != 2 or end[0].start() < begin[0].end():
        raise ValueError("INVALID_MANAGED_BLOCK")
    return begin[0].end(), end[0].start()


def parse_node(text: str) -> dict:
    """front, claims and relations of a node page."""
    front = FRONT.match(text)
    if not front:
        raise ValueError("MISSING_FRONT_MATTER")
    out = {"front": yaml.safe_load(front[1]) or {}}
    for kind in ("claims", "relations"):
        at = managed_block(text, kind)
        out[kind] = (yaml.safe_load(text[at[0] : at[1]]) or {}).get("items") or [] if at else []
    return out


def render_node(text: str, kind: str, items: list[dict]) -> str:
    """The page with the items of one block in the order of their ids; all other bytes stay, and so do all if nothing changed."""
    at = managed_block(text, kind)
    if at is None:
        raise ValueError("INVALID_MANAGED_BLOCK")
    ordered = sorted(items, key=lambda x: x["id"])
    if (yaml.safe_load(text[at[0] : at[1]]) or {}).get("items", []) == ordered:
        return text
    return text[: at[0]] + yaml.safe_dump({"version": 1, "items": ordered}, sort_keys=False, allow_unicode=True) + text[at[1] :]


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, byte_size, mtime, sha256, content): the manifest of a workspace, read recursively."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("byte_size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), "content")


ASSERTION = "path string, node_id string, kind string, id string, statement string, predicate string, target_node_id string, lifecycle_status string, evidence_status string, confidence double, evidence_ids array<string>, error string"


def assertions(manifest: DataFrame) -> DataFrame:
    """Claims and relations of the node pages among the files, one row each; a page that can't be read gives one row with its error."""

    def run(frames):
        columns = [c.strip().split(" ")[0] for c in ASSERTION.split(", ")]
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    page = parse_node(bytes(content).decode("utf-8"))
                    if page["front"].get("kind") != "node":
                        continue
                    for kind in ("claims", "relations"):
                        for x in page[kind]:
                            rows.append((path, page["front"].get("id"), kind[:-1], x.get("id"), x.get("statement"), x.get("predicate"), x.get("target_node_id"), x.get("lifecycle_status"), x.get("evidence_status"), x.get("confidence"), [e["id"] for e in x.get("evidence") or []], None))
                except (ValueError, KeyError, AttributeError, yaml.YAMLError) as error:
                    rows.append((path, *[None] * 10, str(error)[:400]))
            yield pd.DataFrame(rows, columns=columns)

    return manifest.select("path", "content").where(F.col("path").endswith(".md")).mapInPandas(run, ASSERTION)


SOURCE = "path string, source_id string, kind string, title string, language string, tags array<string>, removed_at string, revision_id string, revision_path string, mime_type string, sha256 string, byte_size long, captured_at string, is_current boolean, error string"


def parse_source(text: str) -> list[tuple]:
    """The revisions of a source manifest, as rows of ``SOURCE`` without path and error."""
    x = yaml.safe_load(text)
    if not isinstance(x, dict) or "id" not in x:
        raise ValueError("INVALID_SOURCE")
    if x.get("version", 1) > 1:
        raise ValueError("UNSUPPORTED_VERSION")
    head = [x["id"], x.get("kind"), x.get("title"), x.get("language"), [str(v) for v in x.get("tags") or []], _text(x.get("removed_at"))]
    return [(*head, r.get("id"), r.get("path"), r.get("mime_type"), r.get("sha256"), r.get("byte_size"), _text(r.get("captured_at")), r.get("id") == x.get("current_revision_id")) for r in x.get("revisions") or []]


def _text(value) -> str | None:
    """A YAML time as RFC 3339; other values as they are written."""
    if value is None:
        return None
    return value.strftime("%Y-%m-%dT%H:%M:%SZ") if hasattr(value, "strftime") else str(value)


def sources(manifest: DataFrame) -> DataFrame:
    """One row a revision of the source manifests among the files."""
    return _rows(manifest.where(F.col("path").endswith("/source.yaml")), SOURCE, parse_source)


SYNTHESIS = "path string, id string, title string, question string, status string, related_nodes array<string>, evidence_ids array<string>, has_snapshot boolean, dependency_id string, recorded_hash string, source_id string, revision_id string, cited array<string>, error string"


def parse_synthesis(text: str) -> list[tuple]:
    """A row for each dependency of a synthesis (an assertion or a source head), or one row without any; cited has the citations of its text."""
    front = FRONT.match(text)
    if not front:
        raise ValueError("MISSING_FRONT_MATTER")
    x = yaml.safe_load(front[1]) or {}
    if x.get("kind") != "synthesis":
        return []
    snapshot = x.get("dependency_snapshot")
    head = [x.get("id"), x.get("title"), x.get("question"), x.get("status"), x.get("related_nodes") or [], x.get("evidence_ids") or [], snapshot is not None]
    cited = list(dict.fromkeys(re.findall(r"\[@(evd_[A-Za-z0-9]+)\]", text[front.end() :])))
    snapshot = snapshot or {}
    found = [(d.get("id"), d.get("semantic_sha256"), None, None) for d in snapshot.get("assertions") or []] + [(None, None, d.get("source_id"), d.get("revision_id")) for d in snapshot.get("source_heads") or []]
    return [(*head, *d, cited) for d in found or [(None,) * 4]]


def syntheses(manifest: DataFrame) -> DataFrame:
    return _rows(manifest.where(F.col("path").endswith(".md")), SYNTHESIS, parse_synthesis)


def _rows(manifest: DataFrame, schema: str, parse) -> DataFrame:
    """Rows that ``parse`` makes of each file; one that can't be read gives one row with its error."""
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, *r, None) for r in parse(bytes(content).decode("utf-8"))]
                except (ValueError, KeyError, AttributeError, TypeError, yaml.YAMLError) as error:
                    rows.append((path, *[None] * (len(columns) - 2), str(error)[:400]))
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    return manifest.select("path", "content").mapInPandas(run, schema)


def purpose(manifest: DataFrame, name: str) -> DataFrame:
    """(path, sha256, text, error) of the purpose file; one of more than ``MAX_PURPOSE_BYTES`` is refused, never cut."""
    large = F.col("byte_size") > MAX_PURPOSE_BYTES
    return manifest.where(F.col("path").endswith(name)).select("path", "sha256", F.when(~large, F.col("content").cast("string")).alias("text"), F.when(large, "PURPOSE_TOO_LARGE").alias("error"))


def config(text: str, environment: dict[str, str]) -> tuple[dict, list[str]]:
    """A workspace's settings with ${NAME} taken from the environment, and the names that are not set.

    Only the result holds what was read; the text is never written back with it.
    """
    missing: list[str] = []

    def fill(x):
        if isinstance(x, dict):
            return {k: fill(v) for k, v in x.items()}
        if isinstance(x, list):
            return [fill(v) for v in x]
        if not isinstance(x, str):
            return x
        missing.extend(n for n in re.findall(r"\$\{(\w+)\}", x) if n not in environment)
        return re.sub(r"\$\{(\w+)\}", lambda m: environment.get(m[1], ""), x)

    return fill(yaml.safe_load(text) or {}), sorted(set(missing))


def schema_pack(spark: SparkSession, *texts: str) -> tuple[DataFrame, DataFrame]:
    """(node types, predicates) of schema packs; ids are unique, and a pack extends only packs that are there."""
    packs = [yaml.safe_load(t) for t in texts]
    names = [f"{p['id']}@{p['version']}" for p in packs]
    if len(set(names)) < len(names):
        raise ValueError("DUPLICATE_PACK")
    for name, p in zip(names, packs, strict=True):
        if set(p.get("extends") or []) - set(names):
            raise ValueError(f"{name} extends a pack that is not there")
    types = [(n, k, v.get("label"), sorted(v.get("properties") or {}), sorted(q for q, r in (v.get("properties") or {}).items() if r.get("required"))) for n, p in zip(names, packs, strict=True) for k, v in (p.get("node_types") or {}).items()]
    predicates = [(n, k, v.get("source_types") or [], v.get("target_types") or [], bool(v.get("directed", True)), v.get("inverse"), bool(v.get("evidence_required"))) for n, p in zip(names, packs, strict=True) for k, v in (p.get("predicates") or {}).items()]
    return (
        spark.createDataFrame(types, "pack string, node_type string, label string, properties array<string>, required array<string>"),
        spark.createDataFrame(predicates, "pack string, predicate string, source_types array<string>, target_types array<string>, directed boolean, inverse string, evidence_required boolean"),
    )


def pack_edges(*texts: str) -> list[tuple[str, str]]:
    """(pack, extended pack), to be tested for circles."""
    return [(f"{p['id']}@{p['version']}", e) for p in map(yaml.safe_load, texts) for e in p.get("extends") or []]


def structural_chunks(texts: DataFrame, target: int = CHUNK_TARGET, most: int = CHUNK_MAX) -> DataFrame:
    """(owner_id, ordinal, text, tokens): whole lines gathered up to the target; a heading of level one starts a chunk; a longer line is cut at ``most`` tokens of four characters.

    Where a chunk ends depends on where the last one did, so each text is gone through in order; a fold of columns would copy its state at every line.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for owner, text in zip(frame["owner_id"], frame["text"], strict=True):
                held, size, chunks = [], 0, []
                for line in (text or "").split("\n"):
                    for at in range(0, max(1, len(line)), most * 4):
                        part = line[at : at + most * 4]
                        n = -(-len(part) // 4)
                        if held and (size + n > target or part.startswith("# ")):
                            chunks.append("\n".join(held))
                            held, size = [], 0
                        held.append(part)
                        size += n
                chunks.append("\n".join(held))
                rows += [(owner, i, c, -(-len(c) // 4)) for i, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["owner_id", "ordinal", "text", "tokens"])

    return texts.select("owner_id", "text").mapInPandas(run, "owner_id long, ordinal long, text string, tokens long")


def cache_key(**parts) -> str:
    """SHA-256 of a stage's inputs as canonical JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def write_csv(df: DataFrame, path: str) -> None:
    """CSV is for flat lists only."""
    nested = [f.name for f in df.schema if f.dataType.simpleString().startswith(("array", "map", "struct", "variant"))]
    if nested:
        raise ValueError(f"nested columns can't be written as csv: {nested}")
    df.write.option("header", True).csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path)


def envelope(df: DataFrame, limit: int = MAX_PAGE, **meta) -> dict:
    """Success envelope of at most ``limit`` records; fields that are not set are left out."""
    rows = [r.asDict(recursive=True) for r in df.limit(min(limit, MAX_PAGE)).collect()]
    return {"ok": True, "data": [{k: v for k, v in r.items() if v is not None} for r in rows], "meta": {"schema_version": "1", **{k: v for k, v in meta.items() if v is not None}}}


# Error types and the exit codes of a command.
EXIT_CODES = {"validation": 2, "not_found": 3, "configuration": 3, "io": 4, "network": 4, "internal": 5, "policy": 6, "conflict": 7, "model": 8, "confirmation": 10, "cancelled": 130}


def error_envelope(kind: str, code: str, message: str, **meta) -> tuple[dict, int]:
    """Error envelope and exit code."""
    return {"ok": False, "error": {"type": kind, "code": code, "message": message}, "meta": {"schema_version": "1", **meta}}, EXIT_CODES[kind]


def as_table(df: DataFrame, limit: int = PAGE) -> str:
    """A flat list as text, one record a line."""
    nested = [f.name for f in df.schema if f.dataType.simpleString().startswith(("array", "map", "struct", "variant"))]
    if nested:
        raise ValueError(f"nested columns can't be shown as a table: {nested}")
    rows = [df.columns, *[["" if v is None else str(v) for v in r] for r in df.limit(min(limit, MAX_PAGE)).collect()]]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(n) for v, n in zip(r, widths, strict=True)).rstrip() for r in rows)


class Versions:
    """Projections in versioned folders: built next to the current one, checked, then pointed to; the last ``keep`` stay."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Versions that are whole, oldest first."""
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.root))]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))

    def current(self, table: str) -> DataFrame | None:
        found = self.numbers()
        return self.spark.read.parquet(f"{self.root}/v{found[-1]}/{table}") if found else None

    def at(self, table: str, number: int) -> DataFrame:
        """A table as it was in a version that is still kept; a reader that holds on to one is told when it is gone."""
        if number not in self.numbers():
            raise LookupError(f"CURSOR_STALE: version {number} is gone")
        return self.spark.read.parquet(f"{self.root}/v{number}/{table}")

    def rebuild(self, tables: dict[str, DataFrame], check=None, base: int | None = None, carry: tuple[str, ...] = ()) -> int:
        """Writes all tables under a name that no reader looks for, calls ``check`` on what was written, and renames the folder, which is the switch.

        ``carry`` names tables of the current version that are taken over as they are (runtime tables).  With ``base`` the switch
        only takes place if that version is still the current one; of two writers that began from the same version, the second fails.
        """
        number = (self.numbers() or [0])[-1] + 1 if base is None else base + 1
        building = f"{self.root}/building-{number}-{uuid.uuid4().hex}"
        tables = {**{name: self.current(name) for name in carry}, **tables}
        for name, df in tables.items():
            df.write.parquet(f"{building}/{name}")
        if check is not None:
            check({name: self.spark.read.parquet(f"{building}/{name}") for name in tables})
        behind = base is not None and (self.numbers() or [0])[-1] != base
        if behind or self.fs.exists(self.path(f"{self.root}/v{number}")) or not self.fs.rename(self.path(building), self.path(f"{self.root}/v{number}")):
            self.fs.delete(self.path(building), True)
            raise RuntimeError(f"version {number} could not be put in place: another one was")
        for old in self.numbers()[: -self.keep]:
            self.fs.delete(self.path(f"{self.root}/v{old}"), True)
        return number
