"""Named operations over the tables of a workspace, with a registry that describes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions import vector as V
from evigraph.operators import evidence, graph, lineage, records, search

# What an operation may change.
EFFECTS = ("read", "runtime-write", "canonical-write", "derived-write", "destructive-derived")


class EmbeddingProvider(Protocol):
    """Turns (qid, query) into (qid, qv); a batch of texts at a time, for instance in ``mapInPandas``."""

    def embed(self, queries: DataFrame) -> DataFrame: ...


class LanguageModel(Protocol):
    """Turns prompts (id, prompt, schema) into answers (id, content)."""

    def generate(self, prompts: DataFrame) -> DataFrame: ...


class SourceParser(Protocol):
    """Turns contents into blocks, as ``sources.formats.markdown_blocks`` does."""

    def blocks(self, texts: DataFrame, key: str) -> DataFrame: ...


@dataclass(frozen=True)
class Operation:
    name: str
    inputs: tuple[str, ...]
    outputs: str
    effect: str
    dry_run: bool
    idempotent: bool
    run: Callable


OPERATIONS: dict[str, Operation] = {}


def operation(name: str, outputs: str, effect: str = "read", dry_run: bool = False, idempotent: bool = False):
    if effect not in EFFECTS:
        raise ValueError(f"no effect: {effect}")

    def add(f):
        code = f.__code__
        OPERATIONS[name] = Operation(name, code.co_varnames[1 : code.co_argcount + code.co_kwonlyargcount], outputs, effect, dry_run, idempotent, f)
        return f

    return add


class Workspace:
    """DataFrames by name: nodes, aliases, claims, relations, evidence, sources, syntheses, units, vectors, runs, mentions.

    Any may be missing; an operation that needs one then says so.  ``generation`` counts the rebuilds of the index.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], generation: int = 1, embed: EmbeddingProvider | None = None):
        self.spark, self.tables, self.generation, self.embed = spark, tables, generation, embed

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise LookupError(f"the workspace has no table {name}") from None

    def call(self, name: str, **inputs):
        """Runs an operation by name."""
        if name not in OPERATIONS:
            raise LookupError(f"no operation {name}")
        return OPERATIONS[name].run(self, **inputs)


def _one(ws: Workspace, table: str, key: str) -> DataFrame:
    return records.get(ws.spark.createDataFrame([(key,)], "id string"), getattr(ws, table))


@operation("node.get", "node")
def node_get(ws: Workspace, given: str) -> DataFrame:
    """By id, name or alias."""
    asked = ws.spark.createDataFrame([(0, given)], "qid int, given string")
    found = records.find_nodes(asked, ws.nodes.select(F.col("id").alias("node_id"), "name"), ws.aliases)
    return found.join(ws.nodes, found.node_id == ws.nodes.id).drop("qid", "node_id")


@operation("node.list", "nodes")
def node_list(ws: Workspace, node_types=None, tags=None, lifecycle=("active",)) -> DataFrame:
    return records.listed(ws.nodes, node_types=node_types, tags=tags, lifecycle=lifecycle)


@operation("node.related", "subgraph nodes")
def node_related(ws: Workspace, node: str) -> DataFrame:
    return graph_neighbors(ws, node, 1)


@operation("claim.get", "claim")
def claim_get(ws: Workspace, id: str) -> DataFrame:
    return _one(ws, "claims", id)


@operation("claim.list", "claims")
def claim_list(ws: Workspace, lifecycle=("active",), evidence_status=None, source_ids=None) -> DataFrame:
    return records.listed(ws.claims, lifecycle=lifecycle, evidence_status=evidence_status, source_ids=source_ids)


@operation("relation.get", "relation")
def relation_get(ws: Workspace, id: str) -> DataFrame:
    return _one(ws, "relations", id)


@operation("relation.list", "relations")
def relation_list(ws: Workspace, node: str | None = None, lifecycle=("active",)) -> DataFrame:
    rows = records.listed(ws.relations, lifecycle=lifecycle)
    return rows if node is None else rows.where((F.col("src") == node) | (F.col("dst") == node))


@operation("evidence.get", "evidence")
def evidence_get(ws: Workspace, id: str) -> DataFrame:
    return _one(ws, "evidence", id)


@operation("source.get", "source")
def source_get(ws: Workspace, id: str) -> DataFrame:
    return _one(ws, "sources", id)


@operation("source.list", "sources")
def source_list(ws: Workspace, history: bool = False) -> DataFrame:
    return ws.sources if history else ws.sources.where("removed_at IS NULL")


@operation("source.impact", "affected assertions and syntheses")
def source_impact(ws: Workspace, id: str) -> DataFrame:
    """(kind, id) in order: what rests on the source."""
    held = ws.evidence.where(F.col("source_id") == id).select("source_id", F.col("id").alias("evidence_id"), "kind", "assertion_id")
    told = held.select("kind", F.col("assertion_id").alias("id"), "evidence_id")
    syntheses = ws.syntheses.select("id", F.explode("evidence_ids").alias("evidence_id"), F.lit(None).cast("string").alias("assertion_id"))
    found = lineage.impact(held.select("source_id", "evidence_id"), told, syntheses)
    return found.select("kind", "id").withColumn("generation", F.lit(ws.generation)).orderBy("kind", "id")


@operation("source.remove", "affected assertions and syntheses", "canonical-write", dry_run=True, idempotent=True)
def source_remove(ws: Workspace, id: str) -> DataFrame:
    """What a removal would touch; the manifest itself is changed by the writer of its file."""
    return source_impact(ws, id)


@operation("synthesis.get", "synthesis")
def synthesis_get(ws: Workspace, id: str) -> DataFrame:
    return _one(ws, "syntheses", id)


@operation("synthesis.list", "syntheses")
def synthesis_list(ws: Workspace, limit: int = 20) -> DataFrame:
    return records.recent(ws.syntheses, "updated_at", "id", limit)


@operation("run.get", "run with the actions it allows")
def run_get(ws: Workspace, id: str) -> DataFrame:
    row = _one(ws, "runs", id)
    return row.withColumn("allowed_actions", records.allowed_actions(F.col("status"), F.col("attempts_left"), F.col("retryable")))


@operation("run.list", "runs")
def run_list(ws: Workspace, limit: int = 20) -> DataFrame:
    return records.recent(ws.runs, "started_at", "id", limit)


@operation("graph.neighbors", "subgraph nodes")
def graph_neighbors(ws: Workspace, node: str, depth: int = 1, direction: str = "both", allow=None, deny=None) -> DataFrame:
    return graph.neighbors(ws.relations, ws.spark.createDataFrame([(node,)], "root string"), depth, direction, allow, deny)


@operation("graph.subgraph", "edges among nodes")
def graph_subgraph(ws: Workspace, nodes: list) -> DataFrame:
    return graph.subgraph(ws.relations, ws.spark.createDataFrame([("0", n) for n in nodes], "group string, node string")).drop("group")


@operation("graph.path", "paths")
def graph_path(ws: Workspace, source: str, target: str, depth: int = 4, paths: int = 3, direction: str = "ignore") -> DataFrame:
    return graph.shortest_paths(ws.relations, ws.spark.createDataFrame([(source, target)], "source string, target string"), depth, paths, direction)


@operation("knowledge.search", "ranked units with the channels that ran")
def knowledge_search(ws: Workspace, query: str, limit: int = 20, record_types=None, lifecycle=("active",), tags=None) -> DataFrame:
    """The hybrid search; without an embedding provider, or without vectors, the text channels answer."""
    asked = ws.spark.createDataFrame([(0, query)], "qid long, query string")
    where = F.lit(True)
    for column, wanted in (("record_type", record_types), ("lifecycle_status", lifecycle)):
        where = where & F.col(column).isin(*wanted) if wanted is not None else where
    where = where & F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags is not None else where
    ran = {"word": search.rank_candidates(search.bm25(ws.units, asked, T.words, where=where)), "trigram": search.rank_candidates(search.bm25(ws.units, asked, T.trigrams, where=where))}
    if ws.embed is not None and "vectors" in ws.tables:
        keep = ws.vectors.join(ws.units.where(where).select("unit_id"), "unit_id", "left_semi")
        near = V.knn(keep.select("id", "v"), ws.embed.embed(asked), 100)
        ran["vector"] = near.join(ws.vectors.select("id", "unit_id"), "id").select("qid", "unit_id", "score", "rank")
    final = search.with_boosts(search.fuse(ran), ws.units, asked)
    wanted = ws.spark.createDataFrame([(0, query.strip())], "qid long, unit_id string")
    ordered = search.final_order(search.with_exact_ids(final, ws.units, wanted, where)).where(F.col("position") <= limit)
    return ordered.select("unit_id", "tier", "normalized", "final", "position").withColumn("channels", F.array(*map(F.lit, ran))).orderBy("position")


@operation("knowledge.ask", "evidence bundle and its omissions", "runtime-write", idempotent=True)
def knowledge_ask(ws: Workspace, query: str, size: int = 20, budget: int = 4000) -> tuple[DataFrame, DataFrame]:
    """The bundle that a model would answer from; what it cites is then checked by ``evidence.unknown_citations``."""
    hits = knowledge_search(ws, query, 100).select(F.lit(0).alias("qid"), "unit_id", F.col("position").alias("rank"))
    u = ws.units.select("unit_id", F.concat_ws(",", "tags").alias("source"), F.col("unit_id").alias("revision"), F.lit(0).alias("s"), F.length("body").alias("e"), T.token_estimate(F.col("body")).alias("tokens"), (F.col("body") != "").alias("available"), F.lit(None).cast("string").alias("side"))
    return evidence.bundle(hits.join(u, "unit_id"), size, 0.5, budget)


@operation("schema.list", "operations")
def schema_list(ws: Workspace) -> DataFrame:
    rows = [(o.name, list(o.inputs), o.outputs, o.effect, o.dry_run, o.idempotent) for o in OPERATIONS.values()]
    return ws.spark.createDataFrame(rows, "operation string, inputs array<string>, outputs string, effect string, dry_run boolean, idempotent boolean")


@operation("status", "rows of each table and the generation")
def status(ws: Workspace) -> DataFrame:
    out = None
    for name, df in sorted(ws.tables.items()):
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(ws.generation).alias("generation"))
        out = part if out is None else out.unionByName(part)
    return out


@operation("capabilities", "what a search can use")
def capabilities(ws: Workspace) -> dict[str, bool]:
    return {"word_fts": "units" in ws.tables, "trigram_fts": "units" in ws.tables, "vector": "vectors" in ws.tables and ws.embed is not None, "graph_paths": "relations" in ws.tables}
