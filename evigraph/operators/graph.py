"""Bounded property-graph operators over an edge table (src, predicate, dst, directed, kind, evidence_status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.constants import EVIDENCE_ORDER, MAX_EDGES, MAX_NEIGHBOR_DEPTH, MAX_NODES, MAX_PATH_DEPTH, MAX_PATHS
from evigraph.functions.scratch import Scratch

FEW = 500_000  # nodes that may be broadcast


def oriented(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """(a, b, predicate, forward): steps a traversal may take.  Undirected edges may be walked both ways in any direction."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "predicate", F.lit(True).alias("forward"), "directed", "evidence_status")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "predicate", F.lit(False).alias("forward"), "directed", "evidence_status")
    if direction == "outgoing":
        return out.unionByName(back.where("NOT directed"))
    if direction == "incoming":
        return back.unionByName(out.where("NOT directed"))
    return out.unionByName(back)


def with_inverse(edges: DataFrame, predicates: DataFrame) -> DataFrame:
    """The edges and, where the predicate has an inverse, the derived edges; nothing is stored."""
    derived = edges.join(F.broadcast(predicates.where("inverse IS NOT NULL").select("predicate", "inverse")), "predicate")  # one row a predicate of the schema pack
    return edges.select("src", "predicate", "dst", F.lit(False).alias("derived")).unionByName(derived.select(F.col("dst").alias("src"), F.col("inverse").alias("predicate"), F.col("src").alias("dst"), F.lit(True).alias("derived")))


def with_mentions(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(src, predicate, dst, kind) of the relations and of the weak edges from pages to what they mention (node_id, outcome, target), each once."""
    weak = mentions.where("outcome = 'mentions'").select(F.col("node_id").alias("src"), F.lit("mentions").alias("predicate"), F.col("target").alias("dst")).distinct()
    return edges.select("src", "predicate", "dst").distinct().withColumn("kind", F.lit("relation")).unionByName(weak.withColumn("kind", F.lit("mention")))


def allowed(edges: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """The edges whose predicate may be walked."""
    if allow is not None:
        edges = edges.where(F.col("predicate").isin(allow))
    return edges.where(~F.col("predicate").isin(deny)) if deny else edges


def neighbors(edges: DataFrame, roots: DataFrame, depth: int = 1, direction: str = "both", allow: list[str] | None = None, deny: list[str] | None = None, max_nodes: int = MAX_NODES) -> DataFrame:
    """(root, node, depth, truncated): breadth-first, each node at its least depth, cut after max_nodes by (depth, node).

    Each frontier is a table.  A hop reads the edges once, keeps those of frontier nodes, and of each such node only its first
    2 * max_nodes + 1 neighbours: a root takes at most max_nodes + 1 of them, and no more than max_nodes can be ones that it has
    already, so the rest of a hub's neighbours can't be in any result.  A root that holds more than max_nodes is not
    expanded any further, since what lies deeper comes later in the order.
    """
    if not 0 <= depth <= MAX_NEIGHBOR_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_NEIGHBOR_DEPTH}")
    steps, scratch = oriented(allowed(edges, allow, deny), direction).select("a", "b"), Scratch(edges.sparkSession, "neighbors")
    seen = scratch.table(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "0")
    frontier = seen
    for d in range(1, depth + 1):
        met = steps.join(frontier.select(F.col("node").alias("a")).distinct(), "a", "left_semi").distinct()
        first = met.withColumn("i", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("i") <= 2 * max_nodes + 1).select("a", "b")
        reached = frontier.join(first, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        fresh = reached.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        best = fresh.withColumn("i", F.row_number().over(W.partitionBy("root").orderBy("node"))).where(F.col("i") <= max_nodes + 1)
        layer = scratch.table(best.select("root", "node", F.lit(d).alias("depth")), str(d))
        seen = seen.unionByName(layer)
        open_ = seen.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= max_nodes).select("root")
        frontier = layer.join(open_, "root", "left_semi")
    w = W.partitionBy("root")
    placed = seen.withColumn("i", F.row_number().over(w.orderBy("depth", "node"))).withColumn("truncated", F.count("*").over(w) > max_nodes)
    return placed.where(F.col("i") <= max_nodes).select("root", "node", F.col("depth").cast("long").alias("depth"), "truncated")


def neighborhood(edges: DataFrame, roots: DataFrame, depth: int = 1, direction: str = "both", allow: list[str] | None = None, deny: list[str] | None = None, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (as ``neighbors``), edges (group = root, src, predicate, dst) among them, and per root the counts with the limits and the reason of a cut."""
    usable, scratch = allowed(edges, allow, deny), Scratch(edges.sparkSession, "neighborhood")
    nodes = scratch.table(neighbors(usable, roots, depth, direction, max_nodes=max_nodes), "nodes")
    inside = scratch.table(subgraph(usable, nodes.select(F.col("root").alias("group"), "node"), max_edges + 1), "edges")
    counts = inside.groupBy(F.col("group").alias("root")).agg(F.count("*").alias("n"))
    told = nodes.groupBy("root").agg(F.count("*").alias("n_nodes"), F.bool_or("truncated").alias("cut")).join(counts, "root", "left")
    n_edges = F.least(F.coalesce("n", F.lit(0)), F.lit(max_edges)).cast("long")
    reason = F.when(F.col("cut"), "max_nodes").when(F.col("n") > max_edges, "max_edges")
    summary = told.select("root", "n_nodes", n_edges.alias("n_edges"), (F.col("cut") | (F.coalesce("n", F.lit(0)) > max_edges)).alias("truncated"), reason.alias("reason"), F.lit(max_nodes).alias("max_nodes"), F.lit(max_edges).alias("max_edges"))
    w = W.partitionBy("group").orderBy("src", "predicate", "dst")
    return nodes, inside.withColumn("i", F.row_number().over(w)).where(F.col("i") <= max_edges).drop("i"), summary


def subgraph(edges: DataFrame, nodes: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Edges with both ends among the nodes of a group (group, node), cut by (src, predicate, dst)."""
    left = nodes.select("group", F.col("node").alias("src"))
    right = nodes.select(F.col("group").alias("g"), F.col("node").alias("d"))
    inside = edges.select("src", "predicate", "dst").distinct().join(left, "src").join(right, (F.col("group") == F.col("g")) & (F.col("dst") == F.col("d")))
    w = W.partitionBy("group").orderBy("src", "predicate", "dst")
    return inside.withColumn("i", F.row_number().over(w)).where(F.col("i") <= max_edges).select("group", "src", "predicate", "dst")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 4, paths: int = 3, direction: str = "ignore") -> DataFrame:
    """(source, target, length, nodes, predicates, rank): paths of the least length only, no node twice.

    Walks grow from both ends, on the side that has fewer, and one more step joins the two sides: it is looked up for the pairs of their last
    nodes, so a hub's neighbours are not walked to.  A side keeps only walks that reach a node at its least depth (the
    parts of a shortest path are shortest), each layer is a table, and a pair leaves both sides once it is found.  Ties go
    by the evidence status of the edges, then predicates, then node ids.
    """
    if not 1 <= depth <= MAX_PATH_DEPTH or not 1 <= paths <= MAX_PATHS:
        raise ValueError(f"depth must be 1 to {MAX_PATH_DEPTH}, paths 1 to {MAX_PATHS}")
    order, scratch = F.create_map(*[F.lit(x) for kv in EVIDENCE_ORDER.items() for x in kv]), Scratch(edges.sparkSession, "paths")
    way = "both" if direction == "ignore" else "outgoing"
    ahead = oriented(edges, way).select("a", "b", "predicate", order[F.col("evidence_status")].alias("status"))
    behind = ahead.select(F.col("b").alias("a"), F.col("a").alias("b"), "predicate", "status")
    key = ["source", "target"]
    start = lambda end: scratch.table(pairs.select(*key).where("source <> target").distinct().select(*key, F.col(end).alias("at"), F.array(end).alias("nodes"), F.array().cast("array<int>").alias("statuses"), F.array().cast("array<string>").alias("predicates")), f"{end}0")
    sides = {"source": [start("source")], "target": [start("target")]}
    sizes = {end: layers[0].count() for end, layers in sides.items()}
    near: dict[str, DataFrame] = {}  # steps from the nodes of a side's last layer
    found = []

    def unfound(walks: DataFrame) -> DataFrame:
        for x in found:
            walks = walks.join(x.select(*key).distinct(), key, "left_anti")
        return walks

    def steps(end: str) -> DataFrame:
        if end not in near:
            nodes = scratch.table(unfound(sides[end][-1]).select(F.col("at").alias("a")).distinct(), f"{end}-nodes{len(sides[end])}")
            few = F.broadcast(nodes) if nodes.count() <= FEW else nodes
            near[end] = scratch.table((ahead if end == "source" else behind).join(few, "a", "left_semi").distinct(), f"{end}-steps{len(sides[end])}")
        return near[end]

    def grow(end: str) -> None:
        layers, way_on, open_ = sides[end], steps(end), unfound(sides[end][-1])
        add = (lambda old, new: F.concat(old, F.array(new))) if end == "source" else (lambda old, new: F.concat(F.array(new), old))
        work = open_.groupBy(F.col("at").alias("a")).agg(F.count("*").alias("n")).join(way_on.groupBy("a").agg(F.count("*").alias("m")), "a").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        if work > 4 * way_on.count():
            # a hub in many walks: nothing goes on from nodes whose only neighbour is the hub
            ends, back = way_on.select(F.col("b").alias("a")).distinct(), ahead if end == "source" else behind
            ends = scratch.table(ends, f"{end}-ends{len(layers)}")
            two = back.join(F.broadcast(ends) if ends.count() <= FEW else ends, "a", "left_semi").groupBy(F.col("a").alias("b")).agg(F.min("b").alias("first"), F.max("b").alias("last"))
            way_on = scratch.table(way_on.join(two, "b").where("first <> a OR last <> a").drop("first", "last"), f"{end}-through{len(layers)}")
        seen = layers[0].select(*key, "at")
        for layer in layers[1:]:
            seen = seen.unionByName(layer.select(*key, "at"))
        walks = open_.join(way_on, F.col("at") == F.col("a")).select(*key, F.col("b").alias("at"), add("nodes", "b").alias("nodes"), add("statuses", "status").alias("statuses"), add("predicates", "predicate").alias("predicates"))
        layers.append(scratch.table(walks.distinct().join(seen.distinct(), [*key, "at"], "left_anti"), f"{end}{len(layers)}"))
        sizes[end] = layers[-1].count()
        near.pop(end)

    for length in range(1, depth + 1):
        if length > 1:  # the side with fewer walks grows
            grow(min(sides, key=lambda end: (sizes[end], len(sides[end]))))
        left, right = unfound(sides["source"][-1]), unfound(sides["target"][-1])
        right = right.select(*key, F.col("at").alias("to"), F.col("nodes").alias("rest"), F.col("statuses").alias("s"), F.col("predicates").alias("p"))
        # the step between the two sides: pairs of their nodes first, so that a hub's neighbours are not walked to
        end = "source" if sizes["source"] <= sizes["target"] else "target"
        here, there = ("at", "to") if end == "source" else ("to", "at")
        met = left.join(right, key).join(steps(end), (F.col(here) == F.col("a")) & (F.col(there) == F.col("b")))
        met = met.select(*key, F.lit(length).cast("long").alias("length"), F.concat("nodes", "rest").alias("nodes"), F.concat("statuses", F.array("status"), "s").alias("statuses"), F.concat("predicates", F.array("predicate"), "p").alias("predicates"))
        w = W.partitionBy(*key).orderBy("statuses", "predicates", "nodes")
        found.append(scratch.table(met.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= paths), f"found{length}"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("source", "target", "length", "nodes", "predicates", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree"), F.count("*").alias("degree"))


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes (node) on or behind a cycle.

    Each round is a table: edges to nodes without a successor go, and a node whose only successor has an
    only successor itself is linked to that one, which leads to a cycle exactly if the node does.  A chain
    thus takes as many rounds as its length has binary digits, and the loop ends when nothing goes any more.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    first = scratch.table(edges.select("src", "dst").distinct(), "0")
    left, n, i = first, first.count(), 0
    while n:
        i += 1
        kept = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        only = kept.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1")
        own, after = only.select(F.col("src").alias("own")), only.select(F.col("src").alias("after"), "to")
        jumped = kept.join(own, F.col("src") == F.col("own"), "left").join(after, F.col("dst") == F.col("after"), "left")
        left = scratch.table(jumped.select("src", F.when(F.col("own").isNotNull() & F.col("after").isNotNull(), F.col("to")).otherwise(F.col("dst")).alias("dst")), str(i))
        was, n = n, left.count()
        if i > 1:
            scratch.drop(str(i - 1))
        if n == was:
            break
    return left.select(F.col("src").alias("node")).distinct()


def chain(links: DataFrame, starts: DataFrame, most: int = 100) -> DataFrame:
    """(start, step, id): each id in starts and what it descends from, by (id, parent_id); raises if a chain is longer than ``most`` or runs in a circle."""
    scratch = Scratch(links.sparkSession, "chain")
    now = scratch.table(starts.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("step"), "id"), "0")
    out, parents = now, links.where("parent_id IS NOT NULL").select(F.col("id").alias("child"), "parent_id")
    for i in range(1, most + 2):
        now = scratch.table(now.join(parents, F.col("id") == F.col("child")).select("start", F.lit(i).cast("long").alias("step"), F.col("parent_id").alias("id")), str(i))
        if now.isEmpty():
            return out
        out = out.unionByName(now)
    raise RuntimeError(f"a chain has more than {most} steps")
