"""Graph queries: TPC-H rows are the nodes, their foreign keys the typed relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import curate, graph
from evigraph.plans.registry import Tables, query

_ID = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def edges(t: Tables, distinct: bool = True):
    """The typed relations; traversals need no distinct rows and read them as they are."""

    def e(df, src, predicate, dst, status=None):
        return df.select(src.alias("src"), F.lit(predicate).alias("predicate"), dst.alias("dst"), F.lit(predicate != "related_to").alias("directed"), (status if status is not None else F.lit("supported")).alias("evidence_status"))

    flag = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "N", "uncertain").otherwise("conflicting")
    parts = [
        e(t.nation, _ID("nation", "n_nationkey"), "part_of", _ID("region", "n_regionkey")),
        e(t.customer, _ID("customer", "c_custkey"), "located_in", _ID("nation", "c_nationkey")),
        e(t.supplier, _ID("supplier", "s_suppkey"), "located_in", _ID("nation", "s_nationkey")),
        e(t.orders, _ID("order", "o_orderkey"), "placed_by", _ID("customer", "o_custkey")),
        e(t.lineitem, _ID("order", "l_orderkey"), "contains", _ID("part", "l_partkey"), flag),
        e(t.lineitem, _ID("part", "l_partkey"), "supplied_by", _ID("supplier", "l_suppkey"), flag),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if distinct else out


_E = """e AS (SELECT DISTINCT * FROM (
SELECT 'nation:' || n_nationkey AS src, 'part_of' AS predicate, 'region:' || n_regionkey AS dst, 'supported' AS st FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'located_in', 'nation:' || c_nationkey, 'supported' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, 'supported' FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, 'supported' FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'N' THEN 'uncertain' ELSE 'conflicting' END FROM lineitem
UNION ALL SELECT 'part:' || l_partkey, 'supplied_by', 'supplier:' || l_suppkey, CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'N' THEN 'uncertain' ELSE 'conflicting' END FROM lineitem)),
s AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b, predicate FROM e UNION ALL SELECT dst, src, predicate FROM e) WHERE {where}),
r AS (SELECT 'customer:' || c_custkey AS root FROM customer WHERE c_custkey % 50 = 0)"""


def roots(t):
    return t.customer.where("c_custkey % 50 = 0").select(_ID("customer", "c_custkey").alias("root"))


@query("graph_edges", "WITH " + _E.format(where="true") + " SELECT src, predicate, dst, st AS evidence_status FROM e")
def _(t):
    return edges(t).select("src", "predicate", "dst", "evidence_status")


@query("graph_inverse", "WITH " + _E.format(where="true") + ", d AS (SELECT DISTINCT src, predicate, dst FROM e) SELECT predicate, derived, count(*) AS n FROM (SELECT src, predicate, dst, false AS derived FROM d UNION ALL SELECT dst, CASE predicate WHEN 'placed_by' THEN 'placed' ELSE 'supplies' END, src, true FROM d WHERE predicate IN ('placed_by', 'supplied_by')) GROUP BY ALL")
def _(t):
    dim = t.spark.createDataFrame([("placed_by", "placed"), ("supplied_by", "supplies"), ("part_of", None)], "predicate string, inverse string")
    return graph.with_inverse(edges(t).select("src", "predicate", "dst").distinct(), dim).groupBy("predicate", "derived").agg(F.count("*").alias("n"))


def _bfs(depth: int) -> str:
    levels = ["n0 AS (SELECT root, root AS node, 0 AS depth FROM r)"]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT root, node FROM n{i}" for i in range(d))
        levels.append(f"n{d} AS (SELECT DISTINCT n{d - 1}.root, s.b AS node, {d} AS depth FROM n{d - 1} JOIN s ON s.a = n{d - 1}.node WHERE (n{d - 1}.root, s.b) NOT IN ({before}))")
    union = " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(depth + 1))
    return ", " + ", ".join(levels) + f", z AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS i, count(*) OVER (PARTITION BY root) > 500 AS truncated FROM ({union})) SELECT root, node, CAST(depth AS BIGINT) AS depth, truncated FROM z WHERE i <= 500"


@query("graph_neighbors_1", "WITH " + _E.format(where="true") + _bfs(1))
def _(t):
    return graph.neighbors(edges(t, False), roots(t), 1)


@query("graph_neighbors_2_capped", "WITH " + _E.format(where="true") + _bfs(2))
def _(t):
    return graph.neighbors(edges(t, False), roots(t), 2)


@query("graph_neighbors_denied", "WITH " + _E.format(where="predicate <> 'placed_by'") + _bfs(2))
def _(t):
    return graph.neighbors(edges(t, False), roots(t), 2, deny=["placed_by"])


_PATHS = "WITH " + _E.format(where="predicate IN ('located_in', 'part_of')") + """, p AS (SELECT 'customer:' || c_custkey AS source, 'supplier:' || (c_custkey % (SELECT count(*) FROM supplier)) AS target FROM customer WHERE c_custkey % 50 = 0),
st AS (SELECT src AS a, dst AS b, predicate FROM e WHERE predicate IN ('located_in', 'part_of') UNION SELECT dst, src, predicate FROM e WHERE predicate IN ('located_in', 'part_of')),
w0 AS (SELECT source, target, source AS here, [source] AS nodes, []::VARCHAR[] AS predicates FROM p), """ + ", ".join(
    f"w{d} AS (SELECT source, target, b AS here, list_append(nodes, b) AS nodes, list_append(predicates, predicate) AS predicates FROM w{d - 1} JOIN st ON a = here WHERE NOT list_contains(nodes, b) AND here <> target)" for d in range(1, 5)
) + ", f AS (" + " UNION ALL ".join(f"SELECT source, target, {d} AS length, nodes, predicates FROM w{d} WHERE here = target" for d in range(1, 5)) + """), g AS (SELECT *, min(length) OVER (PARTITION BY source, target) AS least FROM f)
SELECT source, target, CAST(length AS BIGINT) AS length, array_to_string(nodes, ' ') AS path, row_number() OVER (PARTITION BY source, target ORDER BY predicates, nodes) AS rank FROM g WHERE length = least QUALIFY rank <= 3"""


@query("graph_paths_filtered", _PATHS)
def _(t):
    n = t.supplier.count()
    pairs = t.customer.where("c_custkey % 50 = 0").select(_ID("customer", "c_custkey").alias("source"), F.concat(F.lit("supplier:"), (F.col("c_custkey") % n).cast("string")).alias("target"))
    found = graph.shortest_paths(edges(t, False).where(F.col("predicate").isin("located_in", "part_of")), pairs)
    return found.select("source", "target", "length", F.array_join("nodes", " ").alias("path"), "rank")


@query("graph_neighbors_allowed", "WITH " + _E.format(where="predicate IN ('placed_by', 'contains')") + _bfs(2))
def _(t):
    return graph.neighbors(edges(t, False), roots(t), 2, allow=["placed_by", "contains"])


@query("graph_neighborhood_edges", "WITH " + _E.format(where="true") + _bfs(1).replace("SELECT root, node, CAST", ", k AS (SELECT root, node, CAST").rstrip() + """),
x AS (SELECT DISTINCT a.root, e.src, e.predicate, e.dst FROM e JOIN k AS a ON a.node = e.src JOIN k AS b ON b.node = e.dst AND b.root = a.root)
SELECT root, src, predicate, dst FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY src, predicate, dst) AS i FROM x) WHERE i <= 1000""")
def _(t):
    _, inside, _ = graph.neighborhood(edges(t, False), roots(t), 1)
    return inside.select(F.col("group").alias("root"), "src", "predicate", "dst")


@query("graph_neighborhood_limits", "WITH " + _E.format(where="true") + _bfs(2).replace("SELECT root, node, CAST", ", k AS (SELECT root, node, CAST").rstrip() + """),
x AS (SELECT DISTINCT a.root, e.src, e.predicate, e.dst FROM e JOIN k AS a ON a.node = e.src JOIN k AS b ON b.node = e.dst AND b.root = a.root),
c AS (SELECT root, count(*) AS n FROM x GROUP BY root), m AS (SELECT root, count(*) AS n_nodes, bool_or(truncated) AS cut FROM k GROUP BY root)
SELECT root, n_nodes, least(coalesce(n, 0), 1000) AS n_edges, cut OR coalesce(n, 0) > 1000 AS truncated, CASE WHEN cut THEN 'max_nodes' WHEN n > 1000 THEN 'max_edges' END AS reason FROM m LEFT JOIN c USING (root)""")
def _(t):
    return graph.neighborhood(edges(t, False), roots(t), 2)[2].select("root", "n_nodes", "n_edges", "truncated", "reason")


_SHORTEST = "WITH " + _E.format(where="true") + """, p AS (SELECT 'customer:' || c_custkey AS source, 'part:' || (c_custkey % (SELECT count(*) FROM part)) AS target FROM customer WHERE c_custkey % 50 = 0),
st AS (SELECT src AS a, dst AS b, predicate, CASE st WHEN 'supported' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END AS s FROM e UNION SELECT dst, src, predicate, CASE st WHEN 'supported' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END FROM e),
w0 AS (SELECT source, target, source AS here, [source] AS nodes, []::VARCHAR[] AS predicates, []::INTEGER[] AS sts FROM p), """ + ", ".join(
    f"w{d} AS MATERIALIZED (SELECT source, target, b AS here, list_append(nodes, b) AS nodes, list_append(predicates, predicate) AS predicates, list_append(sts, s) AS sts FROM w{d - 1} JOIN st ON a = here WHERE NOT list_contains(nodes, b) AND here <> target)" for d in range(1, 4)
) + ", f AS (" + " UNION ALL ".join(f"SELECT source, target, {d} AS length, nodes, predicates, sts FROM w{d} WHERE here = target" for d in range(1, 4)) + """), g AS (SELECT *, min(length) OVER (PARTITION BY source, target) AS least FROM f)
SELECT source, target, CAST(length AS BIGINT) AS length, array_to_string(nodes, ' ') AS path, row_number() OVER (PARTITION BY source, target ORDER BY sts, predicates, nodes) AS rank FROM g WHERE length = least QUALIFY rank <= 3"""


@query("graph_shortest_paths", _SHORTEST)
def _(t):
    n = t.part.count()
    pairs = t.customer.where("c_custkey % 50 = 0").select(_ID("customer", "c_custkey").alias("source"), F.concat(F.lit("part:"), (F.col("c_custkey") % n).cast("string")).alias("target"))
    return graph.shortest_paths(edges(t, False), pairs, 3).select("source", "target", "length", F.array_join("nodes", " ").alias("path"), "rank")


@query("run_parent_chain", "WITH RECURSIVE r AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS parent_id FROM events), c AS (SELECT id AS start, 0::BIGINT AS step, id FROM r WHERE id % 50 = 0 UNION ALL SELECT c.start, c.step + 1, r.parent_id FROM c JOIN r ON r.id = c.id WHERE r.parent_id IS NOT NULL) SELECT start, step, id FROM c")
def _(t):
    from pyspark.sql.window import Window as W

    before = F.lag("event_id").over(W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    runs = t.events.select(F.col("event_id").alias("id"), before.alias("parent_id"))
    return graph.chain(runs, runs.where("id % 50 = 0"))


@query("graph_subgraph", "WITH " + _E.format(where="true") + """, g AS (SELECT 'region:' || n_regionkey AS grp, 'nation:' || n_nationkey AS node FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region UNION ALL SELECT 'region:' || n_regionkey, 'customer:' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
z AS (SELECT a.grp AS "group", e.src, e.predicate, e.dst, row_number() OVER (PARTITION BY a.grp ORDER BY src, predicate, dst) AS i FROM (SELECT DISTINCT src, predicate, dst FROM e) AS e JOIN g AS a ON a.node = e.src JOIN g AS b ON b.node = e.dst AND a.grp = b.grp) SELECT "group", src, predicate, dst FROM z WHERE i <= 1000""")
def _(t):
    n = t.nation
    nodes = n.select(_ID("region", "n_regionkey").alias("group"), _ID("nation", "n_nationkey").alias("node")).unionByName(t.region.select(_ID("region", "r_regionkey").alias("group"), _ID("region", "r_regionkey").alias("node")))
    nodes = nodes.unionByName(t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(_ID("region", "n_regionkey").alias("group"), _ID("customer", "c_custkey").alias("node")))
    return graph.subgraph(edges(t), nodes)


@query("graph_degree", "WITH " + _E.format(where="true") + " SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def _(t):
    return graph.degrees(edges(t))


@query("graph_dag_cycles", "WITH RECURSIVE x AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'nation:' || min(n_nationkey) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey), c AS (SELECT src AS root, dst AS node FROM x UNION SELECT root, dst FROM c JOIN x ON x.src = c.node), y AS (SELECT DISTINCT root FROM c WHERE root = node) SELECT DISTINCT c.root AS node FROM c WHERE node IN (SELECT root FROM y)")
def _(t):
    n = t.nation
    up = n.select(_ID("nation", "n_nationkey").alias("src"), _ID("region", "n_regionkey").alias("dst"))
    down = n.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.min("n_nationkey").alias("k")).select(_ID("region", "r_regionkey").alias("src"), _ID("nation", "k").alias("dst"))
    return graph.cyclic(up.unionByName(down))


@query("relations_merge", "SELECT 'part:' || l_partkey AS source, 'supplied_by' AS predicate, 'supplier:' || l_suppkey AS target, l_returnflag AS qualifiers, min(l_orderkey) AS id, count(*) AS merged, count(DISTINCT l_linenumber) AS n_evidence FROM lineitem GROUP BY ALL")
def _(t):
    return curate.merge_relations(t.lineitem.select(_ID("part", "l_partkey").alias("source"), F.lit("supplied_by").alias("predicate"), _ID("supplier", "l_suppkey").alias("target"), F.col("l_returnflag").alias("qualifiers"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("evidence_id")))


@query("relation_endpoint_types", "WITH " + _E.format(where="true") + ", d AS (SELECT * FROM (VALUES ('part_of', 'nation', 'region'), ('located_in', 'customer', 'nation'), ('placed_by', 'order', 'customer'), ('contains', 'order', 'part'), ('supplied_by', 'part', 'supplier')) AS d(predicate, s, t)) SELECT DISTINCT src, e.predicate, dst FROM e JOIN d USING (predicate) WHERE split_part(src, ':', 1) <> s OR split_part(dst, ':', 1) <> t")
def _(t):
    dim = t.spark.createDataFrame([("part_of", "nation", "region"), ("located_in", "customer", "nation"), ("placed_by", "order", "customer"), ("contains", "order", "part"), ("supplied_by", "part", "supplier")], "predicate string, s string, t string")
    kind = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return edges(t).join(F.broadcast(dim), "predicate").where((kind(F.col("src")) != F.col("s")) | (kind(F.col("dst")) != F.col("t"))).select("src", "predicate", "dst").distinct()
