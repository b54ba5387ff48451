"""Near vectors by a robust-pruned flat graph.

1. Equal vectors are one node with a weight.  Cluster centres are fitted on a bounded sample (``SAMPLE_ROWS`` a centre, at most
   ``SAMPLE_BYTES``); every node goes to the shards of its ``NEAREST`` nearest centres.
2. In each shard a graph is built: nodes are inserted in batches, a greedy search from the medoids of its parts finds what each meets, and robust
   pruning keeps the neighbours that no kept one stands in front of.  The lists of a node in all its shards are united.
3. In each shard every member is searched: greedily from the medoids, then on through everything within ``EXPAND`` of it
   until nothing new is in range.  Links are verified in double precision.  A pair that meets in several shards counts in
   the first of them.  A link found from either side counts for both.
4. Components run over (node, least node it reaches in the shard), one row a member, not over pairs.

Crowds: vectors within half the angle of the threshold of one centre are all linked with each other (triangle inequality).  Where the sample shows such a
centre and more than ``SHARD`` nodes lie that close, these core nodes are not searched against each other: they are
counted, and split into blocks.  Only nodes within one and a half angles of the centre can link with
a core node; they are searched in the graphs of all blocks.  So no shard holds a crowd, and no link is lost by it.

Graph search is approximate; ``audit`` measures its recall by comparing ``AUDIT`` sampled nodes with all others.  The
index covers all rows.  Links that are reported are always right.

Edge cases: null and zero vectors and those with null or non-finite components link with nothing, as do
vectors that have another length than most.  Repeated rows are rows of their own and link with each other.  A null id is never a component's
name unless all its ids are null.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch
from evigraph.llm.simhash import components

THRESHOLD = 0.9  # cosine of linked vectors
SHARD = 1_000  # nodes of a shard, before overlap
SAMPLE_ROWS, SAMPLE_BYTES = 16, 64_000_000  # of the sample that centres are fitted on: rows a centre, and bytes at most
NEAREST = 4  # shards of a node
DEGREE, BEAM, WIDTH, ALPHA = 24, 32, 4, 1.2  # neighbours of a node, beam of a search, nodes expanded together, pruning factor
EXPAND = 0.05  # a range search goes on through nodes this much below the threshold
PASSES, MEDOIDS = 2, 128  # times that each node is inserted, medoids (of parts of the shard) that a search starts from
BATCH = 256  # searches that run together
AUDIT = 1_024
SEEN = 8  # sampled vectors close to a centre that make it a candidate for a crowd


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """A robust-pruned graph over unit vectors; ``near`` has the neighbours of each, padded with -1."""

    def __init__(self, x: np.ndarray, near: np.ndarray | None = None):
        self.x, self.small, n = x, x.astype(np.float32), len(x)
        order = np.random.default_rng(1).permutation(n)
        label = np.concatenate([(self.small[k : k + 4096] @ self.small[order[:MEDOIDS]].T).argmax(1) for k in range(0, n, 4096)]) if n else order
        parts = [np.flatnonzero(label == k) for k in np.unique(label)]
        self.medoids = np.array([part[(self.small[part] @ self.small[part].mean(0)).argmax()] for part in parts], np.int32)
        self.near = near
        if near is None:
            self.near = np.full((n, 2 * DEGREE), -1, np.int32)
            for _ in range(PASSES):
                done = 0
                while done < n:
                    some = order[done : done + min(max(done, 1), BATCH)]
                    self._insert(some)
                    done += len(some)

    def greedy(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from the medoids: nodes and similarities of the final beams."""
        b, n = len(queries), len(self.x)
        ids, sim, open_ = np.full((b, BEAM), -1, np.int32), np.full((b, BEAM), -np.inf, np.float32), np.zeros((b, BEAM), bool)
        met = np.zeros((b, n), bool)
        start = queries @ self.small[self.medoids].T
        first = np.argsort(-start, axis=1)[:, :BEAM]
        k = first.shape[1]
        ids[:, :k], sim[:, :k], open_[:, :k] = self.medoids[first], np.take_along_axis(start, first, 1), True
        met[np.arange(b)[:, None], ids[:, :k]] = True
        while len(rows := np.flatnonzero(open_.any(1))):
            first = np.argsort(np.where(open_[rows], -sim[rows], np.inf), axis=1)[:, :WIDTH]
            at = (rows[:, None], first)
            now = np.where(open_[at], ids[at], -1)
            open_[at] = False
            found = np.where(now[:, :, None] >= 0, self.near[now], -1).reshape(len(rows), -1)
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[met[rows[:, None], found] | (found < 0)] = -1
            r, c = np.nonzero(found >= 0)
            new = found[r, c]
            met[rows[r], new] = True
            s = np.full(found.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("nd,nd->n", queries[rows[r]], self.small[new])
            ids_, sim_, left = np.concatenate((ids[rows], found), 1), np.concatenate((sim[rows], s), 1), np.concatenate((open_[rows], s > -np.inf), 1)
            best = np.argpartition(-sim_, BEAM - 1, axis=1)[:, :BEAM]
            take = (np.arange(len(rows))[:, None], best)
            ids[rows], sim[rows], open_[rows] = ids_[take], sim_[take], left[take]
        return ids, sim

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """So many candidates of each node: first the nearest, without those that a kept one is ALPHA times nearer to; then the nearest
        of the rest (else all copies of one vector would hang on that vector alone)."""
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        v = self.small[candidates]
        own = 2 - 2 * (v @ self.small[nodes][:, :, None])[:, :, 0]
        left = np.where((candidates < 0) | (candidates == nodes[:, None]), np.inf, own)
        kept, rows, rest = np.full((len(nodes), most), -1, np.int32), np.arange(len(nodes)), left.copy()
        for k in range(most):
            at = left.argmin(1)
            some = np.isfinite(left[rows, at])
            if not some.any():
                break
            kept[some, k] = candidates[rows, at][some]
            rest[rows[some], at[some]] = np.inf
            between = 2 - 2 * (v @ v[rows, at][:, :, None])[:, :, 0]
            left[ALPHA**2 * between <= own] = np.inf
            left[rows, at] = np.inf
        order = np.argsort(rest, axis=1)[:, :most]
        more = np.where(np.isfinite(np.take_along_axis(rest, order, 1)), np.take_along_axis(candidates, order, 1), -1)
        free = np.cumsum(kept < 0, axis=1) - 1
        return np.where(kept < 0, np.take_along_axis(more, np.minimum(np.maximum(free, 0), more.shape[1] - 1), 1), kept)

    def _insert(self, nodes: np.ndarray) -> None:
        ids, _ = self.greedy(self.small[nodes])
        kept = self.prune(nodes, np.concatenate((ids, self.near[nodes]), 1), DEGREE)
        self.near[nodes] = -1
        self.near[nodes, :DEGREE] = kept
        back = np.stack((kept.ravel(), np.repeat(nodes, DEGREE).astype(np.int32)), 1)
        back = back[back[:, 0] >= 0]
        back = back[np.argsort(back[:, 0], kind="stable")]
        to, start, n = np.unique(back[:, 0], return_index=True, return_counts=True)
        wide = np.full((len(to), self.near.shape[1] + n.max(initial=0)), -1, np.int32)
        wide[:, : self.near.shape[1]] = self.near[to]
        wide[np.repeat(np.arange(len(to)), n), self.near.shape[1] + np.arange(len(back)) - np.repeat(start, n)] = back[:, 1]
        wide = -np.sort(-wide, axis=1)  # what there is comes first, once
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        wide = -np.sort(-wide, axis=1)
        full = wide[:, self.near.shape[1] :].max(1, initial=-1) >= 0
        self.near[to] = wide[:, : self.near.shape[1]]
        if full.any():
            self.near[to[full]] = -1
            self.near[to[full], :DEGREE] = self.prune(to[full], wide[full], DEGREE)

    def _beyond(self, q: np.ndarray, node: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of (query, node) that the query has not met, which are then met; in parts, so that a crowd's lists are never spread out together."""
        out, n = [np.empty(0, np.int64)], len(self.x)
        for k in range(0, len(q), 16_384):
            near = self.near[node[k : k + 16_384]]
            row, at = np.nonzero(near >= 0)
            who, to = q[k + row], near[row, at].astype(np.int64)
            new = ~met[who, to]
            pair = np.unique(who[new] * n + to[new])
            met[pair // n, pair % n] = True
            out.append(pair)
        pair = np.concatenate(out)
        return pair // n, pair % n

    def in_range(self, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) for the nodes found at this cosine or above, by range-expanding greedy search."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        if not len(self.x):
            return out[0]
        for low in range(0, len(queries), BATCH):
            exact = queries[low : low + BATCH]
            ids, sim = self.greedy(exact.astype(np.float32))
            q, at = np.nonzero(sim >= threshold - EXPAND)
            node, met = ids[q, at].astype(np.int64), np.zeros((len(exact), len(self.x)), bool)
            met[q, node] = True
            while len(q):
                s = np.empty(len(q))
                for k in range(0, len(q), 65_536):
                    s[k : k + 65_536] = np.einsum("nd,nd->n", exact[q[k : k + 65_536]], self.x[node[k : k + 65_536]])
                out.append((q[s >= threshold] + low, node[s >= threshold]))
                on = s >= threshold - EXPAND
                q, node = self._beyond(q[on], node[on], met)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each one's component, over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that both rows have (rows are padded with -1)."""
    same = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(2)
    return np.where(same, a, np.iinfo(a.dtype).max).min(1)


def _build(key, rows):
    """The neighbours of a shard's nodes."""
    node = rows["node"].to_numpy()
    near = Graph(unit(matrix(rows["v"]))).near
    lists = pa.array([node[x[x >= 0]] for x in near], pa.list_(pa.int64()))
    return pa.table({"node": node, "near": lists})


def _search(threshold: float):
    def run(key, rows):
        """links (weight of the linked nodes that count in this shard) and the least node reached, of a shard's nodes."""
        shard, node, weight, x = key[0].as_py(), rows["node"].to_numpy(), rows["weight"].to_numpy(), unit(matrix(rows["v"]))
        n, order = len(node), np.argsort(node)
        near = rows["near"].combine_chunks()
        ends, flat = near.value_lengths().to_numpy(), near.flatten().to_numpy()
        at = np.minimum(np.searchsorted(node, flat, sorter=order), n - 1)
        local = np.where(node[order[at]] == flat, order[at], -1)  # united lists also name nodes of other shards
        wide = np.full((n, max(1, ends.max(initial=0))), -1, np.int32)
        wide[np.repeat(np.arange(n), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = local
        q, v = Graph(x, wide).in_range(x, threshold)
        pair = np.unique(np.minimum(q, v) * n + np.maximum(q, v))
        a, b = pair // n, pair % n
        a, b = a[a != b], b[a != b]
        shards = rows["shards"].combine_chunks()
        most = shards.value_lengths().to_numpy()
        own = np.full((n, most.max(initial=1)), -1, np.int64)
        own[np.repeat(np.arange(n), most), np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most)] = shards.flatten().to_numpy()
        links = np.zeros(n)
        for k in range(0, len(a), 65_536):
            s, t = a[k : k + 65_536], b[k : k + 65_536]
            here = first_common(own[s], own[t]) == shard
            links += np.bincount(s[here], weight[t[here]], n) + np.bincount(t[here], weight[s[here]], n)
        return pa.table({"node": node, "links": links.astype(np.int64), "root": node[lowest(n, a, b)]})

    return run


def _search_core(threshold: float):
    def run(key, rows):
        """The same for a block of a crowd's core and the nodes around it; links between core nodes are not looked for."""
        node, weight, x, core = rows["node"].to_numpy(), rows["weight"].to_numpy(), unit(matrix(rows["v"])), rows["core"].to_numpy(zero_copy_only=False)
        inside, outside = np.flatnonzero(core), np.flatnonzero(~core)
        q, v = Graph(x[inside]).in_range(x[outside], threshold)
        pair = np.unique(q * max(1, len(inside)) + v)
        a, b = outside[pair // max(1, len(inside))], inside[pair % max(1, len(inside))]
        n = len(node)
        links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        return pa.table({"node": node, "links": links.astype(np.int64), "root": node[lowest(n, a, b)]})

    return run


def fit(sample: np.ndarray, centres: int, threshold: float, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(centres, crowds): cluster centres of the sample's unit vectors, and centres with at least SEEN of them within half the threshold's angle."""
    half = math.cos(math.acos(threshold) / 2)
    middle, label = sample[:centres].copy(), None
    for _ in range(rounds + 1):
        label = np.concatenate([(sample[k : k + 4096] @ middle.T).argmax(1) for k in range(0, len(sample), 4096)])
        total = np.zeros_like(middle)
        np.add.at(total, label, sample)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        middle = np.where(size > 0, total / np.where(size > 0, size, 1), middle)
    crowds = []
    for k in range(len(middle)):
        own = sample[label == k]
        while len(own) >= SEEN:
            some = own[:4096]
            close = some @ own.T >= half
            best = close[close.sum(1).argmax()]
            if best.sum() < SEEN:
                break
            centre = own[best].sum(0)
            crowds.append(centre / np.sqrt(centre @ centre))
            own = own[~best]
    return middle, np.array(crowds).reshape(-1, sample.shape[1])


def near_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD, shard: int = SHARD, audited: int = AUDIT) -> tuple[DataFrame, float | None]:
    """(rows, recall): the key, n_links and component_id of every row, and the audited share of links found (None if the audit saw none)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = scratch.table(vectors.select(F.col(f"`{key}`").alias("id"), F.when(sound, F.col(f"`{vector}`")).alias("v")), "rows")
    lengths = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = lengths["n"] if lengths else 0
    usable = F.col("v").isNotNull() & (F.size("v") == length)
    nodes = rows.where(usable).groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.table(nodes, "nodes")
    n = nodes.count()
    if n:
        linked, recall = _linked(nodes, n, length, threshold, shard, audited, scratch)
    else:
        linked, recall = nodes.select(F.col("node").alias("key"), F.lit(0).cast("long").alias("links"), F.col("first").alias("component")), None
    of = nodes.join(linked, nodes.node == linked.key).select(F.col("v").alias("same"), "weight", "links", "component")
    of = scratch.table(of, "result")
    out = rows.join(of, rows.v == of.same, "left").select(
        F.col("id").alias(key), F.coalesce(F.col("weight") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id")
    )
    scratch.keep("rows", "result")
    return out, recall


def _linked(nodes: DataFrame, n: int, length: int, threshold: float, shard: int, audited: int, scratch: Scratch):
    spark, angle = nodes.sparkSession, math.acos(threshold)
    half, far = math.cos(angle / 2) + 1e-9, math.cos(min(math.pi, 1.5 * angle)) - 1e-9
    rows = min(SAMPLE_ROWS * -(-n // shard), max(SEEN, SAMPLE_BYTES // (4 * length)))
    by_hash = F.xxhash64("v")
    sample = nodes.where(F.pmod(by_hash, F.lit(2**40)) < int(min(1.0, 2 * rows / n) * 2**40)).orderBy(by_hash, "node").limit(max(rows, audited)).select("node", "v").toArrow()
    asked = sample["node"].to_numpy()
    sample = unit(matrix(sample["v"])) if len(sample) else np.zeros((0, length))
    centres, crowds = fit(sample[:rows], max(1, min(-(-n // shard), len(sample[:rows]))), threshold)
    if not len(centres):
        centres = np.eye(1, length)
    shared = spark.sparkContext.broadcast((centres, crowds))

    def cores(batches):
        """How many nodes, of which weight, are that close to each crowd's centre, and the least of them."""
        for batch in batches:
            best, s = nearest(unit(matrix(batch.column(1))), shared.value[1])
            k = best[s >= half]
            node, weight = batch.column(0).to_numpy()[s >= half], batch.column(2).to_numpy()[s >= half]
            for c in np.unique(k):
                yield pa.RecordBatch.from_pydict({"crowd": [int(c)], "n": [int((k == c).sum())], "weight": [int(weight[k == c].sum())], "least": [int(node[k == c].min())]})

    data = nodes.select("node", "v", "weight")
    found = []
    if len(crowds):
        found = data.mapInArrow(cores, "crowd long, n long, weight long, least long").groupBy("crowd").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("least").alias("least")).where(F.col("n") > shard).orderBy("crowd").collect()  # at most a row for SEEN sampled rows
    split = np.array([r["crowd"] for r in found], np.int64)
    blocks = np.array([-(-r["n"] // shard) for r in found], np.int64)

    def deal(batches):
        """Members of shards (number of the centre), and of blocks of crowds (below zero)."""
        middle, crowd = shared.value
        for batch in batches:
            node, x = batch.column(0).to_numpy(), unit(matrix(batch.column(1)))
            best, s = nearest(x, crowd)
            core = np.where((s >= half) & np.isin(best, split), np.searchsorted(split, best), -1)
            take, place, is_core, lists = [], [], [], []
            plain = np.flatnonzero(core < 0)
            at = x[plain] @ middle.T
            closest = np.sort(np.argsort(-at, axis=1, kind="stable")[:, :NEAREST], axis=1)
            take += np.repeat(plain, closest.shape[1]).tolist()
            place += closest.ravel().tolist()
            lists += [row for row in closest for _ in range(len(row))]
            is_core += [False] * len(take)
            for c in range(len(split)):
                mine = np.flatnonzero(core == c)
                base = -1 - int(blocks[:c].sum())
                take += mine.tolist()
                place += (base - (node[mine] * 2654435761 % 2**32) % blocks[c]).tolist()
                around = np.flatnonzero((x @ crowd[split[c]] >= far) & ((core < 0) | (core > c)))
                take += np.repeat(around, blocks[c]).tolist()
                place += np.tile(base - np.arange(blocks[c]), len(around)).tolist()
                is_core += [True] * len(mine) + [False] * (len(around) * int(blocks[c]))
                lists += [[]] * (len(mine) + len(around) * int(blocks[c]))
            # a node of a crowd also says which, once
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int64()), *(batch.column(i).take(pa.array(take, pa.int64())) for i in (0, 1, 2)), pa.array(is_core, pa.bool_()), pa.array(lists, pa.list_(pa.int64())), pa.array(core[take] if take else [], pa.int64())],
                names=["shard", "node", "v", "weight", "core", "shards", "crowd"],
            )

    kind = dict(nodes.dtypes)["v"]
    members = scratch.table(data.mapInArrow(deal, f"shard long, node long, v {kind}, weight long, core boolean, shards array<long>, crowd long"), "members")
    plain = members.where("shard >= 0").select("shard", "node", "v", "weight", "shards")
    flat = plain.groupBy("shard").applyInArrow(_build, "node long, near array<long>")
    flat = scratch.table(flat.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).withColumnRenamed("node", "of"), "graph")  # at most twice DEGREE a shard of the node
    reached = plain.join(flat, F.col("node") == F.col("of")).groupBy("shard").applyInArrow(_search(threshold), "node long, links long, root long")
    if len(split):
        told = spark.createDataFrame([(i, r["weight"], r["least"]) for i, r in enumerate(found)], "c int, total long, least long")
        own = members.where("core").join(F.broadcast(told), F.col("crowd") == F.col("c")).select("node", (F.col("total") - F.col("weight")).alias("links"), F.col("least").alias("root"))
        reached = reached.unionByName(own).unionByName(members.where("shard < 0").groupBy("shard").applyInArrow(_search_core(threshold), "node long, links long, root long"))
    reached = scratch.table(reached, "reached")
    links = reached.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(reached.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v"), scratch).withColumnRenamed("node", "of")
    named = scratch.table(nodes.join(roots, F.col("node") == F.col("of"), "left").select("node", "first", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    linked = named.select(F.col("node").alias("key"), F.col("root").alias("r")).join(least, F.col("r") == F.col("root")).join(links, F.col("key") == F.col("node")).select("key", "links", "component")
    linked = scratch.table(linked, "linked")
    return linked, audit(nodes, linked, asked[:audited], sample[:audited], threshold)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the cosine to it; none: -1 and minus infinity."""
    if not len(centres):
        return np.full(len(x), -1), np.full(len(x), -np.inf)
    s = x @ centres.T
    return s.argmax(1), s.max(1)


def audit(nodes: DataFrame, linked: DataFrame, asked: np.ndarray, sample: np.ndarray, threshold: float) -> float | None:
    """The share of the links of sampled nodes that were found, against a comparison with all nodes."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast((asked, sample))

    def run(batches):
        ids, queries = shared.value
        for batch in batches:
            node, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            total = np.zeros(len(ids))
            for low in range(0, len(node), 4096):
                some = node[low : low + 4096]
                near = unit(matrix(batch.column(1).slice(low, 4096))) @ queries.T >= threshold
                total += weight[low : low + 4096] @ (near & (some[:, None] != ids[None]))
            yield pa.RecordBatch.from_arrays([pa.array(total.astype(np.int64).sum()[None])], names=["total"])

    true = nodes.select("node", "v", "weight").mapInArrow(run, "total long").agg(F.sum("total")).first()[0]
    chosen = spark.createDataFrame([(int(i),) for i in asked], "asked long")
    found = linked.join(F.broadcast(chosen), F.col("key") == F.col("asked")).agg(F.sum("links")).first()[0]
    return min(1.0, found / true) if true else None


def op12_near_vectors(spark, sf_dir) -> DataFrame:
    rows, recall = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))


#: All pairs by brute force; exact search has a recall of 1 wherever there are links.
OP12_SQL = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS MATERIALIZED (SELECT vec_id, list_transform(x, lambda y: y::DOUBLE) AS x, sqrt(list_sum(list_transform(x, lambda y: y::DOUBLE * y::DOUBLE))) AS size FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n AS a JOIN n AS b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.size * b.size) >= {THRESHOLD}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
d AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, least(vec_id, coalesce(least, vec_id)) = vec_id AS kept, CASE WHEN sum(links) OVER () > 0 THEN 1.0::DOUBLE END AS audit_recall
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id"""
