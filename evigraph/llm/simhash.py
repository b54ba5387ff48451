"""SimHash near-duplicates through sharded BK-trees.

A document's fingerprint holds, for each of its bits, the majority over the XXH64
values of its word shingles.  Fingerprints within a radius link; documents are grouped by the
connected components of these links.  Two settings share the code:

* ``groups``: 4-word shingles, 64 bits, radius 4.  Fingerprints are cut into six bands.  Two that differ
  in at most four bits agree in at least two bands, so each distinct fingerprint goes to 15 shards, one for each
  pair of bands, keyed by the pair's 20 to 22 bits.  No link is lost.
* ``near_groups``: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.  64 bits can't tell
  these from less similar ones, so four mixes of each XXH64 value make 256 bits; at a similarity of 0.8 a bit differs
  with probability acos(8/9)/pi = 0.15.  The radius is what 95 of 100 such pairs stay within.  Each distinct fingerprint
  goes to the shards of several tables, keyed by some of its bits; how many tables and bits follows from the number
  of fingerprints, so that a shard holds about ``SHARD`` unrelated ones and a pair at 0.8 meets with the same
  probability (0.95) at every size.  Recall is measured in the README.

Each shard is a BK-tree: children are keyed by their Hamming distance to the parent, and a search follows only the edges
whose key lies within the radius.  Shards reach their task by the shuffle and not
by a broadcast, since their size grows with the corpus.  The trees of many shards
are built and searched together, level by level, with array operations.

A shard reports a spanning forest of its links, never the pairs, so a group of copies costs
as many rows as it has distinct fingerprints.  A few points of each shard are searched first; from then on, points
of the shard's largest component are not searched any more, since a link that is still to be found
has an end outside of it.  A crowd of variants is thus not compared pair by pair.
Components are then found by alternating
large-star and small-star steps on tables in the shared folder.

Edge cases: null text counts as empty; texts without a word have fingerprint
zero and link like any other; texts of fewer words than a shingle are one shingle.
Equal fingerprints are one node.  Repeated rows keep their rows; a null doc_id
never is a component's id unless all are null; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, documents, fresh, numbered, values, whole_text

SHINGLE, RADIUS, SEED = 4, 4, 42
#: (shift, bits) of the bands.
BANDS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
PART = 1 << 14
CHUNK_ROWS = 1 << 17
FRONTIER = 1 << 19
LEADERS = 16  # points of a shard that are searched first
NEAR_SHINGLE, SIMILARITY, WORDS = 5, 0.8, 4
SHARD, MISSED = 64, 0.05
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def bits(text: str | None, shingle: int = SHINGLE, words_of_bits: int = 1) -> bytes:
    """SimHash of the text, 8 bytes a word of bits; all zero without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return bytes(8 * words_of_bits)
    joined, n = b" ".join(words), len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size).tolist(), ends.tolist()
    k = min(shingle, n)
    digest, total, ones = xxhash.xxh64_digest, n - k + 1, np.zeros(64 * words_of_bits, np.int64)
    for at in range(0, total, PART):
        to = min(total, at + PART)
        data = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + k - 1 : to + k - 1], strict=True)])
        if words_of_bits == 1:
            rows = np.frombuffer(data, np.uint8)
        else:
            h = np.frombuffer(data, ">u8").astype(np.uint64)
            rows = np.stack([_mixed(h, m) for m in _MIX[:words_of_bits]], axis=1).astype(">u8").view(np.uint8)
        ones += np.unpackbits(rows).reshape(-1, 64 * words_of_bits).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total).tobytes()


def _mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * by
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the text."""
    return int.from_bytes(bits(text), "big")


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, words_of_bits: int = 1) -> DataFrame:
    """The columns in ``keep`` and fp of every row: a signed long, or bytes where it has several words of bits."""
    keep = keep or ["doc_id"]
    text = fresh(docs, "__text")

    def run(batches):
        for batch in batches:
            found = [bits(t, shingle, words_of_bits) for t in values(batch.column(len(keep)))]
            fps = pa.array(found, pa.binary()) if words_of_bits > 1 else pa.array(np.frombuffer(b"".join(found), ">i8").astype(np.int64) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fps], names=[*keep, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], whole_text().alias(text)).mapInArrow(run, f"{schema}, fp {'binary' if words_of_bits > 1 else 'long'}")


def shard_keys(fp: str = "fp"):
    """array<long> of the shards of a fingerprint: number of the band pair, then the bits of both bands."""
    part = lambda band: F.shiftrightunsigned(fp, band[0]).bitwiseAND(F.lit((1 << band[1]) - 1).cast("long"))
    return F.array(*[F.lit(i << 22).cast("long").bitwiseOR(F.shiftleft(part(a), b[1])).bitwiseOR(part(b)) for i, (a, b) in enumerate(combinations(BANDS, 2))])


class Forest:
    """BK-trees over the fingerprints (rows of 64-bit words) of several shards, built level by level."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        """shard: number of the shard of each fingerprint, ascending from 0."""
        self.fps, self.span = fps, 64 * fps.shape[1] + 1
        self.root = np.searchsorted(shard, np.arange(shard[-1] + 1))[shard]
        rest = np.flatnonzero(self.root != np.arange(len(fps)))
        at, keys, children = self.root[rest], [], []
        while len(rest):
            key = at * self.span + self.distance(rest, at)
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            child = rest[order][first]  # the first to come with this distance becomes the child
            keys.append(ranked[first])
            children.append(child)
            to = child[np.cumsum(first) - 1]
            rest, at = rest[order][~first], to[~first]
        self.keys, self.children = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, children))
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(axis=1, dtype=np.int64)

    def search(self, queries: np.ndarray, radius: int):
        """Yields (query, found) arrays of points of the same shard within the radius; each point is searched from its root."""
        stack = [(queries, self.root[queries])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:  # bounds the memory of a level
                half = len(q) // 2
                stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = self.distance(q, node)
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.keys, node * self.span + np.maximum(d - radius, 1))
            n = np.searchsorted(self.keys, node * self.span + np.minimum(d + radius, self.span - 1), "right") - low
            total = np.cumsum(n)
            if len(total) and total[-1]:
                below = np.repeat(low - (total - n), n) + np.arange(total[-1])
                stack.append((np.repeat(q, n), self.children[below]))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least point of each component after the links a-b were added."""
    while True:  # hook the greater root to the smaller, then shorten the paths
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while True:
            short = label[label]
            if np.array_equal(short, label):
                break
            label = short


def spanning_links(shard: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(point, representative) for each point that is not its component's representative."""
    forest, label = Forest(shard, fps), np.arange(len(fps))
    place = np.arange(len(fps)) - forest.root
    for a, b in forest.search(np.flatnonzero(place < LEADERS), radius):
        label = join_labels(label, a, b)

    def outside() -> np.ndarray:
        """True for points that are not in the largest component of their shard."""
        roots = np.flatnonzero(label == np.arange(len(label)))
        roots = roots[np.lexsort((-np.bincount(label, minlength=len(label))[roots], shard[roots]))]
        return label != roots[np.searchsorted(shard[roots], shard)]

    rest = np.flatnonzero((place >= LEADERS) & outside())
    for at in range(0, len(rest), 1 << 13):
        some = rest[at : at + (1 << 13)]
        some = some[outside()[some]]  # links found meanwhile
        for a, b in forest.search(some, radius):
            label = join_labels(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return linked, label[linked]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that connect all distinct 64-bit fingerprints (column fp) as the full set of links does."""
    return spanned(nodes.select(F.explode(shard_keys()).alias("shard"), "fp"), radius)


def differing(similarity: float) -> float:
    """Probability that a bit differs between two equally large sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def near_radius(similarity: float = SIMILARITY, n_bits: int = 64 * WORDS) -> int:
    """Differing bits that 95 of 100 pairs of this similarity stay within."""
    p = differing(similarity)
    return math.floor(n_bits * p + 1.645 * math.sqrt(n_bits * p * (1 - p)))


def near_tables(count: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(bits of a key, tables) for so many fingerprints; one shard of all while they are few."""
    n = max(0, math.ceil(math.log2(max(1, count) / SHARD)))
    return n, math.ceil(math.log(MISSED) / math.log(1 - (1 - differing(similarity)) ** n)) if n else 1


def near_links(nodes: DataFrame, count: int, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v) over distinct 256-bit fingerprints (column fp, bytes); ``count``: how many there are."""
    n_bits, tables = near_tables(count, similarity)
    rng = np.random.default_rng(0)
    chosen = [np.sort(rng.choice(64 * WORDS, n_bits, replace=False)) for _ in range(tables)]

    def deal(batches):
        powers = np.int64(1) << np.arange(n_bits, dtype=np.int64)
        for batch in batches:
            fp = batch.column(0)
            on = np.unpackbits(_bytes(fp), axis=1)
            for k, places in enumerate(chosen):
                key = on[:, places].astype(np.int64) @ powers + (k << 48)
                yield pa.RecordBatch.from_arrays([pa.array(key), fp], names=["shard", "fp"])

    return spanned(nodes.select("fp").mapInArrow(deal, "shard long, fp binary"), near_radius(similarity))


def _bytes(column) -> np.ndarray:
    """Rows of bytes of a column of equally long binary values."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.empty((0, 8 * WORDS), np.uint8)


def spanned(dealt: DataFrame, radius: int) -> DataFrame:
    """(u, v) of a spanning forest of the links within each shard; dealt: shard and fp, a long or bytes."""
    wide = dict(dealt.dtypes)["fp"] == "binary"

    def words(column) -> np.ndarray:
        return _bytes(column).view(np.uint64) if wide else column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)

    def values_of(fps: np.ndarray):
        return pa.array([row.tobytes() for row in fps], pa.binary()) if wide else pa.array(fps[:, 0].view(np.int64))

    def run(batches):
        def solve(shards, fps):
            number = np.cumsum(np.concatenate(([0], shards[1:] != shards[:-1])))
            alone = np.bincount(number)[number] == 1
            fps = fps[~alone]
            if len(fps):
                number = np.unique(number[~alone], return_inverse=True)[1]
                a, b = spanning_links(number, fps, radius)
                yield pa.RecordBatch.from_arrays([values_of(fps[a]), values_of(fps[b])], names=["u", "v"])

        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(0).to_numpy(zero_copy_only=False), words(batch.column(1))])
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                shards, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.searchsorted(shards, shards[-1])  # the last shard may go on
                if cut:
                    yield from solve(shards[:cut], fps[:cut])
                held, rows = [[shards[cut:], fps[cut:]]], 0
        if held:
            shards, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(shards):
                yield from solve(shards, fps)

    kind = "binary" if wide else "long"
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, f"u {kind}, v {kind}")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes of the edges (u, v).

    Each step is a table in the shared folder; edges only ever move towards
    smaller nodes, and the loop ends when a round changes nothing.  The least neighbours are tables as well, so
    that both sides of a join are plain shuffles, whose hot partitions the skew join can split.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = scratch.table(edges.select("u", "v").where("u <> v").distinct(), "edges0")
    state = None
    for i in range(1, rounds + 1):
        sides = both(now)
        least = scratch.table(sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), f"least{i}")
        large = sides.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"large{i}")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), f"smaller{i}")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = scratch.table(small, f"edges{i}")
        for name in (f"edges{i - 1}", f"least{i}", f"large{i}", f"smaller{i}"):
            scratch.drop(name)
        was, state = state, now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, radius: int = RADIUS, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep``, fp, component_id and root (the component's least fingerprint) of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, keep), "fingerprints")
    return _named(rows, lambda nodes: links(nodes, radius), scratch)


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """As ``groups``, for texts whose word shingles have at least this Jaccard similarity; fp and root are 32 bytes."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.table(fingerprints(docs, keep, shingle, WORDS), "fingerprints")
    return _named(rows, lambda nodes: near_links(nodes, nodes.count(), similarity), scratch)


def _named(rows: DataFrame, link, scratch: Scratch) -> DataFrame:
    nodes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(link(nodes), scratch)
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "first", "root")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = linked.join(ids, "root").select(F.col("fp").alias("k"), "component_id", "root")
    named = nodes.join(ids, nodes.fp == ids.k, "left").select(F.col("fp").alias("k"), F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    named = scratch.table(named, "named")  # both sides are then read by a plain shuffle, whose hot partitions the skew join can split
    scratch.keep("fingerprints", "named")
    return rows.join(named, rows.fp == named.k).drop("k")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, stored: bool = False) -> DataFrame:
    """The documents (all their columns), one of each near group: that of the least doc_id, the first among equal rows.

    Rows are numbered once, unless ``stored`` says that they are read straight from files.
    """
    rid = fresh(docs, "__rid")
    base = numbered(docs, rid, None if stored else Scratch(docs.sparkSession, "near"))
    rows = base.select("doc_id", F.col(rid).alias("rid"), "text")
    kept = near_groups(rows, similarity, shingle, ["doc_id", "rid"]).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("x"))
    return base.join(kept.select(F.col("x.rid").alias(rid)), rid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
