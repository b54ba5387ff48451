"""Packing by lexical retrieval.

Each document becomes its token ids and an end id.  Whole windows of 1024 are cut
off as sequences of their own; the rest of a document is a piece that shares a
window with others.  Pieces of the whole table are routed to shards of bounded size
by the rare terms they share, and indexed there by BM25 over their token ids; each
seed piece retrieves its best unused neighbours, which fill the window greedily.
The last neighbour is cut at the window's end, and what is left of it is the next
seed, so windows have no padding but for the last of a few shards.

Document frequencies, number and mean length of the pieces are those of the whole
table.  For routing, the BM25 weights of a piece are sketched by signed random
projection; a tree that halves a sample at the median along its main direction
gives each piece a leaf, and a shard is a run of pieces in the order of the leaves
(within a leaf, in bins along its main direction).  Shards are cut from the counted
pieces of all bins; a bin of more pieces than a shard takes, such as copies, is dealt out by hash.  Sketches
are sums of whole numbers, and nothing depends on files, splits, partitions or
samples that Spark draws, so reruns pack the same pieces together.  A seed
searches its own shard, so neighbours that the tree parts are missed.

Token ids of texts in the common Latin range are made by splitting all texts of a
batch with array operations, encoding each distinct split once, and gathering; all other
texts go through the tokenizer itself.  Both ways give the same ids.

Edge cases: null and empty texts are the end id alone; very long texts are cut
into many windows; repeated rows are packed each on its own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, documents, whole_text
from evigraph.llm.winnowing import _powers

WINDOW = 1024
END = 0
WHOLE = 1 << 62  # in the sequence ids of whole windows
SHARD = 2048
SKETCH = 256  # dimensions
SAMPLE = 1 << 16  # pieces at most that the routing tree is fitted on
BINS = 64  # of a leaf
GROUP = 4  # shards that one packer goes through
LEAST = 16  # sampled pieces in a node that is split
STEPS = 64  # of a weight of 1 in a sketch
COMMON = 1024  # terms whose weights are sketched by a matrix product
WIDE = 24  # a term that one piece of so many holds has a row of its own in a shard
BATCH_CHARS = 1 << 20
K1, B = 1.2, 0.75
LIMIT = 0x250  # code points below this take the fast way
SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Batches of texts to ids of a byte-level BPE vocabulary (a tokenizers file)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        kinds = np.full(LIMIT, OTHER, np.uint8)
        for i in range(LIMIT):
            kind = unicodedata.category(chr(i))[0]
            kinds[i] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
        kinds[0] = BREAK
        self.kinds = kinds
        self.terms = max([END, *self.whole.get_vocab(True).values()]) + 1
        self._forget()

    def _forget(self):
        self.known, self.at, self.n, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        fast, codes, out = [], [], [None] * len(texts)
        zero = np.zeros(1, np.uint32)
        for i, text in enumerate(texts):
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(c) and (c.max() >= LIMIT or c.min() == 0 or any(s in text for s in self.special)):
                out[i] = self.encode(text)
            else:
                fast.append(i)
                codes += (c, zero)
        if fast:
            ids, ends = self._split_and_gather(np.concatenate([zero, *codes]))
            for i, a, b in zip(fast, [0, *ends[:-1]], ends, strict=True):
                out[i] = ids[a:b]
        return out

    def _starts(self, code: np.ndarray) -> np.ndarray:
        """Where the vocabulary's split pattern starts a piece; texts lie between zeros."""
        kind = self.kinds[code]
        start = np.ones(len(code), bool)
        start[1:] = kind[1:] != kind[:-1]
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))  # last space before something
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        start |= kind == BREAK
        quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
        if len(quote):
            one, two = code[quote + 1], code[np.minimum(quote + 2, len(code) - 1)]
            pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            n = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, np.where(pair, 2, 0))
            quote, n = quote[n > 0], n[n > 0]
            start[quote + 1] = False
            start[quote + 1 + n] = True
        return start

    def _split_and_gather(self, code: np.ndarray) -> tuple[np.ndarray, list[int]]:
        at = np.flatnonzero(self._starts(code))
        end = np.append(at[1:], len(code))
        up, down = _powers(len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
        hashed = (sums[end] - sums[at]) * down[at]
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93)
        hashed ^= (hashed >> np.uint64(32)) + (end - at).astype(np.uint64)
        is_break = code[at] == 0
        inverse, distinct = pd.factorize(hashed)
        # One occurrence of each distinct piece.
        where = np.empty(len(distinct), np.int64)
        where[inverse] = np.arange(len(inverse))
        slot = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[slot] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) > 1_000_000:  # a cache only
                self._forget()
                new = np.ones(len(distinct), bool)
            spots = where[new]
            pieces = ["" if code[at[i]] == 0 else code[at[i] : end[i]].tobytes().decode("utf-32-le") for i in spots]
            found = [self._piece(p) for p in pieces]
            n = np.fromiter(map(len, found), np.int64, len(found))
            base = len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate((self.flat, np.fromiter((x for f in found for x in f), np.int32, int(n.sum()))))
            known, starts, counts = np.concatenate((self.known, distinct[new])), np.concatenate((self.at, base)), np.concatenate((self.n, n))
            order = np.argsort(known, kind="stable")
            self.known, self.at, self.n = known[order], starts[order], counts[order]
            slot = np.searchsorted(self.known, distinct)
        n = self.n[slot][inverse]
        total = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[slot][inverse] - (total - n), n) + np.arange(total[-1])]
        return ids, total[np.flatnonzero(is_break)][1:].tolist()

    def _piece(self, piece: str) -> list[int]:
        return self._bpe(piece)

    @functools.cached_property
    def _bpe(self):
        import base64

        import tiktoken

        def by_whole(piece: str):
            return self.whole.encode(piece, add_special_tokens=False).ids if piece else []

        try:
            with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if self.whole.get_vocab_size() != len(ranks) + 1:
                return by_whole
            core = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        except (ImportError, OSError):
            return by_whole
        return lambda piece: core.encode_single_piece(piece.encode()) if piece else []


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_size(spark, path: str) -> int:
    """Ids of a tokenizer, counted in a task, so that the driver need not hold it."""

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoder(path).terms], pa.int64())], names=["n"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "n long").first()["n"]


class Stats:
    """Number and mean length of all pieces, and the idf of every term; as large as the vocabulary."""

    def __init__(self, pieces: int, mean: float, df: np.ndarray):
        self.pieces, self.mean = pieces, mean
        self.idf = np.maximum(np.log((pieces - df + 0.5) / (df + 0.5)), 0.0)  # terms of half the pieces or more tell nothing

    def frequency(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / self.mean))

    def sketches(self, pieces: list[np.ndarray], at_once: int = 128) -> np.ndarray:
        """Unit vectors (or zero) whose products are near those of the pieces' BM25 weights.

        Weights of the commonest terms go through one matrix product, the others are gathered.
        """
        signs, out = _signs(len(self.idf)), np.zeros((len(pieces), SKETCH), np.float32)
        common = np.argsort(self.idf, kind="stable")[np.count_nonzero(self.idf == 0) :][:COMMON]
        row = np.full(len(self.idf), -1)
        row[common] = np.arange(len(common))
        shared = signs[common]
        for a in range(0, len(pieces), at_once):
            some = pieces[a : a + at_once]
            n = np.fromiter(map(len, some), np.int64, len(some))
            pair = (np.repeat(np.arange(len(some)), n) << 32) | np.concatenate(some).astype(np.int64)
            pair.sort()
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            tf, pair = np.diff(np.append(first, len(pair))), pair[first]
            doc, term = pair >> 32, pair & 0xFFFFFFFF
            weight = np.rint(self.idf[term] * self.frequency(tf, n[doc]) * STEPS).astype(np.float32)  # sums are exact in any order
            dense, at = np.zeros((len(some), len(common)), np.float32), row[term]
            dense[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
            found = dense @ shared
            rest = np.flatnonzero((at < 0) & (weight > 0))
            if len(rest):
                starts = np.flatnonzero(np.concatenate(([True], doc[rest][1:] != doc[rest][:-1])))
                found[doc[rest][starts]] += np.add.reduceat(signs[term[rest]] * weight[rest, None], starts)
            out[a : a + at_once] = found
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@functools.cache
def _signs(terms: int) -> np.ndarray:
    return np.random.default_rng(0).choice(np.array([-1, 1], np.float32), (terms, SKETCH))


def _spread(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Covariances of the columns of some rows, times their number; a few rows at a time are widened."""
    sums, products = np.zeros(SKETCH), np.zeros((SKETCH, SKETCH))
    for a in range(0, len(rows), 4096):
        part = x[rows[a : a + 4096]].astype(np.float32)
        sums += part.sum(axis=0)
        products += part.T @ part
    return products - np.outer(sums, sums) / max(1, len(rows))


class Tree:
    """Halves a sample of sketches until a leaf stands for at most ``size`` of ``pieces``.

    One task fits it, and the halves are row numbers, not copies of the sample.
    """

    @classmethod
    def of(cls, axes: np.ndarray, cuts: np.ndarray, kids: np.ndarray) -> Tree:
        """A tree that was fitted elsewhere."""
        tree = cls.__new__(cls)
        tree.axes, tree.cuts, tree.kids, tree.leaves = axes, cuts, kids, int(np.count_nonzero(kids[:, 0] < 0))
        return tree

    def __init__(self, sample: np.ndarray, pieces: int, size: int):
        self.axes, self.cuts, self.kids = [], [], []
        self.leaves = 0

        def grow(rows: np.ndarray, share: float) -> int:
            me = len(self.axes)
            axis = np.linalg.eigh(_spread(sample, rows))[1][:, -1].copy()  # a view would hold all directions of the node
            axis *= np.sign(axis[np.argmax(np.abs(axis))]) or 1.0
            at = np.concatenate([sample[rows[a : a + 1024]].astype(np.float64) @ axis for a in range(0, len(rows) or 1, 1024)])
            cut = float(np.median(at)) if len(rows) else 0.0
            self.axes.append(axis)
            self.cuts.append(cut)
            self.kids.append((-1, self.leaves))
            low = at < cut
            if share * pieces > size and len(rows) >= LEAST and 0 < low.sum() < len(rows):
                self.kids[me] = (grow(rows[low], share / 2), grow(rows[~low], share / 2))
            else:
                self.leaves += 1
            return me

        grow(np.arange(len(sample)), 1.0)
        del grow  # refers to itself, so it would hold the sample until garbage is collected
        self.axes, self.cuts, self.kids = np.array(self.axes), np.array(self.cuts), np.array(self.kids)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each sketch, in the order of the leaves, and where it lies along the leaf's main direction."""
        node = np.zeros(len(x), np.int64)
        while True:
            at = (x * self.axes[node]).sum(axis=1)
            inner = self.kids[node, 0] >= 0
            if not inner.any():
                return self.kids[node, 1], at.round(6)
            node = np.where(inner, np.where(at < self.cuts[node], self.kids[node, 0], self.kids[node, 1]), node)


class Shard:
    """BM25 over token ids of some pieces: a term's postings are a slice of two arrays, or a row over all pieces where many hold the term."""

    def __init__(self, pieces: list[np.ndarray], stats: Stats):
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        pair = (np.concatenate(pieces).astype(np.int64) << 32) | np.repeat(np.arange(len(pieces)), n)
        pair.sort()
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        tf = np.diff(np.append(first, len(pair)))
        pair = pair[first]
        term, self.docs = pair >> 32, pair & 0xFFFFFFFF
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        df = np.diff(np.append(start, len(term)))
        idf = stats.idf[term[start]]
        self.weights = np.repeat(idf, df) * stats.frequency(tf, n[self.docs])
        useful = np.repeat(idf > 0, df)
        number = np.repeat(np.arange(len(start)), df)
        by_doc = np.argsort(self.docs[useful], kind="stable")
        self.terms = number[useful][by_doc]
        self.bounds = np.searchsorted(self.docs[useful][by_doc], np.arange(len(pieces) + 1))
        self.start, self.end, self.size = start, start + df, len(pieces)
        wide = np.flatnonzero((idf > 0) & (df * WIDE >= len(pieces)))
        self.row = np.full(len(start), -1)
        self.row[wide] = np.arange(len(wide))
        self.dense = np.zeros((len(wide), len(pieces)), np.float32)
        for k, t in enumerate(wide):
            at = slice(self.start[t], self.end[t])
            self.dense[k, self.docs[at]] = self.weights[at]

    def scores(self, doc: int) -> np.ndarray:
        terms = self.terms[self.bounds[doc] : self.bounds[doc + 1]]
        row = self.row[terms]
        found = self.dense[row[row >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        terms = terms[row < 0]
        if len(terms):
            a, n = self.start[terms], self.end[terms] - self.start[terms]
            total = np.cumsum(n)
            rows = np.repeat(a - (total - n), n) + np.arange(total[-1])
            found += np.bincount(self.docs[rows], self.weights[rows], self.size)
        return found


class Packer:
    """Deals pieces (row, start, ids) out to sequences; emits (row, start, length, sequence, offset)."""

    def __init__(self, window: int, stats: Stats | None = None):
        self.stats, self.window, self.sequence, self.used, self.out, self.count = stats, window, 0, 0, [], 0

    def fresh(self) -> int:
        self.count += 1
        return self.count - 1

    def put(self, row, start: int, n: int) -> int:
        """Places as much as the open window takes; returns how much."""
        if not self.used:
            self.sequence = self.fresh()
        n = min(n, self.window - self.used)
        self.out.append((row, start, n, self.sequence, self.used))
        self.used += n
        if self.used == self.window:
            self.used = 0
        return n

    def pack(self, pieces: list) -> None:
        """All pieces of a shard: [(row, start, ids)]."""
        shard = Shard([ids for _, _, ids in pieces], self.stats)
        free = np.ones(len(pieces), bool)
        first, scores = 0, None  # scores: of all pieces for the seed of the open window
        for _ in range(len(pieces)):
            if scores is None:
                while not free[first]:
                    first += 1
                pick = first
            else:
                pick = int(np.argmax(np.where(free, scores, -1.0)))
            free[pick] = False
            row, start, ids = pieces[pick]
            done = self.put(row, start, len(ids))
            if done < len(ids):  # what is left is the seed of the next window
                self.put(row, start + done, len(ids) - done)
            if not self.used:
                scores = None
            elif scores is None or done < len(ids):
                scores = shard.scores(pick)


def cut(docs: DataFrame, path: str, window: int) -> DataFrame:
    """doc_id, start, doc_tokens, ids, sequence_id: whole windows with their sequence, and the rest of each document without one.

    ids are the bytes of an array of ``id_type``, which is far cheaper to write and read than an array column.
    """

    def run(batches):
        encode = encoder(path)
        kind = id_type(encode.terms)
        base, count, rows, size = WHOLE | TaskContext.get().partitionId() << 36, 0, [], 0

        def emit():
            ids = pa.array([r[3].astype(kind).tobytes() for r in rows], pa.binary())
            column = lambda k: pa.array([r[k] for r in rows], pa.int64())
            return pa.RecordBatch.from_arrays([column(0), column(1), column(2), ids, column(4)], names=["doc_id", "start", "doc_tokens", "ids", "sequence_id"])

        for doc_id, ids in _encoded(batches, encode):
            for start in range(0, len(ids), window):
                part = ids[start : start + window]
                rows.append((doc_id, start, len(ids), part, base + count if len(part) == window else None))
                count += len(part) == window
                size += len(part)
                if size >= BATCH_CHARS:
                    yield emit()
                    rows, size = [], 0
        if rows:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, start long, doc_tokens long, ids binary, sequence_id long")


def id_type(terms: int) -> str:
    return "<u2" if terms <= 1 << 16 else "<u4"


def _lists(column, terms: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), id_type(terms)) for x in column]


def statistics(pieces: DataFrame, terms: int) -> Stats:
    """Counted over all pieces; what is collected is as large as the vocabulary."""

    def run(batches):
        df, n, size = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for ids in _lists(batch.column(0), terms):
                df[np.unique(ids)] += 1
                n, size = n + 1, size + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-2, -1])), pa.array(np.append(df[some], [n, size]))], names=["term", "n"])

    found = pieces.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(terms + 2, np.int64)  # the last two are the number of pieces and of ids
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    n, size = df[terms:].tolist()
    return Stats(n, size / max(n, 1), df[:terms])


def routing(pieces: DataFrame, stats: Stats, shard: int) -> Tree:
    """Fitted in one task on at most about ``SAMPLE`` sketches; the driver gets the tree only."""

    def run(batches):
        for batch in batches:
            x = stats.sketches(_lists(batch.column(0), len(stats.idf)))
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary())], names=["x"])

    some = pieces.where(F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(-(-stats.pieces // SAMPLE))) == 0) if stats.pieces > SAMPLE else pieces
    total = stats.pieces

    def grow(batches):
        tree = Tree(ordered(pa.chunked_array([batch.column(0) for batch in batches], pa.binary())), total, shard)
        for a in range(0, len(tree.axes), 1024):
            axes, cuts, kids = tree.axes[a : a + 1024], tree.cuts[a : a + 1024], tree.kids[a : a + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(axes)), pa.int64()), pa.array(list(axes), pa.list_(pa.float64())), pa.array(cuts), pa.array(kids[:, 0]), pa.array(kids[:, 1])], names=["k", "axis", "cut", "low", "high"])

    found = some.select("ids").mapInArrow(run, "x binary").repartition(1).mapInArrow(grow, "k long, axis array<double>, cut double, low long, high long").toArrow().sort_by("k")
    if not len(found):  # no row was chosen
        return Tree(np.empty((0, SKETCH), np.float16), total, shard)
    return Tree.of(np.array([v.values.to_numpy() for v in found["axis"]]), found["cut"].to_numpy(), np.stack([found["low"].to_numpy(), found["high"].to_numpy()], axis=1))


def ordered(sketches: pa.ChunkedArray) -> np.ndarray:
    """The sketches, by their hash, whatever order they came in; each is copied once."""
    order = np.argsort(np.fromiter((xxhash.xxh64_intdigest(s.as_buffer()) for s in sketches), np.uint64, len(sketches)), kind="stable")
    place, x = np.empty(len(order), np.int64), np.empty((len(order), SKETCH), np.float16)
    place[order] = np.arange(len(order))
    for at, sketch in zip(place, sketches, strict=True):
        x[at] = np.frombuffer(sketch.as_buffer(), np.float16)
    return x


def routed(pieces: DataFrame, stats: Stats, tree: Tree, shard: int, scratch: Scratch) -> DataFrame:
    """The pieces with their shard; a partition has whole groups of shards, in order.

    They are written first, since their routes are counted before they are dealt out.
    """

    def run(batches):
        for batch in batches:
            leaf, at = tree.route(stats.sketches(_lists(batch.column(3), len(stats.idf))))
            part = np.clip((at + 1) * (BINS / 2), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(at), pa.array(part)], names=[*batch.schema.names, "leaf", "at", "bin"])

    found = pieces.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, "doc_id long, start long, doc_tokens long, ids binary, leaf long, at double, bin long")
    table = scratch.table(found.withColumn("tie", F.xxhash64("ids")), "routed")
    counts = table.groupBy("leaf", "bin").agg(F.count("*").alias("n")).orderBy("leaf", "bin").toArrow()  # at most BINS rows a leaf, of which there are at most SAMPLE / LEAST * 2
    cuts = counts.drop_columns("n").append_column("first", pa.array(cut_shards(counts["n"].to_pylist(), shard))).append_column("parts", pa.array([-(-n // shard) for n in counts["n"].to_pylist()], pa.int64()))
    number = F.col("first") + F.pmod(F.xxhash64("doc_id", "start", "tie"), F.col("parts"))
    dealt = table.join(F.broadcast(pieces.sparkSession.createDataFrame(cuts)), ["leaf", "bin"]).withColumn("shard", number).withColumn("group", F.expr(f"shard div {GROUP}"))
    return dealt.repartition("group").sortWithinPartitions("shard", "leaf", "at", "doc_id", "start", "tie")


def cut_shards(counts: list[int], size: int) -> list[int]:
    """The (first) shard of each bin: bins that follow each other share one while they fit; a bigger bin has as many of its own as it needs."""
    first, shard, used = [], 0, 0
    for n in counts:
        if used and used + n > size:
            shard, used = shard + 1, 0
        first.append(shard)
        used += n
        if n > size:
            shard, used = shard + -(-n // size), 0
    return first


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    path = path or vocabulary()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    scratch = Scratch(docs.sparkSession, "packing")
    table = scratch.table(cut(docs, path, window), "pieces")
    pieces = table.where("sequence_id IS NULL")
    stats = statistics(pieces, vocabulary_size(docs.sparkSession, path))

    def rows_of(out):
        """out: (doc_id, start, ids, doc_tokens, sequence_id, offset)."""
        rows = [(doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq, at) for doc_id, start, ids, total, seq, at in out]
        arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        if with_ids:
            ends = np.concatenate(([0], np.cumsum([r[2] for r in rows])))
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[2] for r in out]), pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def windows(batches):
        for batch in batches:
            if batch.num_rows:
                doc_id, start, total, seq = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
                yield rows_of(list(zip(doc_id, start, _lists(batch.column(3), len(stats.idf)), total, seq, [0] * len(seq), strict=True)))

    def deal(batches):
        packer, pool, now = None, [], -1

        def emit():
            packer.pack(pool)
            out, packer.out = packer.out, []
            base = now // GROUP << 32
            pool.clear()
            return rows_of([(doc_id, start, ids[start - first : start - first + n], total, base + seq, at) for (doc_id, first, ids, total), start, n, seq, at in out])

        for batch in batches:
            for number, doc_id, start, total, ids in zip(*(batch.column(k).to_pylist() for k in (4, 0, 1, 2)), _lists(batch.column(3), len(stats.idf)), strict=True):
                if pool and (number != now or len(pool) >= 2 * shard):  # only repeated rows make a shard so big
                    yield emit()
                if packer is None or number // GROUP != now // GROUP:
                    packer = Packer(window, stats)
                now = number
                pool.append(((doc_id, start, ids, total), start, ids))
        if pool:
            yield emit()

    whole = table.where("sequence_id IS NOT NULL").mapInArrow(windows, schema)
    if not stats.pieces:
        return whole
    return whole.unionByName(routed(pieces, stats, routing(pieces, stats, shard), shard, scratch).select("doc_id", "start", "doc_tokens", "ids", "shard").mapInArrow(deal, schema))


def _encoded(batches, encode: Encoder):
    """(doc_id, ids with the end id) row by row; texts are encoded about BATCH_CHARS at a time."""
    ids, texts, chars = [], [], 0

    def flush():
        for doc_id, found in zip(ids, encode.encode_batch(texts), strict=True):
            yield doc_id, np.append(found, np.int32(END))

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), strict=True):  # one string at a time
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield from flush()
                ids, texts, chars = [], [], 0
    if ids:
        yield from flush()


def op5_packing(spark, sf_dir) -> DataFrame:
    return pack(documents(spark, sf_dir))
