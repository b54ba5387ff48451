"""Exact substring dedup with sparse, sharded suffix arrays.

Every byte that is covered by a ``LENGTH``-byte string which also starts elsewhere
is removed; strings are judged on the input.

Sorting every suffix would move each text hundreds of times, so suffixes are
sampled by content: of the ``GRAM``-byte strings in each LENGTH-byte window, the one with the least hash
is the window's anchor.  Equal windows have equal anchors at the same offset, so the
windows of an anchor need comparing only with those of anchors that start with the same gram.

1. Anchors are emitted as (hash of the gram, hash of the whole context, row, place), where
   the context reaches ``LENGTH - GRAM`` bytes to either side of the gram.  Grams
   that occur once are done; contexts that occur twice or more are repeated as a whole.
2. One copy of each distinct context whose gram has several goes on.  They are range-partitioned
   by their leading bytes (Spark samples the splitters).  In a bucket, what follows the gram and, reversed,
   what precedes it are sorted by a multikey sort on 8-byte tokens, and neighbours are compared for their common
   prefix.  Equal grams never straddle buckets: the gram is part of the range key, so suffixes on
   either side of a boundary differ within their first GRAM bytes.  A window that starts i bytes before the
   anchor is repeated if another context agrees in i bytes before and LENGTH - GRAM - i bytes after.
   Grams with more than ``HOT`` contexts take an exact way without a bucket:
   their windows are counted by hash in a distributed aggregation.
3. The repeated stretches are joined back to all anchors and merged per document.

Edge cases: null text counts as empty; texts below LENGTH bytes lose nothing;
matches never cross documents; overlapping and equal strings in one document
count; repeated rows are repeats of each other; very long texts are scanned in pieces; other columns
are ignored; an empty table gives an empty result.  Grams and contexts are told apart by 64-bit
hashes each, windows by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, documents, numbered, values, whole_text
from evigraph.llm.winnowing import _powers

LENGTH, GRAM = 400, 150
HOT = 100_000
PIECE = 1 << 20
CHUNK = 1 << 14


def _hashes(b: np.ndarray):
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return sums, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
    """(gram hashes, context hashes, places) of the anchors of a text, uint64, uint64, int64, by place."""
    n, w, side, last, found = len(data), length - gram + 1, length - gram, -1, []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, n - length + 1, piece):  # windows that start in [at, at + piece)
        low, high = max(0, at - side), min(n, at + piece + length + side)
        sums, down = _hashes(whole[low:high])
        h = _mixed((sums[gram:] - sums[:-gram]) * down[: high - low - gram + 1])
        part = h[at - low : min(at + piece, n - length + 1) - low + w - 1]
        # The rightmost of the least in each window of w grams, by doubling spans.
        place = np.arange(len(part))
        value, span = part, 1
        while span < w:
            step = min(span, w - span)
            take = value[step:] <= value[:-step]
            value, place = np.where(take, value[step:], value[:-step]), np.where(take, place[step:], place[:-step])
            span += step
        place = place[np.concatenate(([True], place[1:] != place[:-1]))] + at
        place = place[place > last]
        if not len(place):
            continue
        last = place[-1]
        left, right = np.maximum(place - side, 0), np.minimum(place + length, n)
        shape = ((place - left) * 1000003 + (right - place)).astype(np.uint64)
        context = _mixed(((sums[right - low] - sums[left - low]) * down[left - low]) ^ (shape * np.uint64(0x9E3779B97F4A7C15)))
        found.append((h[place - low], context, place))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def multikey_order(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of the rows by group and then by their tokens (columns of words): each pass sorts by the next token only rows still tied."""
    order = np.argsort(group, kind="stable")
    run = np.cumsum(np.concatenate(([0], np.diff(group[order]) != 0)))
    for j in range(words.shape[1]):
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1)
        if not len(tied):
            break
        rows = order[tied]
        key = words[rows, j]
        by = np.lexsort((key, run[tied]))
        order[tied], key = rows[by], key[by]
        fresh = np.concatenate(([True], np.diff(run) != 0))
        fresh[tied[1:]] |= key[1:] != key[:-1]
        run = np.cumsum(fresh) - 1
    return order


def prefix_groups(group: np.ndarray, text: np.ndarray):
    """(order, depth): rows in suffix order, and how many bytes each shares with the row before (-1 in another group)."""
    pad = -text.shape[1] % 8
    words = np.ascontiguousarray(np.pad(text, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    order = multikey_order(group, words)
    a, b = text[order[1:]], text[order[:-1]]
    differ = a != b
    depth = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
    depth = np.where(group[order[1:]] == group[order[:-1]], depth, -1)
    return order, np.concatenate(([-1], depth))


def repeated_windows(group: np.ndarray, before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray):
    """(least, most) i of the repeated windows of each context that start i bytes before the anchor; most is -1 without any.

    before: bytes before the gram, reversed; after: bytes after it; n_before, n_after: how many there are.
    """
    rows, side = after.shape
    right, left = prefix_groups(group, after), prefix_groups(group, before)
    least, most = np.full(rows, side + 1, np.int64), np.full(rows, -1, np.int64)
    for i in range(side + 1):
        ids = np.empty((2, rows), np.int64)
        for k, ((order, depth), reach) in enumerate(((left, i), (right, side - i))):
            ids[k, order] = np.cumsum(depth < reach)
        fits = np.flatnonzero((n_before >= i) & (n_after >= side - i))
        if len(fits) < 2:
            continue
        key = ids[0, fits] * (rows + 1) + ids[1, fits]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = fits[by[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        least[twice] = np.minimum(least[twice], i)
        most[twice] = i
    return least, most


def _cut(data: bytes, place: int, length: int, gram: int):
    side = length - gram
    before, after = data[max(0, place - side) : place][::-1], data[place + gram : place + length]
    return before, after


def repeats(rows: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(rid, spans array<struct<s,e>>) of rows (rid, text) with repeated strings: byte stretches, not merged, ends exclusive and perhaps beyond the text.

    Tables are written before the joins by a gram or a context, so that both sides are plain shuffles, whose hot
    partitions the skew join can split.
    """
    side = length - gram

    def emit(batches):
        names = ["h", "c", "rid", "pos"]
        for batch in batches:
            out = [[], [], [], []]
            for rid, text in zip(*(values(c) for c in batch.columns), strict=True):
                h, c, place = anchors(text.encode("utf-8", "surrogatepass"), length, gram)
                for column, x in zip(out, (h.view(np.int64), c.view(np.int64), np.full(len(h), rid), place), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=names)

    every = scratch.table(rows.select("rid", "text").mapInArrow(emit, "h long, c long, rid long, pos long"), "anchors")
    found = scratch.table(every.join(scratch.table(_several(every), "several"), "h", "left_semi"), "repeated")
    scratch.drop("anchors")
    scratch.drop("several")
    contexts = scratch.table(found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos")).alias("at")), "contexts")
    grams = scratch.table(contexts.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "grams")
    several = contexts.join(grams.withColumnRenamed("h", "g"), F.col("h") == F.col("g")).select("h", "c", "n", "k", "at.rid", "at.pos")
    # All contexts of a text in one row, so that each text is joined once.
    wanted = several.groupBy("rid").agg(F.collect_list(F.struct("h", "c", "n", "k", "pos")).alias("x")).withColumnRenamed("rid", "r")
    texts = rows.join(wanted, rows.rid == F.col("r")).select("text", "x")

    def cut(batches):
        for batch in batches:
            out = []
            for text, wants in zip(*(values(c) for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in wants:
                    out.append((int.from_bytes(data[x["pos"] : x["pos"] + 8], "big") - (1 << 63), x["h"], x["c"], x["n"], x["k"], *_cut(data, x["pos"], length, gram)))
                    if len(out) >= 8192:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    def _batch(out):
        types = [pa.int64()] * 5 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["lead", "h", "c", "n", "k", "before", "after"])

    bytes_of = texts.mapInArrow(cut, "lead long, h long, c long, n long, k long, before binary, after binary")
    few = bytes_of.where(F.col("k") <= hot).repartitionByRange("lead", "h").sortWithinPartitions("lead", "h")

    def compare(batches):
        held: list = []

        def solve(part):
            _, h, c, n, _, before, after = zip(*part, strict=True)
            h, n = np.array(h, np.int64), np.array(n)
            group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
            text = [np.frombuffer(b"".join(x.ljust(side, b"\0") for x in s), np.uint8).reshape(-1, side) for s in (before, after)]
            least, most = repeated_windows(group, *text, *(np.array([len(x) for x in s]) for s in (before, after)))
            hit = (most >= 0) & (n == 1)
            return pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(np.array(c, np.int64)[hit]), pa.array(-most[hit]), pa.array(length - least[hit])], names=["h", "c", "low", "high"])

        for batch in batches:
            held += zip(*(x.to_pylist() for x in batch.columns), strict=True)
            if len(held) >= CHUNK and held[0][1] != held[-1][1]:
                end = len(held)
                while held[end - 1][1] == held[-1][1]:
                    end -= 1
                yield solve(held[:end])
                held = held[end:]
        if held:
            yield solve(held)

    def windows(batches):
        """Hot grams: a row for each window of each context."""
        for batch in batches:
            for h, c, n, before, after in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5, 6)), strict=True):
                b = np.frombuffer(before[::-1] + after, np.uint8)
                sums, down = _hashes(b)
                i = np.arange(max(0, side - len(after)), len(before) + 1)
                starts = len(before) - i
                inside = _mixed((sums[starts + side] - sums[starts]) * down[starts]).view(np.int64)
                full = np.full(len(i), 0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(full + h), pa.array(full + c), pa.array(full + n), pa.array(i), pa.array(inside)], names=["h", "c", "n", "i", "w"])

    crowded = bytes_of.where(F.col("k") > hot).mapInArrow(windows, "h long, c long, n long, i long, w long")
    counted = crowded.groupBy("h", "i", "w").agg(F.count("*").alias("m")).where("m > 1").select(F.col("h").alias("h2"), F.col("i").alias("i2"), F.col("w").alias("w2"))
    many = crowded.where("n = 1").join(counted, (F.col("h") == F.col("h2")) & (F.col("i") == F.col("i2")) & (F.col("w") == F.col("w2"))).groupBy("h", "c").agg((-F.max("i")).alias("low"), (F.lit(length) - F.min("i")).alias("high"))
    partly = few.mapInArrow(compare, "h long, c long, low long, high long")
    if grams.where(F.col("k") > hot).limit(1).count():
        partly = partly.unionByName(many)
    wholly = contexts.where("n > 1").select("h", "c", F.lit(-side).cast("long").alias("low"), F.lit(length).cast("long").alias("high"))
    result = scratch.table(wholly.unionByName(partly).select(F.col("h").alias("h2"), F.col("c").alias("c2"), "low", "high"), "stretches")
    scratch.drop("contexts")
    scratch.drop("grams")
    spans = found.join(result, (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2"))).select("rid", F.struct((F.col("pos") + F.col("low")).alias("s"), (F.col("pos") + F.col("high")).alias("e")).alias("x"))
    return spans.groupBy("rid").agg(F.collect_list("x").alias("spans"))  # stretches of one document


def _several(found: DataFrame) -> DataFrame:
    """Gram hashes that occur more than once."""
    return found.groupBy("h").agg(F.count("*").alias("t")).where("t > 1").select("h")


def merge(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal stretches, cut to [0, n)."""
    out: list[list[int]] = []
    for s, e in sorted((max(0, s), min(n, e)) for s, e in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e > s]


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False, stored: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row.

    Rows are numbered once, unless ``stored`` says that they are read straight from files.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = numbered(rows, "rid", None if stored else scratch)
    spans = repeats(rows, scratch, length, gram, hot).withColumnRenamed("rid", "r")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def apply(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(values(c) for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                cuts = merge([(x["s"], x["e"]) for x in found or ()], len(data))
                at, kept = 0, []
                for s, e in cuts:
                    kept.append(data[at:s])
                    at = e
                rest = b"".join([*kept, data[at:]])
                out.append((doc_id, len(data), len(data) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), *([rest] if with_text else ())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    joined = rows.join(spans, F.col("rid") == F.col("r"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    return removed(documents(spark, sf_dir), stored=True)


def by_hand(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by a table of all strings, for tests."""
    seen: dict[bytes, int] = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for s in range(len(d) - length + 1):
            seen[d[s : s + length]] = seen.get(d[s : s + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        rest = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)), hashlib.sha256(rest).hexdigest()))
    return out
