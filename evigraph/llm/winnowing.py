"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; in every window of w hashes the
least is chosen, the rightmost among equals; a hash chosen by several windows is
kept once, with its position.  Any passage of ``w + k - 1`` code points that two
texts share is covered by a common hash.

Edge cases: null text counts as empty; an empty text has no hashes, and two
empty fingerprints are alike by 1.0; a text shorter than k is one gram, with
fewer than w grams one window.  Very long texts go through in pieces of
2^20 grams that overlap by a window.  Repeated rows and repeated ids keep their rows; they are ordered by a hash of
the text and by row number, so that a repeated or null id fills as many blocks as it needs.  Other columns
are ignored; an empty table gives an empty result.  A null doc_id sorts first.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, documents, numbered, values, whole_text

K, W = 12, 32  # W is a power of two
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_POWERS = {"n": 0}


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""
    if _POWERS["n"] < n:
        n = max(n, 1 << 14)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of code points, by prefix sums modulo 2^64."""
    n = len(codes)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions) chosen in the text, by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    k = min(k, len(codes))
    grams, low = len(codes) - k + 1, np.uint64(PIECE * 2 - 1)
    kept = []
    for at in range(0, max(1, grams - w + 1), PIECE):
        part = gram_hashes(codes[at : min(at + PIECE + w - 1, grams) + k - 1], k)
        # The low bits hold the position, turned round, so that the least key is the rightmost of equal hashes.
        key = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        if len(key) < w:
            key = key.min(keepdims=True)
        else:
            span = 1
            while span < w:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
        key = key[np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))]
        kept.append(((key >> np.uint64(32)).astype(np.uint32), (low - (key & low)).astype(np.int64) + at))
    hashes, places = (np.concatenate(x) for x in zip(*kept, strict=True))
    if len(kept) > 1:
        fresh = np.concatenate(([True], places[1:] != places[:-1]))
        hashes, places = hashes[fresh], places[fresh]
    return hashes, places


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    return 2.0 * float(np.count_nonzero(both[1:] == both[:-1])) / (len(a) + len(b))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes array<long>, positions array<long>) of every text."""

    def run(batches):
        for batch in batches:
            found = [winnow(t, k, w) for t in values(batch.column(1))]
            arrays = [pa.array([x[i].astype(np.int64) for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "hashes", "positions"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


_FIRST = -(1 << 63)
ROWS, MOST_BLOCKS = 5000, 1 << 16


def with_next(docs: DataFrame, rows_per_block: int = ROWS, stored: bool = False) -> DataFrame:
    """Rows (block, borrowed, k, h, rid, doc_id, text), each block a run in the order (k, h, rid) and the first row of the next block, borrowed.

    The cut points are the least rows of range partitions: three numbers a block, and at most ``MOST_BLOCKS``
    blocks, however many rows there are (a block is streamed, never held).  Each text is shuffled once, and each
    block goes to a partition of its own.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    rows = docs.select(key.alias("k"), F.xxhash64(whole_text()).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = numbered(rows, "rid", None if stored else Scratch(spark, "winnowing")).select("k", "h", "rid", "doc_id", "text")
    ids = rows.select("k", "h", "rid")
    blocks = min(MOST_BLOCKS, max(1, ids.count() // rows_per_block))
    least = F.min(F.struct("k", "h", "rid")).alias("x")
    cuts = sorted(tuple(r.x) for r in ids.repartitionByRange(blocks, "k", "h", "rid").groupBy(F.spark_partition_id()).agg(least).collect())
    shared = spark.sparkContext.broadcast((cuts, np.array([c[0] for c in cuts], np.int64)))

    def deal(batches):
        cut, firsts = shared.value
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(firsts, k, "left"), np.searchsorted(firsts, k, "right")
            block, lent = high - 1, np.zeros(len(k), bool)
            for i in np.flatnonzero(low < high):  # rows with the id of a cut point
                row = (int(k[i]), batch.column(1)[int(i)].as_py(), batch.column(2)[int(i)].as_py())
                block[i] = bisect.bisect_right(cut, row, int(low[i]), int(high[i])) - 1
                lent[i] = block[i] >= 0 and cut[block[i]] == row
            lent = np.flatnonzero(lent)
            for rows, to, borrowed in ((batch, block, False), (batch.take(pa.array(lent)), (block[lent] - 1) % len(cut), True)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(len(to), borrowed)), *rows.columns], names=["block", "borrowed", "k", "h", "rid", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "block long, borrowed boolean, k long, h long, rid long, doc_id long, text string")
    return dealt.repartitionById(len(cuts) or 1, F.col("block").cast("int")).sortWithinPartitions("block", "borrowed", "k", "h", "rid")


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by the first as many code points of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def op6_document_fingerprints(spark, sf_dir) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir), stored=True)


def compare_with_next(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Fingerprint of each text (with the positions of its hashes) and of the text edited by the next document's, and their likeness."""

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
        waiting = None  # block, doc_id, text, hashes, positions, set of hashes
        for batch in batches:
            out, chars = [], 0
            for block, borrowed, doc_id, text in zip(*(values(batch.column(i)) for i in (0, 1, 5, 6)), strict=True):
                if borrowed and waiting is None:
                    continue
                hashes, places = winnow(text)
                here = (block, doc_id, text, hashes, places, np.unique(hashes))
                if waiting is not None:
                    if waiting[0] != block:
                        raise ValueError(f"block {waiting[0]} lacks the row after its last")
                    _, was_id, was, was_hashes, was_places, was_set = waiting
                    changed = edited(was, text)
                    new = winnow(changed)[0]
                    out.append((was_id, len(was), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), was_hashes.astype(">u4").tobytes().hex(), new.astype(">u4").tobytes().hex(), likeness(was_set, np.unique(new)), likeness(was_set, here[5]), was_places))
                    chars += len(was)
                waiting = None if borrowed else here
                if chars >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, chars = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return with_next(docs, stored=stored).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>")
