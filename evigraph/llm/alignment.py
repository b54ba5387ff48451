"""Alignment of two tokenizers by segments.

A text with a space in front is cut before runs of white space.  A cut is only made where neither vocabulary can merge
across it, which is read off the vocabularies: no token of either has another character followed by the first character of
the run, and the second has no token in which its own leading space is followed by it.  Then both tokenizers give
for a segment exactly what they give for it inside the text.  So each distinct segment of the corpus is encoded and
aligned once, and documents are composed from the alignments of their segments:

1. Documents are read in blocks of ``BLOCK_CHARS``; a block has its own dictionary of segments, and its documents are
   numbers of that dictionary.  Blocks are written once, so that their numbers can't change.
2. Dictionary entries (one row per block and segment, not per occurrence) are dealt out by segment; each distinct
   segment is encoded and aligned once and sent back to the blocks that have it.
3. In each block, documents are composed: token and group counts, groups in order, and how often each pair of ids is linked.
   Blocks also say in how many of their documents a pair is linked; these add up to the corpus-wide counts.
4. The counts go back to the blocks, where they are summed over the links of each document.

A block is bounded (one longer text is a block of its own), so no task holds more than a few of them, and a segment that a third of all
occurrences share is one row per block.

Edge cases: null and empty texts, and texts whose tokens don't spell them (for example with U+2581 in them), have
no tokens, so zeros and an empty string.  Strings of special tokens are plain text.  A repeated row is a document of
its own.  Other columns are ignored unless asked for.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, documents

BLOCK_CHARS = 16_000_000  # characters of a block's documents
FLUSH = 200_000  # alignments of a task that are sent to the blocks together
BATCH = 2_000  # segments that are encoded together
MARK = "\x1f"  # stands before a segment while a text is cut
#: All characters that either side or Python takes for white space.
WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
META = "\u2581"  # the second vocabulary's sign for a space


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies to bytes: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def safe_cuts(first: list[bytes], second: list[str]) -> str:
    """The white-space characters before which a text may be cut, judged by all tokens of both vocabularies."""
    texts = [t.decode("utf-8", "replace") for t in first]
    pieces = [p.replace(META, " ") for p in second]

    def crosses(c: str) -> bool:
        across = re.compile(f"[^{WHITE}]{re.escape(c)}")
        return any(across.search(t) for t in (*texts, *pieces)) or c != " " and any(p.startswith(" " + c) for p in pieces)

    return "".join(c for c in " \n\t\v\f\r" if not crosses(c))


class Pair:
    """A byte-level BPE file (first) and a sentencepiece model (second)."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        to_byte = byte_alphabet()
        with open(first, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
        normal = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.safe, self.lead = safe_cuts(self.a_bytes, normal), self.b.piece_to_id(META)
        self._runs = re.compile(f"[{WHITE}]{{2}}|{MARK}")
        self._cut = re.compile(f"(?<=[^{WHITE}])(?=[{re.escape(self.safe)}][{WHITE}]*[^{WHITE}])") if self.safe else None

    def split(self, text: str) -> list[str]:
        """The segments of a space and the text; a run of white space at the end stays with the last of them."""
        text = " " + text
        if not self.safe:
            return [text]
        if self._runs.search(text) or text[-1] in self.safe:
            return self._cut.split(text)
        for c in self.safe:
            text = text.replace(c, MARK + c)
        return text.split(MARK)[text[0] == MARK :]

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each segment of ``split``."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        # the second puts a space in front; where the segment has another character there, that space is a token of its own
        return [(x, y if s[0] == " " else y[1:] if y[:1] == [self.lead] else []) for s, x, y in zip(segments, a, b, strict=True)]

    def groups(self, segment: str, a: list[int], b: list[int]) -> str:
        """``a1,a2|b1;a3|b2,b3``, or nothing if the tokens don't spell the segment."""
        raw = segment.encode()
        left, right = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(left) != raw or b"".join(right) != raw:
            return ""
        out, i, j, at_a, at_b, low_i, low_j = [], 0, 0, 0, 0, 0, 0
        while i < len(a):
            at_a, i = at_a + len(left[i]), i + 1
            while at_b < at_a:
                at_b, j = at_b + len(right[j]), j + 1
            if at_a == at_b:
                out.append(",".join(map(str, a[low_i:i])) + "|" + ",".join(map(str, b[low_j:j])))
                low_i, low_j = i, j
        return ";".join(out)

    def align(self, segments: list[str]) -> list[str]:
        out = []
        for low in range(0, len(segments), BATCH):
            some = segments[low : low + BATCH]
            out += [self.groups(s, a, b) for s, (a, b) in zip(some, self.encode(some), strict=True)]
        return out


@functools.lru_cache(maxsize=2)
def pair_of(first: str, second: str) -> Pair:
    """Read once in a worker."""
    return Pair(first, second)


class Numbers(dict):
    """Numbers keys by their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def pack(array: np.ndarray) -> bytes:
    return zstandard.compress(array.tobytes(), 3)


def unpack(blob: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _blocks(first: str, second: str, most: int):
    """Batches of (row, text) to documents as numbers of their block's segments, and the segments."""

    def run(batches):
        pair, base, done = pair_of(first, second), TaskContext.get().partitionId() << 32, 0
        words, rows, codes, size = Numbers(), [], [], 0

        def flush():
            nonlocal done, words, rows, codes, size
            block, n, k = base + done, len(codes), len(words)
            yield pa.RecordBatch.from_arrays([pa.array(["doc"] * n), pa.array([block] * n, pa.int64()), pa.concat_arrays(rows), pa.array(codes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(["seg"] * k, pa.string()), pa.array([block] * k, pa.int64()), pa.nulls(k, rows[0].type), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(list(words), pa.string())], names=names)
            done, words, rows, codes, size = done + 1, Numbers(), [], [], 0

        names = ["kind", "block", "row", "codes", "local", "seg"]
        for batch in batches:
            low, kept, texts = 0, batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                codes.append(pack(np.fromiter(map(words.__getitem__, pair.split(text)), np.int32)) if text else None)
                size += len(text or "") + 64
                if size >= most:
                    rows.append(kept.slice(low, k + 1 - low))
                    low = k + 1
                    yield from flush()
            if low < batch.num_rows:
                rows.append(kept.slice(low))
        if codes:
            yield from flush()

    return run


def _aligned(first: str, second: str):
    """Batches of (block, local, seg), sorted by seg, to what the blocks get back: local numbers with their groups."""

    def run(batches):
        pair, last, known = pair_of(first, second), None, ""
        blocks, locals_, groups = [], [], []

        def flush():
            block, local = np.concatenate(blocks), np.concatenate(locals_)
            order = np.argsort(block, kind="stable")
            block, local, text = block[order], local[order], [groups[k] for k in order]
            at = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[at[:-1]]), pa.array([pack(local[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.binary()), pa.array([zstandard.compress("\n".join(text[x:y]).encode(), 3) for x, y in zip(at, at[1:], strict=False)], pa.binary())],
                names=["block", "locals", "groups"],
            )
            blocks.clear(), locals_.clear(), groups.clear()

        for batch in batches:
            segments = batch.column(2).to_pylist()
            fresh = list(dict.fromkeys(s for s in segments if s != last))
            found = dict(zip(fresh, pair.align(fresh), strict=True)) | ({last: known} if last is not None else {})
            blocks.append(batch.column(0).to_numpy())
            locals_.append(batch.column(1).to_numpy())
            groups += [found[s] for s in segments]
            if segments:
                last, known = segments[-1], found[segments[-1]]
            if len(groups) >= FLUSH:
                yield from flush()
        if groups:
            yield from flush()

    return run


def linked_pairs(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, pairs, ends) of segments, given their groups: numbers of first tokens, second tokens and groups of
    each; the linked pairs of all as numbers (first id times 2^32, plus second); and where each segment's pairs end."""
    text = "\n".join(strings)
    raw = np.frombuffer(text.encode(), np.uint8)
    before = np.concatenate(([10], raw[(raw < 48) | (raw > 57)]))  # the sign in front of each id: , ; | or a new line
    ids = np.array(text.translate({10: " ", 44: " ", 59: " ", 124: " "}).split(), np.int64)
    starts = (before == 10) | (before == 59)
    group, right = np.cumsum(starts) - 1, np.cumsum(before == 124) > np.cumsum(starts) - 1
    segment = (np.cumsum(before == 10) - 1)[starts]
    n_left, n_right = np.bincount(group[~right]), np.bincount(group[right])
    m = n_left * n_right
    first, second = (np.repeat(np.cumsum(n) - n, m) for n in (n_left, n_right))
    k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    pairs = (ids[~right][first + k // np.repeat(n_right, m)] << 32) + ids[right][second + k % np.repeat(n_right, m)]
    counts = np.stack([np.bincount(segment, w, len(strings)) for w in (n_left, n_right, np.ones(len(m)))], 1).astype(np.int64)
    return counts, pairs, np.cumsum(np.bincount(segment, m, len(strings))).astype(np.int64)


def _composed(row_type: pa.DataType, with_groups: bool):
    """A block's documents and alignments to composed documents, and the pairs with how many of the documents link them."""
    names = ["kind", "block", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "number", "a", "b", "docs"]

    def run(key, docs, alignments):
        block = key[0].as_py()
        strings = [""] * sum(len(unpack(x)) for x in alignments["locals"].to_pylist())
        for where, text in zip(alignments["locals"], alignments["groups"], strict=True):
            for k, s in zip(unpack(where.as_py()), zstandard.decompress(text.as_py()).decode().split("\n"), strict=True):
                strings[k] = s
        counts, ends, pairs = np.zeros((len(strings), 3), np.int64), np.zeros(len(strings) + 1, np.int64), np.empty(0, np.int64)
        if sound := [k for k, s in enumerate(strings) if s]:
            counts[sound], pairs, last = linked_pairs([strings[k] for k in sound])
            ends[np.array(sound) + 1] = np.diff(last, prepend=0)
            ends = np.cumsum(ends)
        pairs, number = np.unique(pairs, return_inverse=True)
        bad = np.array([not s for s in strings], bool)
        held, out, sizes = np.zeros(len(pairs), np.int64), {"groups": [], "links": []}, []
        for blob in docs["codes"]:
            codes = unpack(blob.as_py()) if blob.is_valid else None
            if codes is None or bad[codes].any():
                out["groups"].append(""), out["links"].append(None), sizes.append((0, 0, 0, 0))
                continue
            each, times = np.unique(codes, return_counts=True)
            n = ends[each + 1] - ends[each]
            at = np.arange(n.sum()) + np.repeat(ends[each] - np.cumsum(n) + n, n)
            used, back = np.unique(number[at], return_inverse=True)
            often = np.bincount(back, np.repeat(times, n)).astype(np.int32)
            held[used] += 1
            text = ";".join([strings[k] for k in codes.tolist()])
            out["groups"].append(text if with_groups else hashlib.sha256(text.encode()).hexdigest())
            out["links"].append(pack(np.concatenate((np.diff(used, prepend=0).astype(np.int32), often))))
            sizes.append((*(counts[each] * times[:, None]).sum(0).tolist(), int(often.sum())))
        n, k, sizes = len(sizes), len(pairs), np.array(sizes, np.int64).reshape(-1, 4)
        row = docs["row"].combine_chunks()
        row = row if isinstance(row, pa.Array) else pa.concat_arrays(row.chunks) if row.num_chunks else pa.nulls(0, row_type)
        none = lambda m, kind: pa.nulls(m, kind)
        left = [pa.array(["doc"] * n, pa.string()), pa.array([block] * n, pa.int64()), row, *(pa.array(sizes[:, c]) for c in range(4)), pa.array(out["groups"], pa.string()), pa.array(out["links"], pa.binary()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64())]
        right = [pa.array(["pair"] * k, pa.string()), pa.array([block] * k, pa.int64()), none(k, row.type), *(none(k, pa.int64()) for _ in range(4)), none(k, pa.string()), none(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(held)]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names=names) for x in (left, right)])

    return run


def _summed(docs, pairs):
    """Adds up the corpus-wide counts over the links of a block's documents."""
    at = pairs["number"].to_numpy()
    count, best = np.zeros((2, len(at)), np.int64)
    count[at], best[at] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    sums = []
    for blob in docs["links"]:
        if not blob.is_valid:
            sums.append((0, 0))
            continue
        used, often = unpack(blob.as_py()).astype(np.int64).reshape(2, -1)
        used = np.cumsum(used)
        sums.append((int(often @ best[used]), int(often @ count[used])))
    sums = np.array(sums, np.int64).reshape(-1, 2)
    return docs.drop_columns(["block", "links"]).append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1]))


def align(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", first: str | None = None, second: str | None = None, with_groups: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The kept columns with n_a, n_b, n_groups, n_links, groups, n_best and count_sum of every row.

    ``first`` is a byte-level BPE file, ``second`` a sentencepiece model.  ``groups`` is the aligned
    groups of ids in order, or, without ``with_groups``, only their SHA-256.
    """
    first, second = first or vocabulary_path("byte_bpe_50k.json"), second or vocabulary_path("piece_bpe_32k.model")
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    shape = rows.schema["row"].dataType.simpleString()
    cut = rows.mapInArrow(_blocks(first, second, block_chars), f"kind string, block long, row {shape}, codes binary, local int, seg string")
    cut = scratch.table(cut, "blocks", "kind")
    coded = cut.where("kind = 'doc'").select("block", "row", "codes")
    places = cut.where("kind = 'seg'").select("block", "local", "seg")
    sent = places.repartition("seg").sortWithinPartitions("seg").mapInArrow(_aligned(first, second), "block long, locals binary, groups binary")

    from pyspark.sql.pandas.types import to_arrow_type

    made = coded.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(
        _composed(to_arrow_type(rows.schema["row"].dataType), with_groups),
        f"kind string, block long, row {shape}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, number int, a long, b long, docs long",
    )
    made = scratch.table(made, "composed", "kind")
    scratch.drop("blocks")
    pairs = made.where("kind = 'pair'")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("long"))
    told = pairs.select("block", "number", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("of"), "number", "count", "best")
    composed = made.where("kind = 'doc'").select("block", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "links")
    out = composed.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_summed, f"row {shape}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return out.select("row.*", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op11_alignment(spark, sf_dir) -> DataFrame:
    return align(documents(spark, sf_dir), with_groups=False).withColumnRenamed("groups", "groups_sha256")
