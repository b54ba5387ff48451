import hashlib
import random
from collections import Counter, defaultdict

import pytest

from evigraph.llm import alignment

SCHEMA = "doc_id long, text string, lang string, block long, row string, groups string, kind string"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.vocabulary_path("byte_bpe_50k.json"), alignment.vocabulary_path("piece_bpe_32k.model"))


def saved(spark, tmp_path, texts, ids=None):
    """A table with extra columns whose names clash with internal ones."""
    rows = [(i, t, "en", 7, "r", "g", "seg") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents"))
    return spark.read.parquet(str(tmp_path / "documents"))


def whole(pair, text):
    """Groups of a text that is encoded as a whole."""
    return pair.groups(" " + text, pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ""


def by_hand(pair, texts):
    """The contract's columns from texts that are encoded as a whole."""
    groups = [whole(pair, t) for t in texts]
    links = [Counter((int(x), int(y)) for g in s.split(";") if g for x in g.split("|")[0].split(",") for y in g.split("|")[1].split(",")) for s in groups]
    held = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for s, found in zip(groups, links, strict=True):
        sides = [g.split("|") for g in s.split(";") if g]
        yield (
            sum(x.count(",") + 1 for x, _ in sides), sum(y.count(",") + 1 for _, y in sides), len(sides), sum(found.values()),
            sum(n for p, n in found.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in found.items()), s,
        )


PARTS = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\xa0", "　", " ", "\x1f", "\x85", "the", "word", "Don't", "'s", "é", "ß", "ﬁ", "日本", "🙂", "é", "123", "4", ".", ");", "\r", "{", "</s>", "<s>", "<|endoftext|>", "<0x41>", "\x00", "مرحبا", "​", "-", "___"]


def test_segments_give_what_whole_texts_give(pair):
    assert set(" \n\t") <= set(pair.safe) and "\r" not in pair.safe
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 14)))
        segments = pair.split(text)
        assert "".join(segments) == " " + text
        aligned = pair.align(segments)
        assert (";".join(aligned) if all(aligned) else "") == whole(pair, text), repr(text)


def test_unsafe_vocabularies_are_not_cut():
    assert alignment.safe_cuts([b"a b", b"c"], ["x"]) == "\n\t\v\f\r"
    assert " " not in alignment.safe_cuts([b"a"], ["x▁"])
    assert "\n" not in alignment.safe_cuts([b"a"], ["▁\n"])
    assert "\n" in alignment.safe_cuts([b" \n", b"\n\n"], ["\n"])


def test_columns_match_texts_encoded_as_a_whole(spark, tmp_path, pair):
    rng = random.Random(6)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "\n", "with ▁ sign", "long " * 20_000, "x" * 9_000, texts[0], texts[0], "the cat", "the cat", "the dog"]
    docs = saved(spark, tmp_path, texts)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(by_hand(pair, texts)):
        assert got[k] == want, repr(texts[k])[:200]


def test_blocks_do_not_matter(spark, tmp_path):
    texts = [f"common words and number {k % 7}\nthen more" for k in range(40)]
    docs = saved(spark, tmp_path, texts, ids=[None, *range(39)])
    want = sorted(map(str, alignment.align(docs, with_groups=False).collect()))
    assert sorted(map(str, alignment.align(docs.repartition(5), with_groups=False, block_chars=300).collect())) == want
    groups = alignment.align(docs).first()["groups"]
    assert hashlib.sha256(groups.encode()).hexdigest() in "".join(want)


def test_empty_tables(spark, tmp_path):
    assert alignment.align(saved(spark, tmp_path, ["x"]).where("doc_id < 0")).count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)).collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
