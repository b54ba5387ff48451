import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import language_id, line_dedup, mixing, packing, quality_model, quality_rules, secret_scan, simhash, suffix_dedup, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, h string, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def saved(spark, tmp_path, texts, ids=None, sources=None, langs=None):
    """A table with extra columns whose names clash with internal ones, read from files as in production."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["a"] * len(texts))[k], len(t or ""), "r", "h", "k") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choices(WORDS, k=k))
    texts = [say(rng.randint(0, 120)) + ("\n" + say(20)) * rng.randint(0, 3) for _ in range(n)]
    return [*texts, None, "", texts[0], texts[0], texts[1] + " x", "é" * 50, " \t\n ", " ".join(["word"] * 3000)]


OPERATORS = {
    "secrets": lambda d: secret_scan.findings_by_path(d, secret_scan.scan(d), ["doc_id"]),
    "suffix": lambda d: suffix_dedup.removed(d, 40, 15),
    "language": lambda d: language_id.identify(d, language_id.fit(language_id.training_profiles(d))),
    "quality": lambda d: quality_model.classify(d, quality_model.train([])),
    "packing": packing.pack,
    "winnowing": winnowing.compare_with_next,
    "simhash": simhash.groups,
    "mixing": lambda d: mixing.mix(d)[0],
    "lines": line_dedup.judged,
    "rules": quality_rules.evaluate,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tmp_path, name):
    assert OPERATORS[name](saved(spark, tmp_path, ["x"]).where("doc_id < 0")).count() == 0


def test_secrets_match_the_contract_and_the_ledger_is_incremental(spark, tmp_path):
    texts = ['é password = "abc123x" x', "token:abc secret:token:abcdef12", "AKIA" + "Z" * 16, "AKIAZZ", "f" * 24 + " " + "0" * 23, None, "", "x" * 5000 + " api_key=ABCDEF99", "api-key=ABCDEF99"]
    docs = saved(spark, tmp_path, [*texts, texts[0]])
    rows = {r["doc_id"]: r["findings"] for r in secret_scan.findings_by_path(docs, secret_scan.scan(docs), ["doc_id"]).collect()}
    assert len(rows) == len(texts) + 1 and rows[0] == rows[len(texts)]
    for i, text in enumerate(texts):
        base = [f for f in rows[i] if f["kind"] in secret_scan.BASE]
        digest = hashlib.sha256(",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in base).encode()).hexdigest()
        assert (*(sum(f["kind"] == k for f in base) for k in secret_scan.BASE), digest) == secret_scan.base_by_hand(text)
    ledger = secret_scan.ledger_rows(secret_scan.scan(docs))
    assert secret_scan.scan(docs, ledger).count() == 0
    newer = [(k, v + (k == "hex"), *rest) for k, v, *rest in secret_scan.RULES]
    again = secret_scan.scan(docs, ledger, newer).collect()
    assert len(again) == len(set(t or "" for t in texts)) and {tuple(r["scanned"]) for r in again} == {("hex@2",)}


def test_secret_findings_of_earlier_scans_reach_every_path(spark, tmp_path):
    texts = ["token=abcdef12 " + "f" * 24, "AKIA" + "Z" * 16, "nothing", "0" * 30 + " secret: abcdefgh"]
    old = saved(spark, tmp_path / "old", texts[:3])
    first = secret_scan.scan(old)
    # The second run: old blobs at old and new paths, a new blob, a newer and a new rule.
    docs = saved(spark, tmp_path / "new", [*texts, texts[0], texts[2]])
    rules = [(k, v + (k == "hex"), *rest) for k, v, *rest in secret_scan.RULES] + [("plain", 1, "nothing", 0, 0)]
    second = secret_scan.scan(docs, secret_scan.ledger_rows(first), rules)
    rows = secret_scan.finding_rows
    stored = rows(first).unionByName(rows(second)).unionByName(rows(second))  # an append that was repeated
    got = secret_scan.findings_by_path(docs, stored, ["doc_id"], rules=rules).collect()
    want = secret_scan.findings_by_path(docs, secret_scan.scan(docs, None, rules), ["doc_id"]).collect()
    assert sorted(got) == sorted(want) and len(got) == 6 and all(r["findings"] for r in got)
    assert {f["version"] for r in got for f in r["findings"] if f["kind"] == "hex"} == {2}
    kept = secret_scan.findings_by_path(old, rows(first), ["doc_id"]).collect()
    assert sorted(kept) == sorted(secret_scan.findings_by_path(old, first, ["doc_id"]).collect())


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup_equals_brute_force(spark, tmp_path, hot):
    texts = [*corpus(3, 40), "a" * 300, "ab" * 100, "x" * 39, "y" * 40]
    got = sorted(map(tuple, suffix_dedup.removed(saved(spark, tmp_path, texts), 40, 15, hot).collect()))
    assert got == [(i, *x) for i, x in enumerate(suffix_dedup.by_hand(texts, 40))]


def test_suffix_anchors_do_not_depend_on_pieces():
    data = " ".join(random.Random(5).choices(WORDS, k=2000)).encode()
    for a, b in zip(suffix_dedup.anchors(data), suffix_dedup.anchors(data, piece=700), strict=True):
        assert np.array_equal(a, b)


def test_language_on_held_out_rows(spark, tmp_path):
    rng = random.Random(4)
    alphabets = {"aa": "abcdefg", "bb": "fghijkl", "cc": "klmnopq"}
    langs = [rng.choice(list(alphabets)) for _ in range(240)]
    texts = [" ".join("".join(rng.choices(alphabets[g], k=rng.randint(2, 7))) for _ in range(30)) for g in langs]
    docs = saved(spark, tmp_path, [*texts, None, "123 ..."], langs=[*langs, "aa", "bb"])
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit(language_id.training_profiles(docs))).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.95 * len(held)
    assert got[240]["lang_pred"] == got[241]["lang_pred"] == "und" and got[240]["rejected"]
    long = "".join(rng.choices("abc déÉ1.", k=5000))
    size, language_id.PIECE = language_id.PIECE, 777
    pieces = language_id.profile(long)
    language_id.PIECE = size
    assert all(np.array_equal(a, b) for a, b in zip(pieces, language_id.profile(long), strict=True))


def test_quality_on_held_out_rows(spark, tmp_path):
    rng = random.Random(6)
    y = [rng.randint(0, 1) for _ in range(240)]
    texts = [" ".join(w + ("" if good else "***") for w in rng.choices(WORDS, k=25)) for good in y]
    docs = saved(spark, tmp_path, [*texts, "", None])
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(9999, None)], "doc_id long, quality int")
    model = quality_model.train(quality_model.training_rows(docs, labels), quality_model.label_share(labels))
    got = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.5) == bool(y[i]) for i in held) >= 0.95 * len(held)
    assert got[240] == got[241] == pytest.approx(1 / (1 + np.exp(-model["prior"])))


def test_packing_round_trip(spark, tmp_path):
    texts = [*corpus(7, 80), "漢字 mixed <|endoftext|> it's fine''s", "don't  stop\n\n now "]
    docs = saved(spark, tmp_path, texts)
    encoder, rows = packing.Encoder(packing.vocabulary()), packing.pack(docs, window=64, shard=16, with_ids=True).collect()
    whole = {i: encoder.whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    for i, ids in whole.items():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in mine for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"]) for r in mine)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= 64
    assert sum(sum(max(p)) < 64 for p in by.values()) <= docs.rdd.getNumPartitions()


def test_packing_searches_the_whole_table_whatever_the_files(spark, tmp_path):
    """Six topics of words of their own, dealt over the table: neighbours lie in other files and other runs of rows."""
    rng = random.Random(13)
    topics = [["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(12)] for _ in range(6)]
    texts = [" ".join(rng.choices(topics[i % 6], k=8)) for i in range(240)]
    mates = []
    for k, order in enumerate((sorted(range(240)), sorted(range(240), key=lambda i: i * 77 % 240))):
        docs = saved(spark, tmp_path / str(k), [texts[i] for i in order], order)
        by = {}
        for r in packing.pack(docs, window=64, shard=12).collect():
            by.setdefault(r["sequence_id"], set()).add((r["doc_id"], r["start"], r["length"]))
        pairs = [(x[0] % 6, y[0] % 6) for v in by.values() for x in v for y in v if x[0] < y[0]]
        assert sum(x == y for x, y in pairs) >= 0.8 * len(pairs) > 0
        mates.append({frozenset(v) for v in by.values()})
    assert mates[0] == mates[1]


def test_packing_is_the_same_in_every_partitioning(spark, tmp_path):
    rng = random.Random(21)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(300)] + ["the same text again"] * 90
    docs, found = saved(spark, tmp_path, texts), []
    for partitions, cores in ((3, 2), (8, 5)):
        for name, value in (("spark.sql.shuffle.partitions", partitions), ("spark.sql.leafNodeDefaultParallelism", cores)):
            spark.conf.set(name, value)
        rows = packing.pack(spark.read.parquet(str(tmp_path / "documents")), window=64, shard=20).where(f"sequence_id < {packing.WHOLE}").collect()
        found.append(sorted((r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"]) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert found[0] == found[1] and {r[2] for r in found[0]} == set(range(len(texts)))
    assert docs.count() == len(texts)


def test_shards_are_cut_from_counts():
    assert packing.cut_shards([3, 4, 5, 25, 2, 8, 1], 10) == [0, 0, 1, 2, 5, 5, 6]
    assert packing.cut_shards([], 10) == []


def test_packing_counts_terms_over_the_whole_table(spark, tmp_path):
    docs = saved(spark, tmp_path, texts := corpus(14, 40))
    encoder = packing.encoder(packing.vocabulary())
    pieces = [ids[a : a + 64] for t in texts for ids in [[*encoder.encode(t or "").tolist(), 0]] for a in range(0, len(ids), 64)]
    pieces = [p for p in pieces if len(p) < 64]
    stats = packing.statistics(packing.cut(docs, packing.vocabulary(), 64).where("sequence_id IS NULL"), encoder.terms)
    df = np.bincount([x for p in pieces for x in set(p)], minlength=encoder.terms)
    assert stats.pieces == len(pieces) and stats.mean == sum(map(len, pieces)) / len(pieces)
    assert np.allclose(stats.idf, np.maximum(np.log((len(pieces) - df + 0.5) / (df + 0.5)), 0))


def test_fast_encoding_equals_the_tokenizer():
    rng = random.Random(8)
    encoder = packing.Encoder(packing.vocabulary())
    texts = ["".join(rng.choices([chr(i) for i in range(1, 0x250)] if k % 2 else "'stmdrevel 12\n\t.é ", k=rng.randint(0, 40))) for k in range(1500)]
    for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
        assert ids.tolist() == encoder.whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_winnowing_by_hand_and_its_guarantee(spark, tmp_path):
    text = "".join(random.Random(9).choices("abcd é", k=700))
    hashes = winnowing.gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), 12) >> np.uint64(21)
    want = sorted({max(i + j for j in range(32) if hashes[i + j] == hashes[i : i + 32].min()) for i in range(len(hashes) - 31)})
    assert winnowing.winnow(text)[1].tolist() == want
    part = text[100 : 100 + winnowing.W + winnowing.K - 1]
    assert set(winnowing.winnow("zz" * 40 + part + "yy" * 40)[0]) & set(winnowing.winnow(text)[0])
    texts = corpus(10, 30)
    got = {r["doc_id"]: r for r in winnowing.compare_with_next(saved(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(winnowing.edited(t, after).encode()).hexdigest()
        assert got[i]["near_next"] == winnowing.likeness(*(np.unique(winnowing.winnow(x)[0]) for x in (t, after)))


def test_simhash_components_equal_brute_force(spark, tmp_path):
    texts = corpus(11, 80)
    rows = simhash.groups(saved(spark, tmp_path, texts)).collect()
    fps = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in rows}
    root = {i: i for i in fps}
    for i in sorted(fps):
        for j in fps:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert all(r["component_id"] == root[r["doc_id"]] for r in rows) and len(rows) == len(texts)
    kept = simhash.one_of_each(saved(spark, tmp_path, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root.values()))


def test_bk_forest_finds_every_link():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, 3), dtype=np.uint64), axis=1) for b in base]]))
    shard = np.sort(rng.integers(0, 3, len(fps)))
    shard = np.unique(shard, return_inverse=True)[1]
    found = {(int(a), int(b)) for x, y in simhash.Forest(shard, fps.reshape(-1, 1)).search(np.arange(len(fps)), 4) for a, b in zip(x, y, strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and shard[i] == shard[j] and near[i, j]}


def test_mixing_meets_its_targets(spark, tmp_path):
    rng = random.Random(13)
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in range(120)] + ["tiny"]
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 200))) for _ in range(120)] + ["one"]
    rows, plan = mixing.mix(saved(spark, tmp_path, texts, sources=sources), block=16)
    rows = rows.collect()
    total = sum(len(t.split()) for t in texts)
    assert sum(p["target"] for p in plan) == pytest.approx(total)
    for p in plan:
        mine = [r for r in rows if r["source"] == p["source"]]
        assert sum(r["taken"] for r in mine) == p["take"] == int(p["target"]) and p["target"] <= 3 * p["size"]
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    assert mixing.water_fill([0, 0], [5, 2]) == [0.0, 0.0]


def test_mixing_hands_on_the_schedule(spark, tmp_path):
    rng = random.Random(23)
    sources = ["a"] * 60 + ["b"] * 60 + ["c"] * 60 + ["a"]
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(180)] + [""]
    docs = saved(spark, tmp_path, texts, sources=sources)
    rows = mixing.Scratch(spark, "test").table(mixing.sized(docs), "rows")
    plan = mixing.source_plan(rows, block=16)
    slots = {r["slot"]: (r["i"], r["rank"]) for r in mixing.schedule(spark, plan, 16).collect()}
    spans = sorted(mixing.scheduled(rows, plan, 16).collect())
    assert set(slots) == {r["slot"] for r in spans}
    by, sums = {}, {}
    for r in spans:
        p, (i, rank) = next(p for p in plan if p["source"] == r["source"]), slots[r["slot"]]
        assert p["i"] == i and 0 <= r["first"] < r["last"] <= len(texts[r["doc_id"]].split()) and r["at"] // 16 == rank % p["blocks"]
        by[r["slot"]] = by.get(r["slot"], 0) + r["last"] - r["first"]
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["last"] - r["first"]
    for slot, (i, rank) in slots.items():
        p = plan[i]
        if rank < p["slots"] - 1:
            assert by[slot] == min(16, p["size"] - rank % p["blocks"] * 16)
    assert sums == {r["doc_id"]: r["taken"] for r in mixing.taken(rows, plan, 16).collect() if r["taken"]}
    # Documents leave in the order of their slots: each stretch has the sources' shares, and copies are an epoch apart.
    mix = mixing.mixed(docs, block=16).collect()
    assert mix and all(x["doc_id"] != y["doc_id"] for x, y in zip(mix, mix[1:], strict=False))
    total = sum(p["target"] for p in plan)
    for part in (mix[: len(mix) // 2], mix[len(mix) // 2 :]):
        words = {s: sum(len(d["text"].split()) for d in part if d["source"] == s) for s in "abc"}
        assert all(abs(words[p["source"]] / sum(words.values()) - p["target"] / total) < 0.1 for p in plan)


def test_line_links_equal_brute_force(spark, tmp_path):
    rng = random.Random(14)
    base = [" ".join(rng.choices(WORDS, k=10))[: rng.choice([13, 38, 41, 60])] for _ in range(40)]

    def edit(s):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "q" + s[i:], s[:i] + "é" + s[i + 1 :], s[:i] + " " + s[i:]])
        return s

    texts = ["\n".join(edit(rng.choice(base)) for _ in range(4)) + "\nshort\n" for _ in range(40)] + [None, ""]
    rows = line_dedup.judged(saved(spark, tmp_path, texts)).groupBy("rid").agg(F.sum("n_links").alias("n"), F.count_if("dropped").alias("d")).collect()
    lines = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if x.strip()]
    first = {}
    for i, p, x in lines:
        first.setdefault(x, (i, p))

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, was = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(was[j] + 1, d[-1] + 1, was[j - 1] + (x != y)))
        return d[-1]

    allowed = lambda n: 2 if n >= 40 else 1 if n >= 12 else -1
    far = {x: [y for y in first if y != x and abs(len(x) - len(y)) <= 2 and distance(x, y) <= allowed(min(len(x), len(y)))] for x in first}
    dropped = sum(first[x] != (i, p) or any(first[y] < first[x] for y in far[x]) for i, p, x in lines)
    assert sum(r["n"] for r in rows) == sum(len(far[x]) for _, _, x in lines) > 0
    assert sum(r["d"] for r in rows) == dropped
    left = line_dedup.deduped(saved(spark, tmp_path, texts)).collect()
    assert sum(1 for r in left for x in (r["text"] or "").split("\n") if x.strip()) == len(lines) - dropped


def test_rules_ledger_and_ablation(spark, tmp_path):
    texts = [*corpus(15, 20), "one two three four five six seven eight nine ten " * 2, "a b\nA b\na b\n#%$", "### " * 30]
    got = {r["doc_id"]: r for r in quality_rules.evaluate(saved(spark, tmp_path, texts)).collect()}
    for i, text in enumerate(texts):
        w = (text or "").split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 400 else set(range(len(w)))
        ls = [x for x in (text or "").split("\n") if x.strip()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), len(twice), len(ls) - len(set(ls)))
    ledger = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4)], "doc_id long, fail_bits long")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_policy(ledger, "base").collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True}
    out = {r["rule"]: (r["failed"], r["failed_alone"], r["kept_without"]) for r in quality_rules.ablation(ledger, "base").collect()}
    assert out == {"few_words": (2, 1, 3), "repeated_windows": (1, 0, 2)}


def test_secret_store_reads_nothing_old(spark, tmp_path):
    store = secret_scan.Store(spark, f"file://{tmp_path}/store")
    old = saved(spark, tmp_path / "old", ["token=abcdef12", "nothing"])
    store.update(old)
    assert secret_scan.scan(old, store.seen()).count() == 0
    docs = saved(spark, tmp_path / "new", ["token=abcdef12", "secret: abcdefgh", None])
    assert {r["blob"] for r in secret_scan.scan(docs, store.seen()).collect()} == {hashlib.sha256(x).hexdigest() for x in (b"secret: abcdefgh", b"")}
    store.update(docs)
    store.update(docs)
    got = sorted(secret_scan.findings_by_path(docs, store.stored(), ["doc_id"]).collect())
    assert got == sorted(secret_scan.findings_by_path(docs, secret_scan.scan(docs), ["doc_id"]).collect()) and [len(r["findings"]) for r in got] == [1, 1, 0]


def test_secret_kinds_beyond_the_base():
    key, tail = "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    text = f"é {key} x {tail} ghp_{'a1' * 18} https://me:hunter22@host/"
    assert [(k, text[a:b]) for k, _, a, b in secret_scan.find(text) if k not in secret_scan.BASE] == [("pem", key), ("jwt", tail), ("hosting", "ghp_" + "a1" * 18), ("urlauth", "https://me:hunter22@")]


def test_language_rejects_what_is_none_of_the_learned(spark, tmp_path):
    rng = random.Random(31)
    roots = {g: ["".join(rng.choices(a, k=rng.randint(3, 8))) for _ in range(60)] for g, a in {"aa": "abcdefgaei", "bb": "mnopqrsoou"}.items()}
    langs = [rng.choice(["aa", "bb"]) for _ in range(200)]
    texts = [" ".join(rng.choices(roots[g], k=rng.randint(3, 80))) for g in langs]
    strange = ["".join(rng.choices("ضصثقفغعهخحجد ", k=300)), "".join(rng.choices("vwxyzjkl ", k=300))]
    docs = saved(spark, tmp_path, [*texts, *strange], langs=[*langs, None, None])
    got = {r["doc_id"]: r["rejected"] for r in language_id.identify(docs, language_id.fit(language_id.training_profiles(docs))).collect()}
    assert got[200] and got[201] and not any(got[i] for i in range(200))


def test_language_equals_a_plain_classifier(spark, tmp_path):
    """Counts by a dictionary of n-grams; the same hash, idf and centroids."""
    rng = random.Random(32)
    docs = saved(spark, tmp_path, ["".join(rng.choices("abcdé XY1.", k=rng.randint(0, 90))) for _ in range(60)], langs=[rng.choice(["aa", "bb"]) for _ in range(60)])
    model = language_id.fit(language_id.training_profiles(docs))

    def plain(text):
        c, m = [ord(x) if x.isalpha() else 0 for x in text.lower()], 2**32
        bins = {}
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                g = c[i : i + n]
                if any(g):
                    pair = lambda k: (g[k + 1] * 0x85EBCA6B + g[k] * 0x9E3779B1) % m  # noqa: E731, B023
                    h = g[0] * 0x165667B1 % m if n == 1 else pair(0) if n == 2 else (pair(1) * 0xC2B2AE35 + g[0] * 0x27D4EB2F) % m
                    h = (h ^ h >> 15) * 0x2C1B3C6D % m >> 19
                    bins[h] = bins.get(h, 0) + 1
        if not bins:
            return "und", 0.0
        x = {h: np.log1p(k) * model["idf"][h] for h, k in bins.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        best = max(range(len(model["langs"])), key=lambda j: sum(v * model["centroids"][j][h] for h, v in x.items()))
        return model["langs"][best], sum(v * model["centroids"][best][h] for h, v in x.items()) / norm

    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for r in docs.collect():
        lang, score = plain(r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score)


def test_quality_score_equals_the_unfolded_network(spark, tmp_path):
    rng = np.random.default_rng(33)
    model = {"table": rng.normal(size=quality_model.BUCKETS).astype(np.float32), "bias": 0.25, "prior": -0.5}
    text = "one two two three\nfour"
    words, data = text.encode().split(), text.encode()
    assert len(quality_model.features(text)) == len(words) + len(data) - 2 + 1  # words, trigrams, one repeat
    z = float(np.mean([model["table"][i] for i in quality_model.features(text)])) + model["bias"]
    n = len(quality_model.features(text))
    z = (n * z - 0.5 * quality_model.PRIOR_FEATURES) / (n + quality_model.PRIOR_FEATURES)
    assert quality_model.score(text, model) == pytest.approx(1 / (1 + np.exp(-z)))


def test_packing_scores_equal_plain_bm25():
    rng = random.Random(34)
    pieces = [np.array(rng.choices(range(1, 60), weights=[1 / i for i in range(1, 60)], k=rng.randint(1, 80)), np.uint16) for _ in range(90)]
    df = np.bincount([x for p in pieces for x in set(p.tolist())], minlength=60)
    stats = packing.Stats(len(pieces), float(np.mean([len(p) for p in pieces])), df)
    shard = packing.Shard(pieces, stats)
    for q in (0, 7, 50):
        got = shard.scores(q)
        for d, piece in enumerate(pieces):
            counts = piece.tolist()
            want = sum(max(0, np.log((len(pieces) - df[t] + 0.5) / (df[t] + 0.5))) * counts.count(t) * 2.2 / (counts.count(t) + 1.2 * (0.25 + 0.75 * len(counts) / stats.mean)) for t in set(pieces[q].tolist()))
            assert got[d] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_fingerprint_positions_and_many_rows_of_one_id(spark, tmp_path):
    texts = corpus(35, 30)
    ids = [7] * 20 + [None] * 5 + list(range(10, len(texts) - 15))
    docs = saved(spark, tmp_path, texts, ids)
    rows = winnowing.with_next(docs, 4).collect()
    mine = [r for r in rows if not r["borrowed"]]
    assert len(mine) == len(texts) and len({r["block"] for r in rows}) > 5
    order = sorted(mine, key=lambda r: (r["k"], r["h"], r["rid"]))
    assert [r["block"] for r in order] == sorted(r["block"] for r in order)
    lent = {r["block"]: r["rid"] for r in rows if r["borrowed"]}
    firsts = [next(r["rid"] for r in order if r["block"] == b) for b in sorted({r["block"] for r in order})]
    assert [lent[b] for b in sorted(lent)] == firsts[1:] + firsts[:1]
    got = winnowing.compare_with_next(docs).collect()
    plain = {tuple(winnowing.winnow(t or "")[1].tolist()) for t in texts}
    assert len(got) == len(texts) and {tuple(r["positions"]) for r in got} == plain
    kept = winnowing.fingerprints(docs).collect()
    assert {tuple(r["positions"]) for r in kept} == plain and all(len(r["hashes"]) == len(r["positions"]) for r in kept)


def test_simhash_bits_by_hand():
    import xxhash

    text = "The  QUICK brown\tfox jumps É over The quick brown fox"
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    votes = [0] * 64
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))
    assert simhash.fingerprint(" \n ") == simhash.fingerprint(None) == 0 and simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_crowds_keep_their_components():
    """A crowd of variants, a second one and strangers: as many components as a search of all pairs finds."""
    rng = np.random.default_rng(36)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flip = lambda b, n: b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 2), dtype=np.uint64), axis=1)
    fps = np.unique(np.concatenate([base, flip(base[0], 900), flip(base[1], 300)]))
    rng.shuffle(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        step = np.where(near, label[None, :], len(fps)).min(axis=1)
        if np.array_equal(step, label):
            break
        label = step
    a, b = simhash.spanning_links(np.zeros(len(fps), np.int64), fps.reshape(-1, 1))
    got = np.arange(len(fps))
    got[a] = b
    assert np.array_equal(got[:, None] == got[None, :], label[:, None] == label[None, :])


def test_near_groups_find_similar_texts_and_leave_others(spark, tmp_path):
    rng = random.Random(37)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(4000)]
    base = [rng.choices(vocabulary, k=200) for _ in range(300)]
    close = [list(w) for w in base[:100]]
    for w in close:
        for _ in range(2):  # ten of about 200 shingles differ
            w[rng.randrange(200)] = "other"
    far = [list(w) for w in base[100:200]]
    for w in far:
        for _ in range(40):
            w[rng.randrange(200)] = rng.choice(vocabulary)
    docs = saved(spark, tmp_path, [" ".join(w) for w in [*base, *close, *far]])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert simhash.near_tables(500)[1] > 1
    assert sum(got[300 + i] == i for i in range(100)) >= 95
    assert all(got[400 + i] == 400 + i for i in range(100)) and all(got[i] == i for i in range(300))
    assert simhash.near_radius() == 48 and simhash.near_tables(60) == (0, 1)


CLASHES = ["rejected", "score", "__text", "__drop", "__rid", "__n", "__starts", "__total", "fp", "root", "rid", "i", "size", "key", "slot", "lang_pred"]


def test_stages_keep_columns_named_like_their_own(spark, tmp_path):
    path = str(tmp_path / "documents")
    texts = corpus(38, 20)
    rows = [(i, t, "en", "ab"[i % 2], *([f"mine{i}"] * len(CLASHES))) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)).write.parquet(path)
    docs = spark.read.parquet(path)
    for stage in (language_id.accepted, line_dedup.deduped, simhash.one_of_each, mixing.mixed):
        got = stage(docs)
        assert got.columns == docs.columns
        kept = got.collect()
        assert kept and all(r[c] == f"mine{r['doc_id']}" for r in kept for c in CLASHES)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    docs = saved(spark, tmp_path, ["same text here now"] * 3 + ["other words stand here"], ids=[1, 1, None, 2])
    assert simhash.groups(docs).count() == 4 and simhash.one_of_each(docs).count() == 2
    assert winnowing.compare_with_next(docs).count() == 4 and suffix_dedup.removed(docs).count() == 4
    assert mixing.mix(docs)[0].count() == 4 and quality_rules.evaluate(docs).count() == 4
    assert line_dedup.deduped(docs).count() == 2


def test_language_id_keeps_a_column_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "a text of words", "mine"), (2, None, None)], "doc_id long, text string, __text string")
    found = {r["doc_id"]: (r["text"], r["__text"], r["lang_pred"]) for r in language_id.identify(docs, None, docs.columns).collect()}
    assert found == {1: ("a text of words", "mine", "und"), 2: (None, None, "und")}


@pytest.mark.parametrize("name", ["suffix", "lines", "winnowing", "near", "mix"])
def test_row_numbers_hold_when_the_cores_change(spark, tmp_path, name, monkeypatch):
    """Every job of an operator reads the files in other splits than the job before."""
    texts = corpus(9, 80)
    docs = saved(spark, tmp_path, texts, ids=[k // 2 for k in range(len(texts))])
    run = {
        "suffix": lambda d: suffix_dedup.removed(d, 40, 15, stored=True),
        "lines": lambda d: line_dedup.deduped(d, stored=True),
        "winnowing": lambda d: winnowing.with_next(d, 10, stored=True).groupBy("k", "h", "text", "borrowed").count(),
        "near": lambda d: simhash.one_of_each(d, stored=True),
        "mix": lambda d: mixing.mixed(d, stored=True),
    }[name]
    want = sorted(map(str, run(docs).collect()))
    numbers, write = iter(range(10**6)), type(docs.write).parquet
    keys = {"spark.sql.files.maxPartitionBytes": ("2k", "64m", "700"), "spark.sql.files.openCostInBytes": ("1", "4m", "10")}

    def change():
        k = next(numbers)
        for key, found in keys.items():
            spark.conf.set(key, found[k % 3])

    monkeypatch.setattr(type(docs.write), "parquet", lambda *a, **b: (change(), write(*a, **b))[1])
    try:
        out = run(docs)
        change()
        got = sorted(map(str, out.collect()))
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == want and next(numbers) >= 1
