import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from evigraph.llm import language_id, mixing, packing, simhash

import corpus_pipeline


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, was = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(was[j] + 1, d[-1] + 1, was[j - 1] + (x != y)))
    return d[-1]


def texts():
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(200)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    out = ["\n".join(say(rng.randint(3, 25)) for _ in range(rng.randint(1, 4))) for _ in range(50)]
    long = out[0].split("\n")[0] + " and a few words more than forty characters"
    return [*out, out[3], long, long + "x", "12345 67890", "", None]


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(22)
    rows = [(i, t, "en", rng.choice(["s0", "s0", "s1", "s2"]), len(t or "")) for i, t in enumerate(texts())]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {i: (t, s) for i, t, _, s, _ in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.schema == before.schema
        got = docs.collect()
        if k == 0:
            model = language_id.fit(language_id.training_profiles(before))
            kept = {i: v for i, v in kept.items() if not language_id.predict(v[0], model)[2]}
            assert {r["doc_id"] for r in got} == set(kept) and not {53, 54, 55} & set(kept)
        elif k == 1:
            first, left = {}, {}
            lines = [(i, p, x) for i in sorted(kept) for p, x in enumerate(kept[i][0].split("\n"))]
            for i, p, x in lines:
                first.setdefault(x, (i, p))
            allowed = lambda n: 2 if n >= 40 else 1 if n >= 12 else -1
            near = {x: [y for y in first if y != x and abs(len(x) - len(y)) <= 2 and distance(x, y) <= allowed(min(len(x), len(y)))] for x in first}
            for i, p, x in lines:
                if x.strip() and (first[x] != (i, p) or any(first[y] < first[x] for y in near[x])):
                    continue
                left.setdefault(i, []).append(x)
            kept = {i: ("\n".join(v), kept[i][1]) for i, v in left.items() if any(x.strip() for x in v)}
            assert {r["doc_id"]: r["text"] for r in got} == {i: v[0] for i, v in kept.items()} and len(got) == len(kept) < 53
        elif k == 2:
            group = {i: i for i in kept}
            fp = {i: int.from_bytes(simhash.bits(v[0], 5, 4), "big") for i, v in kept.items()}
            for i in fp:
                for j in fp:
                    if bin(fp[i] ^ fp[j]).count("1") <= simhash.near_radius():
                        a, b = group[i], group[j]
                        group = {x: min(a, b) if g in (a, b) else g for x, g in group.items()}
            kept = {i: v for i, v in kept.items() if i in set(group.values())}
            assert sorted(r["doc_id"] for r in got) == sorted(kept)
        else:
            size, most = Counter(), max(len(v[0].split()) for v in kept.values())
            for t, s in kept.values():
                size[s] += len(t.split())
            names = sorted(size)
            target = dict(zip(names, mixing.water_fill([size[s] for s in names], [5.0, 2.0, 1.0]), strict=True))
            taken = Counter()
            for r in got:
                taken[r["source"]] += len(r["text"].split())
            assert all(abs(taken[s] - target[s]) <= most for s in names) and max(Counter(r["doc_id"] for r in got).values()) <= 3
            mixed = got
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    encoder = packing.Encoder(packing.vocabulary())
    assert sum(r["length"] for r in pieces) == sum(len(encoder.encode(r["text"])) + 1 for r in mixed)
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def test_routing_tree_holds_no_copies_of_its_sample():
    x = np.random.default_rng(23).standard_normal((16384, packing.SKETCH), np.float32).astype(np.float16)
    rows = [r.tobytes() for r in x]
    tracemalloc.start()
    tree = packing.Tree(x, 64 * 2048, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tree.leaves == 64 and peak < 2 * x.nbytes
    leaf, _ = tree.route(x.astype(np.float32))
    assert np.bincount(leaf).tolist() == [256] * 64
    one = packing.ordered(pa.chunked_array([rows[:5000], rows[5000:]], pa.binary()))
    other = packing.ordered(pa.chunked_array([rows[::-1]], pa.binary()))
    assert np.array_equal(one, other) and sorted(r.tobytes() for r in one) == sorted(rows)


def test_language_model_holds_one_matrix_at_a_time():
    rng = np.random.default_rng(24)
    bins = [np.sort(rng.choice(language_id.BINS, 40, replace=False)) for _ in range(900)]
    rows = [(f"l{i // 300}", b, rng.integers(1, 9, len(b)), 0) for i, b in enumerate(bins)]
    tracemalloc.start()
    model = language_id.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model["langs"]) == 9 and peak < 1.5 * 300 * language_id.BINS * 4


def test_models_are_fitted_in_a_task(spark, tmp_path, monkeypatch):
    rng = random.Random(25)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(150)] for lang, letters in (("en", "abcdefgh"), ("de", "efghijklm"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 60))), lang) for i in range(600) for lang in [rng.choice(["en", "de"])]]
    spark.createDataFrame([*rows, (600, None, "en"), (601, "12", None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    wanted = language_id.fit(language_id.training_profiles(docs))
    pieces = packing.cut(docs, packing.vocabulary(), 64).where("sequence_id IS NULL")
    stats = packing.statistics(pieces, packing.encoder(packing.vocabulary()).terms)
    lists = [np.frombuffer(r["ids"], packing.id_type(len(stats.idf))) for r in pieces.select("ids").collect()]
    tree = packing.Tree(packing.ordered(pa.chunked_array([[x.tobytes() for x in stats.sketches(lists).astype(np.float16)]], pa.binary())), stats.pieces, 64)

    driver, fit, init = os.getpid(), language_id.fit, packing.Tree.__init__

    def elsewhere(f):
        def held(*args, **more):
            assert os.getpid() != driver, "fitted in the driver"
            return f(*args, **more)

        return held

    monkeypatch.setattr(language_id, "fit", elsewhere(fit))
    monkeypatch.setattr(packing.Tree, "__init__", elsewhere(init))
    got = language_id.learned(docs)
    assert got["langs"] == wanted["langs"] == ["de"] * 3 + ["en"] * 3
    assert all(np.array_equal(got[k], wanted[k]) for k in ("idf", "centroids")) and all(np.array_equal(a, b) for a, b in zip(got["limits"], wanted["limits"], strict=True))
    assert language_id.accepted(docs).count() > 0 and language_id.learned(docs.where("lang IS NULL")) is None and language_id.learned(docs.where("text IS NULL")) is None
    found = packing.routing(pieces, stats, 64)
    assert found.leaves == tree.leaves > 4
    assert np.array_equal(found.kids, tree.kids) and all(np.allclose(getattr(found, k), getattr(tree, k), atol=1e-6) for k in ("axes", "cuts"))  # threads of the matrix products differ
