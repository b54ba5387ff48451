import math
import random

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions import vector as V
from evigraph.operators import checks, curate, evals, evidence, graph, lineage, records, runs, search


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, unit_id string, rank long")


def test_fusion_worked_values(spark):
    word, tri = ranked(spark, [(1, "u", 1)]), ranked(spark, [(1, "u", 3)])
    none = ranked(spark, [(2, "z", 1)]).where("qid = 1")
    three = search.fuse({"word": word, "trigram": tri, "vector": none}).first()
    assert (three["raw"], three["normalized"]) == (pytest.approx(0.029092, abs=1e-6), pytest.approx(0.633787, abs=1e-6))
    assert search.fuse({"word": word, "trigram": tri}).first()["normalized"] == pytest.approx(0.985891, abs=1e-6)
    best = ranked(spark, [(1, "u", 1)])
    top = search.fuse({"word": best, "trigram": best, "vector": best}).first()
    assert top["normalized"] == 1.0 and top["raw"] == pytest.approx(0.045902, abs=1e-6)
    with pytest.raises(ValueError):
        search.fuse({"word": word}, executed=())


def test_boosts_are_capped(spark):
    value = lambda *x: one(spark, search.boost(*[F.lit(v) for v in x]))
    assert value(True, False, True) == pytest.approx(0.07)
    assert value(True, True, True) == pytest.approx(0.08)


def test_exact_id_tier_obeys_filters_and_ties_go_to_the_lower_id(spark):
    hits = spark.createDataFrame([(1, "b", 0.5, 0.5), (1, "a", 0.5, 0.5)], "qid long, unit_id string, normalized double, final double")
    units = spark.createDataFrame([("x", "en"), ("y", "fr")], "unit_id string, lang string")
    wanted = spark.createDataFrame([(1, "x"), (1, "y")], "qid long, unit_id string")
    got = search.final_order(search.with_exact_ids(hits, units, wanted, F.col("lang") == "en")).orderBy("position").collect()
    assert [(r["unit_id"], r["tier"]) for r in got] == [("x", 1), ("a", 0), ("b", 0)]


def test_short_queries_and_trigrams_of_han_text(spark):
    units = spark.createDataFrame([("1", "病毒感染"), ("2", "病")], "unit_id string, title string")
    got = search.short_match(units, spark.createDataFrame([(1, "病毒"), (2, "病")], "qid long, query string")).collect()
    assert {(r["qid"], r["unit_id"], r["exact"]) for r in got} == {(1, "1", False), (2, "1", False), (2, "2", True)}
    assert one(spark, T.trigrams(F.lit("病毒感染"))) == ["病毒感", "毒感染"] and one(spark, T.trigrams(F.lit("ab"))) == []


def test_text_functions(spark):
    assert one(spark, T.words(F.lit("Émile's Ça-va 42"))) == ["emile", "s", "ca", "va", "42"]
    assert one(spark, T.slug(F.lit(" Hello,  World! "))) == "hello-world"
    assert one(spark, T.citations(F.lit("a [@evd_1A] b [@evd_2]"))) == ["evd_1A", "evd_2"]
    assert one(spark, T.node_links(F.lit("[[kn_1|x]] [[STATE]]"))) == ["kn_1", "STATE"]
    assert one(spark, T.redact(F.lit("a=s1 b=s2"), F.array(F.lit("s1"), F.lit("s2")))) == "a=[REDACTED] b=[REDACTED]"
    for url, ok in [("https://a.org/x", True), ("http://10.0.0.1/", False), ("https://u:p@a.org", False), ("ftp://a.org", False), ("http://localhost:1", False)]:
        assert one(spark, T.url_allowed(F.lit(url))) is ok
    assert one(spark, T.html_text(F.lit("<p>a&amp;b</p><script>x</script> c"))) == "a&b c"


def test_verify_exact_repaired_failed(spark):
    text = "x" * 50 + "needle" + "y" * 50
    rows = [(text, "needle", 50, 56), (text, "needle", 40, 46), (text + "needle", "needle", 41, 47), (text, "absent", 1, 7)]
    got = evidence.verify(spark.createDataFrame(rows, "text string, quote string, char_start long, char_end long"), window=60).collect()
    assert [(r["status"], r["repaired_start"]) for r in got] == [("exact", 50), ("repaired", 50), ("failed", None), ("failed", None)]


def test_locate_equals_contains(spark):
    rng = random.Random(1)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    texts = [(i, " ".join(rng.choices(words, k=40))) for i in range(30)]
    quotes = [(i, texts[i][1][rng.randint(0, 20) :][: rng.choice([1, 2, 5, 9, 12, 20, 45])]) for i in range(20)] + [(99, "not in any text of them at all here")]
    got = evidence.locate(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(texts, "text_id long, text string")).collect()
    want = {(q, t, x.index(s)) for q, s in quotes for t, x in texts if s in x}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_graph_is_cycle_safe_and_bounded(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "p", "d")], "src string, predicate string, dst string").withColumn("directed", F.lit(True)).withColumn("evidence_status", F.lit("supported"))
    roots = spark.createDataFrame([("a",)], "root string")
    got = {(r["node"], r["depth"]) for r in graph.neighbors(e, roots, 3, "outgoing").collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    cut = graph.neighbors(e, roots, 3, "outgoing", max_nodes=2).collect()
    assert len(cut) == 2 and all(r["truncated"] for r in cut)
    pairs = spark.createDataFrame([("a", "d")], "source string, target string")
    assert [r["nodes"] for r in graph.shortest_paths(e, pairs, 4).collect()] == [["a", "c", "d"]]
    assert [r["nodes"] for r in graph.shortest_paths(e, pairs, 4, direction="respect").collect()] == [["a", "b", "c", "d"]]
    assert {r["node"] for r in graph.cyclic(e).collect()} >= {"a", "b", "c"}
    assert graph.cyclic(e.where("src <> 'c'")).count() == 0


def test_mentions_and_resolution(spark):
    names = spark.createDataFrame([("STATE", "n1"), ("Twin", "n2"), ("twin ", "n3")], "name string, node_id string")
    got = curate.resolve_mentions(spark.createDataFrame([("state",), ("TWIN",), ("zzz",)], "surface string"), names).collect()
    assert {(r["surface"], r["outcome"], r["target"]) for r in got} == {("state", "mentions", "n1"), ("TWIN", "ambiguous", None), ("zzz", "unresolved", None)}


def test_patches_fold_in_order(spark):
    p = spark.createDataFrame([("t", 1, "set", "a", "1"), ("t", 2, "set", "b", "2"), ("t", 3, "remove", "a", None), ("t", 4, "set", "b", "3")], "target_id string, ordinal long, op string, key string, value string")
    assert curate.fold_patches(p).first()["state"] == '{"b":"3"}'


def test_freshness_and_impact(spark):
    heads = spark.createDataFrame([("s", 2, False)], "source_id string, head long, removed boolean")
    claims = spark.createDataFrame([("s", 1), ("s", 2), ("s", None), ("gone", 1)], "source_id string, revision_id long")
    got = {(r["source_id"], r["revision_id"]): (r["freshness"], r["reasons"]) for r in lineage.freshness(claims, heads).collect()}
    assert got == {("s", 1): ("needs_review", ["source_revision_behind"]), ("s", 2): ("current", []), ("s", None): ("unknown", []), ("gone", 1): ("needs_review", ["source_removed"])}


def test_checks_and_runs(spark):
    m = lambda rows: spark.createDataFrame(rows, "path string, byte_size int, sha256 string")
    got = {r["path"]: r["change"] for r in checks.manifest_diff(m([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")]), m([("a", 1, "x"), ("b", 2, "y"), ("d", 1, "x")])).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    results = checks.doctor([("fine", spark.range(0), False), ("optional", spark.range(3), True)])
    assert checks.exit_code(results).first()["exit_code"] == 0
    assert checks.exit_code(checks.doctor([("bad", spark.range(3), False)])).first()["exit_code"] == 1
    assert one(spark, runs.recovery(F.lit("a"), F.lit("b"), F.lit("a"))) == "skip" and one(spark, runs.recovery(F.lit("b"), F.lit("b"), F.lit("a"))) == "roll_forward" and one(spark, runs.recovery(F.lit("z"), F.lit("b"), F.lit("a"))) == "conflict"
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    assert checks.snapshot(a, "t", "id", "v").first()["digest"] == checks.snapshot(a.repartition(3), "t", "id", "v").first()["digest"]


def test_knn_and_metrics(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    q = v.where("id < 5").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    got = {(r["qid"], r["id"]) for r in V.knn(v, q, 3).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(i, j) for i in range(5) for j in sorted((j for j in range(60) if j != i), key=lambda j: -cos(rows[i][1], rows[j][1]))[:3]}
    assert got == want
    metric = evals.retrieval(ranked(spark, [(1, "a", 1), (1, "b", 2)]), ranked(spark, [(1, "b", 0), (2, "c", 0)]).select("qid", "unit_id")).orderBy("qid").collect()
    assert metric[0]["mrr"] == 0.5 and metric[1]["mrr"] == 0.0


def test_cycles_of_long_chains_are_found_in_few_rounds(spark):
    chain = spark.range(0, 1000, 1, 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.cyclic(chain).count() == 0
    back = spark.createDataFrame([(1000, 900), (5000, 5001), (5001, 5000), (7, 9000), (9000, 9001)], "src long, dst long")
    assert {r["node"] for r in graph.cyclic(chain.unionByName(back)).collect()} == {*range(1001), 5000, 5001}


def test_cycles_equal_a_plain_search(spark):
    rng = random.Random(3)
    for _ in range(2):
        edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(22)}
        reach = {a: {b for x, b in edges if x == a} for a in range(25)}
        for _ in range(25):
            reach = {a: s | {c for b in s for c in reach[b]} for a, s in reach.items()}
        want = {a for a in reach if a in reach[a] or any(b in reach[b] for b in reach[a])}
        assert {r["node"] for r in graph.cyclic(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()} == want


def test_paths_equal_all_walks(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(14)}", rng.choice("pq"), f"n{rng.randrange(14)}", rng.choice(["supported", "uncertain", "conflicting"])) for _ in range(40)]
    frame = spark.createDataFrame(edges, "src string, predicate string, dst string, evidence_status string").withColumn("directed", F.lit(True))
    pairs = [(f"n{i}", f"n{(i * 5 + 3) % 14}") for i in range(14)]
    order = {"supported": 0, "uncertain": 1, "conflicting": 2}
    for direction in ("ignore", "respect"):
        steps = {(a, b, p, order[s]) for a, p, b, s in edges} | ({(b, a, p, order[s]) for a, p, b, s in edges} if direction == "ignore" else set())
        want = set()
        for source, target in pairs:
            walks = [((source,), (), ())] if source != target else []
            for _ in range(4):
                walks = [((*n, b), (*s, x), (*q, p)) for n, s, q in walks for a, b, p, x in steps if a == n[-1] and b not in n]
                hits = sorted({(s, q, n) for n, s, q in walks if n[-1] == target})[:3]
                if hits:
                    want |= {(source, target, n, i + 1) for i, (_, _, n) in enumerate(hits)}
                    break
        got = graph.shortest_paths(frame, spark.createDataFrame(pairs, "source string, target string"), direction=direction).collect()
        assert {(r["source"], r["target"], tuple(r["nodes"]), r["rank"]) for r in got} == want


def test_bm25_equals_plain_scores_and_filters_come_first(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(f"u{i:03}", " ".join(rng.choices(vocabulary, weights=[1 / k for k in range(1, 31)], k=rng.randint(0, 30))), i % 2) for i in range(300)]
    asked = [(i, " ".join(rng.choices(vocabulary, k=4))) for i in range(6)] + [(99, "none of these")]
    units, queries = spark.createDataFrame(docs, "unit_id string, body string, odd int").repartition(3), spark.createDataFrame(asked, "qid long, query string")
    words = {u: b.split() for u, b, _ in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = {w: sum(w in x for x in words.values()) for w in vocabulary}
    idf = {w: max(math.log((len(docs) - d + 0.5) / (d + 0.5)), 1e-6) for w, d in df.items()}
    score = lambda q, x: round(sum(idf[w] * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in set(q.split()) if w in x), 6)
    for where, keep in ((None, lambda o: True), (F.col("odd") == 1, lambda o: o == 1)):
        want = set()
        for qid, q in asked:
            hits = sorted(((-score(q, words[u]), u) for u, _, o in docs if keep(o) and score(q, words[u]) > 0))[:10]
            want |= {(qid, u, i + 1) for i, (_, u) in enumerate(hits)}
        got = search.rank_candidates(search.bm25(units, queries, T.words, where=where, n=10), 10).collect()
        assert {(r["qid"], r["unit_id"], r["rank"]) for r in got} == want


def test_questions_without_a_channel_are_bound_by_the_others(spark):
    word, near = ranked(spark, [(1, "u", 1), (2, "u", 1)]), ranked(spark, [(1, "u", 1)])
    got = {r["qid"]: r for r in search.fuse({"word": word, "vector": near}, able={"vector": near.select("qid")}).collect()}
    assert got[1]["normalized"] == got[2]["normalized"] == 1.0 and got[1]["degraded"] == [] and got[2]["degraded"] == ["vector"]


def test_cursors(spark):
    c = spark.createDataFrame([("a", "a", 3), ("a", "b", 3), ("a", "a", 2)], "query_fingerprint string, given_fingerprint string, given_generation int")
    assert [r["state"] for r in search.cursor_state(c, 3).collect()] == ["ok", "CURSOR_QUERY_MISMATCH", "CURSOR_STALE"]


def test_run_chain(spark):
    runs_ = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4)], "id long, parent_id long")
    got = {(r["start"], r["step"], r["id"]) for r in graph.chain(runs_, runs_.where("id = 3")).collect()}
    assert got == {(3, 0, 3), (3, 1, 2), (3, 2, 1)}
    with pytest.raises(RuntimeError):
        graph.chain(runs_, runs_.where("id = 4"), 5)


def test_hubs_of_many_pairs_are_not_walked_to_all_their_neighbours(spark, monkeypatch):
    # two hubs with 400 leaves each, joined by a way of two steps; leaves of a directed chain go on with one neighbour
    rows = [(f"{h}{k}", "in", h) for h in ("x", "y") for k in range(400)] + [("x", "up", "m"), ("y", "up", "m")]
    e = spark.createDataFrame([(*r, True, "supported") for r in rows], "src string, predicate string, dst string, directed boolean, evidence_status string")
    pairs = spark.createDataFrame([(f"x{k}", f"y{k}") for k in range(300)] + [(f"x{k}", f"x{k + 1}") for k in range(50)], "source string, target string")
    written, table = {}, graph.Scratch.table
    monkeypatch.setattr(graph.Scratch, "table", lambda self, frame, name, *by: written.setdefault(name, table(self, frame, name, *by)))
    got = {(r["source"], r["target"]): r["nodes"] for r in graph.shortest_paths(e, pairs, 4).collect()}
    assert got == {(f"x{k}", f"y{k}"): [f"x{k}", "x", "m", "y", f"y{k}"] for k in range(300)} | {(f"x{k}", f"x{k + 1}"): [f"x{k}", "x", f"x{k + 1}"] for k in range(50)}
    assert max(f.count() for f in written.values()) < 5_000
    monkeypatch.undo()
    chain = [("s", "to", "h")] + [("h", "to", f"l{k}") for k in range(30)] + [("l7", "to", "n"), ("n", "to", "t")]
    e = spark.createDataFrame([(*r, True, "supported") for r in chain], "src string, predicate string, dst string, directed boolean, evidence_status string")
    pairs = spark.createDataFrame([("s", "t")], "source string, target string")
    assert [r["nodes"] for r in graph.shortest_paths(e, pairs, 4, direction="respect").collect()] == [["s", "h", "l7", "n", "t"]]


def test_equal_keys_give_two_nodes_of_many(spark):
    nodes = spark.createDataFrame([(f"n{k:03d}", "many") for k in range(500)] + [("one", "single")], "node_id string, key string")
    mentions = spark.createDataFrame([(k, "many") for k in range(40)] + [(99, "single"), (100, "none")], "mention_id long, wanted string")
    found = curate.equal(mentions, nodes, 0.9)
    assert found.count() == 81 and {r["node_id"] for r in found.where("mention_id = 7").collect()} == {"n000", "n001"}
    got = {r["mention_id"]: (r["decision"], r["target"]) for r in curate.resolve_entities(mentions, [found]).collect()}
    assert got == {k: ("ambiguous", None) for k in range(40)} | {99: ("existing", "one"), 100: ("new", None)}


def test_nodes_of_questions_with_one_key_are_not_grouped(spark):
    nodes = spark.createDataFrame([("a b", "x"), ("n1", "A  b"), ("n2", "other"), ("A b", "y")], "node_id string, name string")
    aliases = spark.createDataFrame([(f"m{k}", "shared") for k in range(30)] + [("n1", "a b"), ("A b", "a b")], "node_id string, alias string")
    asked = spark.createDataFrame([(1, "A b"), (2, "shared"), (3, " Shared "), (4, None), (5, "nothing"), (6, "a b")], "qid long, given string")
    found = records.find_nodes(asked, nodes, aliases)
    assert "Union" in found._jdf.queryExecution().toString()
    rows = found.collect()
    got = {(r["qid"], r["node_id"]): r["by"] for r in rows}
    assert len(rows) == len(got) and got == {(2, f"m{k}"): "alias" for k in range(30)} | {(3, f"m{k}"): "alias" for k in range(30)} | {(q, n): by for q in (1, 6) for n, by in (("a b", "id"), ("n1", "name"), ("A b", "id" if q == 1 else "alias"))}
