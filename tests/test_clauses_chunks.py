import random
import re

import pytest

from evigraph.operators import chunks, clauses, curate

WORDS = "alpha beta gamma delta epsilon zeta".split()
EMPTY = {"every": [], "some": [], "none": [], "prefixes": []}
SCHEMA = "qid long, every array<string>, some array<string>, none array<string>, prefixes array<string>"


def asking(spark, rows):
    return spark.createDataFrame([(i, *({**EMPTY, **r}[c] for c in ("every", "some", "none", "prefixes"))) for i, r in enumerate(rows)], SCHEMA)


def places(tokens, clause):
    terms = clause.lower().split()
    return sum(tokens[i : i + len(terms)] == terms for i in range(len(tokens)))


def test_clauses_equal_a_plain_search(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(80)] + [None, "Álpha, BETA!"]
    units = spark.createDataFrame([(str(i), t, "clash", 1) for i, t in enumerate(texts)], "unit_id string, body string, key string, size int")
    rows = []
    for _ in range(40):
        phrase = " ".join(rng.choices(WORDS, k=rng.randint(1, 3)))
        rows.append({"every": [phrase, rng.choice(WORDS)], "some": rng.choices(WORDS, k=rng.randint(0, 2)), "none": [" ".join(rng.choices(WORDS, k=2))], "prefixes": rng.choice([[], ["de"], ["ga", "zet"]])})
    rows += [{"every": ["alpha alpha"]}, {"some": ["no", "such"]}, {"prefixes": ["al"], "every": None}, {"every": ["(alpha) AND *"]}]
    want = set()
    for q, row in enumerate(rows):
        r = {k: [x.replace("(", "").replace(")", "").replace(" *", "").strip() for x in v or []] for k, v in {**EMPTY, **row}.items()}
        for i, t in enumerate(texts):
            tokens = re.findall(r"\w+", (t or "").lower().replace("á", "a"))
            every = [places(tokens, x) for x in r["every"]] + [sum(w.startswith(x) for w in tokens) for x in r["prefixes"]]
            some = [places(tokens, x) for x in r["some"]]
            if all(every) and (any(some) or not some) and not any(places(tokens, x) for x in r["none"]):
                want.add((q, str(i), sum(every) + sum(some)))
    got = {tuple(r) for r in clauses.match(units, asking(spark, rows)).select("qid", "unit_id", "hits").collect()}
    assert got == want and len(want) > 50
    assert clauses.match(units.where("false"), asking(spark, rows)).isEmpty() and clauses.match(units, asking(spark, rows).where("false")).isEmpty()


def test_questions_beyond_the_limits_are_errors(spark):
    rows = [{"every": ["x" * 1001]}, {"some": ["a b"] * 33}, {"prefixes": ["a"]}, {"none": ["alpha"]}, {"every": ["..."]}, {"every": ["fine"]}]
    assert {r["qid"]: r["reason"] for r in clauses.refused(asking(spark, rows)).collect()} == {0: "too_long", 1: "too_many_terms", 2: "prefix_length", 3: "nothing_required", 4: "nothing_required"}
    units = spark.createDataFrame([("1", "alpha")], "unit_id string, body string")
    with pytest.raises(ValueError, match="INVALID_QUERY"):
        clauses.match(units, asking(spark, rows))


def in_order(text):
    """The same chunks, made by going through the lines in order."""
    found, block, kind, section, fence = [], [], None, 0, False

    def close():
        nonlocal block
        if block:
            found.append((section, kind, "\n".join(block)))
        block = []

    for line in (text or "").split("\n"):
        if line.startswith("```") or fence:
            if not fence:
                close()
            kind = "code"
            block.append(line)
            if line.startswith("```"):
                fence = not fence
                if not fence:
                    close()
                    kind = None
        elif not line.strip(" \t\n\v\f\r"):
            close()
            kind = None
        else:
            now = "table" if line.startswith("|") else "text"
            if now != kind or (now == "text" and re.match("#{1,6} ", line)):
                close()
            if now == "text" and line.startswith("# "):
                section += 1
            kind = now
            block.append(line)
    close()
    runs, last = [], None
    for section, kind, body in found:
        width = chunks.PIECE if kind == "text" else 4000
        own = kind != "text" and len(body) > chunks.PIECE
        for i in range(0, len(body), width):
            if own or last is None or last != (section, False):
                runs.append((section, []))
            runs[-1][1].append((i == 0, body[i : i + width]))
            last = (section, own)
    out = []
    for section, parts in runs:
        size, held = 0, {}
        for part in parts:
            held.setdefault(size // 600, []).append(part)
            size += -(-(len(part[1]) + 2) // 4)
        tail = ""
        for _, some in sorted(held.items()):
            body = "".join(("\n\n" if k and fresh else "") + x for k, (fresh, x) in enumerate(some))
            out.append((section, tail + ("\n\n" if tail and some[0][0] else "") + body, len(tail)))
            tail = body[-400:]
    return out


def test_section_chunks_equal_a_walk_through_the_lines(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))
    make = [line, lambda: "# " + line(), lambda: "## sub", lambda: "", lambda: "", lambda: "\n".join("|" + line() for _ in range(rng.randint(1, 8))), lambda: "```\n# no heading\n\n" + "\n".join(line() for _ in range(rng.randint(0, 25))) + "\n```", lambda: line() * 12]
    texts = ["\n".join(rng.choice(make)() for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts += [None, "", " \n\t", "x" * 20000, "|" + "y" * 9000, "```\nnever closed\n\n# still code", "```\na\n```\n```\nb\n```", "é" * 1181]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "owner_id long, text string, block int, k string")
    rows = sorted(chunks.section_chunks(frame).collect())
    want = [(i, n, *c) for i, t in enumerate(texts) for n, c in enumerate(in_order(t))]
    assert [(r["owner_id"], r["ordinal"], r["section"], r["text"], r["overlap"]) for r in rows] == want
    assert max(r["tokens"] for r in rows) <= 1000 and any(r["overlap"] == 400 for r in rows)
    assert all(r["tokens"] == -(-len(r["text"]) // 4) for r in rows)
    assert chunks.section_chunks(frame.where("false")).isEmpty()


def test_cascade_asks_each_channel_only_for_what_is_left(spark):
    mentions = spark.createDataFrame([(i,) for i in range(5)], "mention_id long")
    asked = []

    def channel(*found):
        def step(left):
            asked.append({r["mention_id"] for r in left.collect()})
            return spark.createDataFrame(found, "mention_id long, node_id string, score double").join(left, "mention_id", "left_semi")

        return step

    steps = [("identifier", channel((0, "a", 1.0))), ("name", channel((0, "x", 1.0), (1, "b", 0.95), (1, "b", 0.9))), ("text", channel((2, "c", 0.9), (2, "d", 0.86))), ("vector", channel((2, "c", 0.9), (3, "c", 0.9), (3, "d", 0.85)))]
    got = {tuple(r) for r in curate.cascade(mentions, steps).select("mention_id", "decision", "target", "channel").collect()}
    assert got == {(0, "existing", "a", "identifier"), (1, "existing", "b", "name"), (2, "ambiguous", None, "text"), (3, "existing", "c", "vector"), (4, "new", None, None)}
    assert asked == [{0, 1, 2, 3, 4}, {1, 2, 3, 4}, {2, 3, 4}, {3, 4}]
    assert curate.cascade(mentions.where("false"), steps[:1]).isEmpty()


def test_clauses_are_matched_where_units_are_read(spark):
    units = spark.createDataFrame([(f"u{k:04d}", "b a a" if k % 2 else "a a b a") for k in range(5_000)], "unit_id string, body string").coalesce(1)
    questions = spark.createDataFrame([(7, ["a"], ["b a", "a b"], ["c"], None), (8, ["a a b"], None, None, None)], "qid int, every array<string>, some array<string>, none array<string>, prefixes array<string>")
    found = clauses.match(units, questions)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    rows = {(r["qid"], r["unit_id"]): r["hits"] for r in found.collect()}
    assert rows == {(7, f"u{k:04d}"): 3 if k % 2 else 5 for k in range(5_000)} | {(8, f"u{k:04d}"): 1 for k in range(0, 5_000, 2)}
