"""Search queries: documents are the units; those whose id is divisible by 50 ask for their title (the first line), and, where they have a vector, for its neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evigraph.functions import text as T
from evigraph.functions import vector as V
from evigraph.functions.scratch import Scratch
from evigraph.operators import clauses, curate, evals, search
from evigraph.operators.index import TextIndex, kept_index
from evigraph.plans.registry import Tables, query


def units(t: Tables):
    first = F.element_at(F.split("text", "\n", -1), 1)
    return t.documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("unit_id"), "doc_id", first.alias("title"), F.array("source").alias("aliases"), F.col("text").alias("body"), "lang", "source")


def asked(t: Tables):
    return t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.element_at(F.split("text", "\n", -1), 1).alias("query"))


def word_channel(t, where=None):
    return search.rank_candidates(kept_index(t.documents, units(t), "word", T.words).search(asked(t), where))


def trigram_channel(t, where=None):
    return search.rank_candidates(kept_index(t.documents, units(t), "trigram", T.trigrams).search(asked(t), where))


def with_vector(t):
    return asked(t).join(t.embeddings.select(F.col("vec_id").alias("qid")), "qid", "left_semi").select("qid")


def vector_channel(t, where=None):
    e = t.embeddings
    ids = units(t).where(where if where is not None else F.lit(True)).select(F.col("doc_id").alias("vec_id"))
    q = asked(t).join(e, F.col("qid") == F.col("vec_id")).select("qid", F.col("embedding").alias("qv"))
    near = V.knn(e.join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 100)
    return near.select("qid", F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("unit_id"), "score", "rank")


def fused(t, where=None, names=("word", "trigram", "vector")):
    """The fused channels, as a table; questions without a vector do without that channel."""
    hits = search.fuse(channels(t, where, names), able={"vector": with_vector(t)} if "vector" in names else None)
    return Scratch(t.spark, "fused").table(hits, "hits")


def channels(t, where=None, names=("word", "trigram", "vector")):
    make = {"word": word_channel, "trigram": trigram_channel, "vector": vector_channel}
    return {n: make[n](t, where) for n in names}


_WORDS = r"regexp_extract_all(lower(strip_accents({x})), '[\p{{L}}\p{{N}}]+')"
_TRI = "list_transform([string_split(lower({x}), '')], lambda ch: list_transform(range(1, len(ch) - 1), lambda i: ch[i] || ch[i + 1] || ch[i + 2]))[1]"


def _bm25(p: str, tokens: str, where: str = "true") -> str:
    return f"""
{p}t AS MATERIALIZED (SELECT unit_id, {where} AS hit, {tokens.format(x='body')} AS ts FROM u),
{p}s AS (SELECT avg(len(ts)) AS mean, count(*) AS units FROM {p}t),
{p}q AS MATERIALIZED (SELECT DISTINCT qid, unnest({tokens.format(x='query')}) AS term FROM q),
{p}f AS MATERIALIZED (SELECT unit_id, hit, n, term, count(*) AS f FROM (SELECT unit_id, hit, len(ts) AS n, unnest(ts) AS term FROM {p}t) WHERE term IN (SELECT term FROM {p}q) GROUP BY ALL),
{p}d AS (SELECT term, count(*) AS d FROM {p}f GROUP BY term),
{p}x AS (SELECT qid, unit_id, round(sum(greatest(ln((units - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM {p}f JOIN {p}d USING (term) CROSS JOIN {p}s JOIN {p}q USING (term) WHERE hit GROUP BY qid, unit_id),
{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM {p}x) WHERE rank <= 100)"""


_BASE = """WITH u AS (SELECT 'doc:' || doc_id AS unit_id, doc_id, string_split(text, chr(10))[1] AS title, text AS body, lang, source FROM documents),
q AS (SELECT d.doc_id AS qid, string_split(d.text, chr(10))[1] AS query FROM documents AS d WHERE doc_id % 50 = 0)"""


def _cos(a, b):
    dot = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i]::DOUBLE * {y}[i]::DOUBLE))"
    return f"{dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)})"


def _vector(where: str = "true") -> str:
    return f"""
vx AS (SELECT q.qid, b.vec_id AS id, round({_cos('a.embedding', 'b.embedding')}, 6) AS score FROM q JOIN embeddings AS a ON a.vec_id = q.qid JOIN embeddings AS b ON b.vec_id <> a.vec_id JOIN u ON u.doc_id = b.vec_id WHERE {where}),
v AS (SELECT qid, 'doc:' || id AS unit_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vx) WHERE rank <= 100)"""


def _fused(vector: bool = True, where: str = "true") -> str:
    parts = [("w", "word", 1.0), ("t", "trigram", 0.8)] + [("v", "vector", 1.0)] * vector
    bound = "1.0::DOUBLE / 61 + 0.8::DOUBLE / 61" + (" + CASE WHEN qid IN (SELECT vec_id FROM embeddings) THEN 1.0::DOUBLE / 61 ELSE 0 END" if vector else "")
    union = " UNION ALL ".join(f"SELECT qid, unit_id, '{n}' AS channel, rank, {w}::DOUBLE AS weight FROM {p}" for p, n, w in parts)
    return _BASE + "," + _bm25("w", _WORDS, where) + "," + _bm25("t", _TRI, where) + ("," + _vector(where) if vector else "") + f""",
c AS ({union}),
r AS (SELECT qid, unit_id, sum(weight / (60 + rank)) AS raw0, {bound} AS bound, max(rank) FILTER (WHERE channel = 'word') AS word, max(rank) FILTER (WHERE channel = 'trigram') AS trigram, max(rank) FILTER (WHERE channel = 'vector') AS vector FROM c GROUP BY qid, unit_id),
n AS (SELECT *, round(raw0, 6) AS raw, round(raw0 / bound, 6) AS normalized FROM r)"""


_NORM = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
_FINAL = (
    _fused()
    + f""",
b0 AS (SELECT n.*, u.title, q.query, {_NORM.format(x='u.title')} AS nt, {_NORM.format(x='q.query')} AS nq, {_NORM.format(x='u.source')} AS na FROM n JOIN u USING (unit_id) JOIN q USING (qid)),
b AS (SELECT *, least(CASE WHEN nt = nq THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN na = nq THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN starts_with(nt, nq) THEN 0.02::DOUBLE ELSE 0 END, 0.08::DOUBLE) AS boost FROM b0),
f AS (SELECT qid, unit_id, normalized, boost, round(normalized + boost, 6) AS final FROM b)"""
)


@query("search_units_build", _BASE + " SELECT unit_id, title, source, lang, sha256(body) AS content_sha256 FROM u")
def _(t):
    return units(t).select("unit_id", "title", "source", "lang", F.sha2("body", 256).alias("content_sha256"))


@query("search_word_tokens", _BASE + f", x AS (SELECT unnest({_WORDS.format(x='body')}) AS term FROM u) SELECT term, count(*) AS n FROM x GROUP BY term")
def _(t):
    return units(t).select(F.explode(T.words(F.col("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("search_trigram_tokens", _BASE + f", x AS (SELECT unnest({_TRI.format(x='body')}) AS term FROM u) SELECT term, count(*) AS n FROM x GROUP BY term")
def _(t):
    return units(t).select(F.explode(T.trigrams(F.col("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("search_bm25_word", _BASE + "," + _bm25("w", _WORDS) + " SELECT qid, unit_id, score, rank FROM w")
def _(t):
    return word_channel(t).select("qid", "unit_id", "score", "rank")


_CHANGED = """WITH u AS (SELECT 'doc:' || doc_id AS unit_id, doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 10 = 1 THEN string_split(text, chr(10))[1] || ' ' || lang ELSE text END AS body, lang, source FROM documents WHERE doc_id % 10 <> 2),
q AS (SELECT d.doc_id AS qid, string_split(d.text, chr(10))[1] AS query FROM documents AS d WHERE doc_id % 50 = 0)"""


@query("search_index_update", _CHANGED + "," + _bm25("w", _WORDS) + " SELECT qid, unit_id, score, rank FROM w")
def _(t):
    """An index of nine tenths of the documents after one tenth was changed, one was deleted and one came new, without reading the others again."""
    u = units(t)
    index = TextIndex(t.spark, Scratch(t.spark, "index-update").root, T.words).update(u.where("doc_id % 10 <> 3"))
    shorter = u.withColumn("body", F.when(F.col("doc_id") % 10 == 1, F.concat("title", F.lit(" "), "lang")).otherwise(F.col("body")))
    index = index.update(shorter.where("doc_id % 10 IN (1, 3)"), gone=u.where("doc_id % 10 = 2"))
    return search.rank_candidates(index.search(asked(t))).select("qid", "unit_id", "score", "rank")


@query("search_bm25_trigram", _BASE + "," + _bm25("t", _TRI) + " SELECT qid, unit_id, score, rank FROM t")
def _(t):
    return trigram_channel(t).select("qid", "unit_id", "score", "rank")


@query("search_short_query", "WITH n AS (SELECT 'part:' || p_partkey AS unit_id, lower(p_name) AS t FROM part UNION ALL SELECT 'word:' || p_partkey, substr(lower(p_name), 3, 2) FROM part WHERE p_partkey % 7 = 0), x AS (SELECT p_partkey AS qid, substr(lower(p_name), 3, CASE WHEN p_partkey % 100 = 0 THEN 1 ELSE 2 END) AS q FROM part WHERE p_partkey % 50 = 0) SELECT qid, unit_id, t = q AS exact FROM n JOIN x ON contains(t, q) WHERE length(q) BETWEEN 1 AND 2")
def _(t):
    unit = lambda kind, title: t.part.select(F.concat(F.lit(kind), F.col("p_partkey").cast("string")).alias("unit_id"), title.alias("title"), "p_partkey")
    titles = unit("part:", F.col("p_name")).unionByName(unit("word:", F.substring("p_name", 3, 2)).where("p_partkey % 7 = 0"))
    asking = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.expr("substr(upper(p_name), 3, CASE WHEN p_partkey % 100 = 0 THEN 1 ELSE 2 END)").alias("query"))
    return search.short_match(titles, asking)


@query("search_prefix_terms", _BASE + f", x AS (SELECT DISTINCT unnest({_WORDS.format(x='body')}) AS term FROM u) SELECT n, substr(term, 1, CAST(n AS INTEGER)) AS prefix, count(*) AS terms FROM x, (VALUES (2), (3), (4)) AS p(n) WHERE length(term) >= n GROUP BY ALL")
def _(t):
    terms = units(t).select(F.explode(T.words(F.col("body"))).alias("term")).distinct()
    sizes = terms.select("term", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("n")).where(F.length("term") >= F.col("n"))
    return sizes.groupBy("n", F.substring(F.col("term"), F.lit(1), F.col("n")).alias("prefix")).agg(F.count("*").alias("terms"))


# Documents whose id is divisible by 50 ask with the first six words of their title: one that must be there, a phrase and two more of which one must, one that must not, and a prefix.
_CLAUSES = _BASE + rf""",
uw AS MATERIALIZED (SELECT unit_id, {_WORDS.format(x='body')} AS ts FROM u),
qw AS (SELECT qid, {_WORDS.format(x='query')} AS w FROM q),
qc AS (SELECT qid, w[1] AS must, w[2:3] AS phrase, w[4:5] AS choice, w[6:6] AS banned, substr(w[1], 1, 3) AS pre FROM qw WHERE len(w) > 0 AND length(w[1]) BETWEEN 2 AND 900 AND length(array_to_string(w[1:6], ' ')) <= 900),
h AS (SELECT qid, unit_id, len(list_filter(ts, lambda x: x = must)) AS n1, len(list_filter(ts, lambda x: starts_with(x, pre))) AS n2, len(phrase) AS np, len(choice) AS ns,
  CASE len(phrase) WHEN 0 THEN 0 WHEN 1 THEN len(list_filter(ts, lambda x: x = phrase[1])) ELSE len(list_filter(range(1, len(ts)), lambda i: ts[i] = phrase[1] AND ts[i + 1] = phrase[2])) END AS n3,
  coalesce(list_sum(list_transform(choice, lambda s: len(list_filter(ts, lambda x: x = s)))), 0) AS n4, len(banned) > 0 AND list_has_any(ts, banned) AS bad FROM uw CROSS JOIN qc WHERE list_contains(ts, must))
SELECT qid, unit_id, CAST(n1 + n2 + n3 + n4 AS BIGINT) AS hits FROM h WHERE n2 > 0 AND (np + ns = 0 OR n3 + n4 > 0) AND NOT bad"""


@query("search_clauses", _CLAUSES)
def _(t):
    w = F.col("w")
    asking = asked(t).select("qid", T.words(F.col("query")).alias("w")).where(F.size("w") > 0)
    q = asking.where(F.length(w[0]).between(2, 900) & (F.length(F.array_join(F.slice("w", 1, 6), " ")) <= 900)).select(
        "qid", F.array(w[0]).alias("every"), F.concat(F.array(F.array_join(F.slice("w", 2, 2), " ")), F.slice("w", 4, 2)).alias("some"), F.slice("w", 6, 1).alias("none"), F.array(F.substring(w[0], 1, 3)).alias("prefixes")
    )
    return clauses.match(units(t), q)


@query("search_snippet", "SELECT doc_id, substr(text, greatest(strpos(lower(text), 'licensed') - 40, 1), 88) AS snippet FROM documents WHERE contains(lower(text), 'licensed')")
def _(t):
    return t.documents.where(F.contains(F.lower("text"), F.lit("licensed"))).select("doc_id", search.snippet(F.col("text"), F.lit("licensed")).alias("snippet"))


@query("search_highlight", "SELECT doc_id, len(regexp_extract_all(text, '(?i)licensed')) AS n, sha256(regexp_replace(text, '(?i)(licensed)', '<b>\\1</b>', 'g')) AS highlighted_sha256 FROM documents WHERE contains(lower(text), 'licensed')")
def _(t):
    return t.documents.where(F.contains(F.lower("text"), F.lit("licensed"))).select("doc_id", F.regexp_count("text", F.lit("(?i)licensed")).cast("long").alias("n"), F.sha2(F.regexp_replace("text", "(?i)(licensed)", "<b>$1</b>"), 256).alias("highlighted_sha256"))


_Q50 = f"SELECT q.vec_id AS qid, b.vec_id AS id, round({{f}}, 6) AS score FROM embeddings AS q JOIN embeddings AS b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0"
_L2 = "sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: pow(q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))))"


def _vectors(t, metric):
    e = t.embeddings
    return V.knn(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), 10, metric)


@query("vector_cosine_topk", f"WITH x AS ({_Q50.format(f=_cos('q.embedding', 'b.embedding'))}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x) SELECT * FROM r WHERE rank <= 10")
def _(t):
    return _vectors(t, "cosine")


@query("vector_l2_topk", f"WITH x AS ({_Q50.format(f=_L2)}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM x) SELECT * FROM r WHERE rank <= 10")
def _(t):
    return _vectors(t, "l2")


@query("vector_validate", "SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimensions' WHEN list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x))) THEN 'not_finite' WHEN NOT list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN 'zero' END AS problem FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", V.validity(F.col("embedding"), 64).alias("problem"))


@query("vector_pair_check", f"WITH c AS (SELECT label, min(vec_id) AS a, max(vec_id) AS b FROM embeddings GROUP BY label), d AS (SELECT c.label, round({_cos('x.embedding', 'y.embedding')}, 6) AS related, round({_cos('x.embedding', 'z.embedding')}, 6) AS unrelated FROM c JOIN embeddings x ON x.vec_id = c.a JOIN embeddings y ON y.vec_id = c.b JOIN (SELECT (label + 1) % 10 AS label, a FROM c) AS o ON o.label = c.label JOIN embeddings z ON z.vec_id = o.a) SELECT label, related, unrelated, related > unrelated AS ok FROM d")
def _(t):
    e = t.embeddings
    c = e.groupBy("label").agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b"))
    o = c.select(((F.col("label") + 1) % 10).alias("label"), F.col("a").alias("o"))
    side = lambda k, v: e.select(F.col("vec_id").alias(k), F.col("embedding").alias(v))
    j = c.join(o, "label").join(side("a", "x"), "a").join(side("b", "y"), "b").join(side("o", "z"), "o")
    d = j.select("label", F.round(V.cosine("x", "y"), 6).alias("related"), F.round(V.cosine("x", "z"), 6).alias("unrelated"))
    return d.withColumn("ok", F.col("related") > F.col("unrelated"))


@query("vector_reuse_by_hash", "WITH c AS (SELECT doc_id, sha256(text) AS h FROM documents), e AS (SELECT h, min(vec_id) AS vec_id FROM c JOIN embeddings ON vec_id = doc_id GROUP BY h) SELECT doc_id, e.vec_id, CASE WHEN e.vec_id IS NULL THEN 'embed' ELSE 'reuse' END AS outcome FROM c LEFT JOIN e USING (h)")
def _(t):
    c = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    e = c.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).groupBy("h").agg(F.min("vec_id").alias("vec_id"))
    return c.join(e, "h", "left").select("doc_id", "vec_id", F.when(F.col("vec_id").isNull(), "embed").otherwise("reuse").alias("outcome"))


@query("rrf_raw", _fused() + " SELECT qid, unit_id, raw FROM n")
def _(t):
    return fused(t).select("qid", "unit_id", "raw")


@query("rrf_normalized", _fused() + " SELECT qid, unit_id, normalized FROM n")
def _(t):
    return fused(t).select("qid", "unit_id", "normalized")


@query("rrf_degraded_no_vector", _fused(vector=False) + " SELECT qid, unit_id, raw, normalized FROM n")
def _(t):
    return fused(t, names=("word", "trigram")).select("qid", "unit_id", "raw", "normalized")


@query("rrf_explain", _fused() + " SELECT qid, unit_id, word, trigram, vector, raw, round(bound, 6) AS bound, normalized FROM n")
def _(t):
    rank = lambda c: F.element_at("ranks", F.lit(c)).alias(c)
    return fused(t).select("qid", "unit_id", rank("word"), rank("trigram"), rank("vector"), "raw", F.round("bound", 6).alias("bound"), "normalized")


def boosted(t):
    return Scratch(t.spark, "boosted").table(search.with_boosts(fused(t), units(t), asked(t)), "hits")


@query("rrf_boosted", _FINAL + " SELECT qid, unit_id, normalized, boost, final FROM f")
def _(t):
    return boosted(t).select("qid", "unit_id", "normalized", "boost", "final")


_TIER = _FINAL + """, wanted AS (SELECT qid, 'doc:' || (qid + 1) AS unit_id FROM q), a AS (SELECT wanted.* FROM wanted JOIN u USING (unit_id) WHERE u.lang <> 'fr'),
z AS (SELECT coalesce(f.qid, a.qid) AS qid, coalesce(f.unit_id, a.unit_id) AS unit_id, CASE WHEN a.qid IS NULL THEN 0 ELSE 1 END AS tier, coalesce(normalized, 0) AS normalized, coalesce(final, 0) AS final FROM f FULL JOIN a ON a.qid = f.qid AND a.unit_id = f.unit_id)"""


@query("rrf_exact_id_tier", _TIER + " SELECT qid, unit_id, tier, final, row_number() OVER (PARTITION BY qid ORDER BY tier DESC, final DESC, unit_id) AS position FROM z")
def _(t):
    wanted = asked(t).select("qid", F.concat(F.lit("doc:"), (F.col("qid") + 1).cast("string")).alias("unit_id"))
    return search.final_order(search.with_exact_ids(boosted(t), units(t), wanted, F.col("lang") != "fr")).select("qid", "unit_id", "tier", "final", "position")


@query("search_filtered", _fused(where="lang = 'de'") + " SELECT qid, unit_id, normalized FROM n")
def _(t):
    return fused(t, F.col("lang") == "de").select("qid", "unit_id", "normalized")


@query("search_final", _FINAL + ", o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, unit_id) AS position FROM f) SELECT qid, unit_id, final, position FROM o WHERE position <= 20")
def hybrid(t):
    ranked = boosted(t).withColumn("tier", F.lit(0))
    return search.final_order(ranked).where("position <= 20").select("qid", "unit_id", "final", "position")


@query("search_grouped", _FINAL + ", o AS (SELECT f.*, u.lang FROM f JOIN u USING (unit_id)), g AS (SELECT *, row_number() OVER (PARTITION BY qid, lang ORDER BY final DESC, unit_id) AS i FROM o) SELECT qid, lang, string_agg(unit_id, ',' ORDER BY i) AS members, count(*) AS n FROM g WHERE i <= 5 GROUP BY qid, lang")
def _(t):
    ranked = boosted(t).join(units(t).select("unit_id", "lang"), "unit_id")
    top = ranked.withColumn("i", F.row_number().over(W.partitionBy("qid", "lang").orderBy(F.desc("final"), "unit_id"))).where("i <= 5")
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "unit_id"))), lambda x: x["unit_id"]), ",")
    return top.groupBy("qid", "lang").agg(members.alias("members"), F.count("*").alias("n"))


@query("search_keyset_page2", _FINAL + ", o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, unit_id) AS p FROM f) SELECT qid, unit_id, final, p - 20 AS position FROM o WHERE p BETWEEN 21 AND 40")
def _(t):
    ranked = boosted(t).select("qid", "unit_id", "final").withColumn("tier", F.lit(0))
    last = search.final_order(ranked).where("position = 20").select("qid", F.col("final").alias("last_score"), F.col("unit_id").alias("last_id"))
    return search.after_cursor(ranked, last, 20).select("qid", "unit_id", "final", "position")


_IDEAL = "(SELECT sum(1 / log2(1 + i)) FROM range(1, CAST(least(g.n, 10) AS BIGINT) + 1) AS r(i))"


def _metrics(rank: str) -> str:
    return f"""
rel AS (SELECT q.qid, u.unit_id FROM q JOIN documents d ON d.doc_id = q.qid JOIN u ON u.body = d.text),
g AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
h AS (SELECT qid, min(rank) AS first, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, sum(CASE WHEN rank <= 10 THEN 1 / log2(1 + rank) ELSE 0 END) AS dcg FROM {rank} JOIN rel USING (qid, unit_id) GROUP BY qid)
SELECT g.qid, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(h5 / g.n, 0), 6) AS recall_5, round(coalesce(h10 / g.n, 0), 6) AS recall_10, round(coalesce(dcg / {_IDEAL}, 0), 6) AS ndcg_10 FROM g LEFT JOIN h ON h.qid = g.qid"""


def relevant(t):
    same = t.documents.select(F.col("doc_id").alias("qid"), F.sha2("text", 256).alias("h")).join(asked(t).select("qid"), "qid", "left_semi")
    return same.join(units(t).select("unit_id", F.sha2("body", 256).alias("h")), "h").select("qid", "unit_id")


@query("eval_mrr_recall_ndcg", _BASE + "," + _bm25("w", _WORDS) + "," + _metrics("w"))
def _(t):
    return evals.retrieval(word_channel(t), relevant(t))


@query("eval_channel_compare", _fused() + ", o AS (SELECT qid, unit_id, row_number() OVER (PARTITION BY qid ORDER BY normalized DESC, unit_id) AS rank FROM n)," + _metrics("o"))
def _(t):
    w = W.partitionBy("qid").orderBy(F.desc("normalized"), "unit_id")
    return evals.retrieval(fused(t).withColumn("rank", F.row_number().over(w)), relevant(t))


# Mentions are the documents whose id is divisible by 50, nodes all others: by an identifier made of the text's length, by title, by source, language and length, by words, by vectors.
_NODE = "doc_id % 50 <> 0"
_CASCADE = _BASE + "," + _bm25("w", _WORDS, _NODE) + "," + _vector("u." + _NODE) + rf""",
m AS (SELECT doc_id, 'doc:' || doc_id AS node, 'doc:' || length(text) AS given, {_NORM.format(x="string_split(text, chr(10))[1]")} AS name, source || ':' || lang || ':' || length(text) AS alias FROM documents),
a AS (SELECT * FROM m WHERE doc_id % 50 = 0), k AS (SELECT * FROM m WHERE {_NODE}),
c AS (SELECT a.doc_id AS id, k.node, 1.0::DOUBLE AS score, 1 AS p, 'identifier' AS channel FROM a JOIN k ON k.node = a.given
  UNION ALL SELECT a.doc_id, k.node, 0.95::DOUBLE, 2, 'name' FROM a JOIN k USING (name)
  UNION ALL SELECT a.doc_id, k.node, 0.9::DOUBLE, 3, 'alias' FROM a JOIN k USING (alias)
  UNION ALL SELECT qid, unit_id, round(score / max(score) OVER (PARTITION BY qid), 6), 4, 'text' FROM w WHERE score >= 8
  UNION ALL SELECT qid, unit_id, score, 5, 'vector' FROM v WHERE score >= 0.3),
f AS (SELECT * FROM c QUALIFY p = min(p) OVER (PARTITION BY id)),
b AS (SELECT id, node, channel, max(score) AS score FROM f GROUP BY ALL),
o AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS i FROM b WINDOW w AS (PARTITION BY id ORDER BY score DESC, node)),
r AS (SELECT id, channel, node, next IS NOT NULL AND round(score - next, 9) < 0.05 AS close FROM o WHERE i = 1)
SELECT doc_id AS mention_id, CASE WHEN node IS NULL THEN 'new' WHEN close THEN 'ambiguous' ELSE 'existing' END AS decision, CASE WHEN NOT close THEN r.node END AS target, channel FROM (SELECT doc_id FROM a) LEFT JOIN r ON id = doc_id"""


@query("entity_cascade", _CASCADE)
def _(t):
    size = F.length("text").cast("string")
    all_ = t.documents.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), F.concat(F.lit("doc:"), size).alias("given"), F.element_at(F.split("text", "\n", -1), 1).alias("title"), F.concat("source", F.lit(":"), "lang", F.lit(":"), size).alias("alias"))
    all_ = all_.withColumn("name", T.normalize_name(F.col("title")))
    nodes = all_.where(_NODE).select("node_id", "name", "alias")
    equal = lambda on, key, score: lambda left: curate.equal(left.select("mention_id", F.col(on).alias("wanted")), nodes.select("node_id", F.col(key).alias("key")), score)

    def by_text(left):
        found = kept_index(t.documents, units(t), "word", T.words).search(left.select(F.col("mention_id").alias("qid"), F.col("title").alias("query")), F.expr(_NODE))
        ranked = search.rank_candidates(found).where("score >= 8")
        return ranked.select(F.col("qid").alias("mention_id"), F.col("unit_id").alias("node_id"), F.round(F.col("score") / F.max("score").over(W.partitionBy("qid")), 6).alias("score"))

    def by_vector(left):
        base = t.embeddings.join(t.documents.where(_NODE).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        asking = left.join(t.embeddings, F.col("mention_id") == F.col("vec_id")).select(F.col("mention_id").alias("qid"), F.col("embedding").alias("qv"))
        near = V.knn(base.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), asking, 100).where("score >= 0.3")
        return near.select(F.col("qid").alias("mention_id"), F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("node_id"), "score")

    steps = [("identifier", equal("given", "node_id", 1.0)), ("name", equal("name", "name", 0.95)), ("alias", equal("alias", "alias", 0.9)), ("text", by_text), ("vector", by_vector)]
    return curate.cascade(all_.where("doc_id % 50 = 0").select(F.col("doc_id").alias("mention_id"), "given", "title", "name", "alias"), steps)
