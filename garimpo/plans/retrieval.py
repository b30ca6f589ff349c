"""Queries of hybrid retrieval, evaluation and feedback, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.operators import filters as P
from garimpo.operators import hybrid as H
from garimpo.operators import ranking as R
from garimpo.plans.registry import registry, rows
from garimpo.runtime import checkpoint, load

QUERIES, ORACLE, query = registry()

# chunks whose rid is divisible by 100 ask with the first eight words of their text and with their vector

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(trim(texto)), '\\s+'), lambda w: length(w) >= 3))"
_Q = "q AS (SELECT rid AS qid, array_to_string(regexp_split_to_array(trim(doc), '\\s+')[1:8], ' ') AS texto, col, vec FROM chunks WHERE rid % 100 = 0 AND doc IS NOT NULL)"
_LEX = lambda ok, n: f"""{_Q}, w AS (SELECT qid, unnest({_WORDS}) AS term FROM q), tt AS (SELECT DISTINCT term FROM w), dd AS (SELECT rid AS doc, lower(doc) AS t, greatest(length(doc) - 2, 0) AS l, {ok} AS ok FROM chunks WHERE doc IS NOT NULL), st AS (SELECT count(*) AS n, avg(l) AS a FROM dd),
tf AS (SELECT term, doc, l, ok, (length(t) - length(replace(t, term, ''))) / length(term) AS tf FROM dd JOIN tt ON contains(t, term)), df AS (SELECT term, greatest(ln(((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf GROUP BY term),
ls AS (SELECT qid, doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (SELECT a FROM st)))), 6) AS score FROM w JOIN tf USING (term) JOIN df USING (term) WHERE ok GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS posicao FROM ls) WHERE posicao <= {n})"""  # noqa: E731
_GOOD = "vec IS NOT NULL AND len(vec) = (SELECT len(vec) FROM chunks WHERE len(vec) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND NOT isnan(x)))"
_VET = lambda ok, n: f"""v AS (SELECT rid, vec::DOUBLE[] AS v, {ok} AS ok FROM chunks WHERE {_GOOD}),
vs AS (SELECT a.rid AS qid, b.rid AS doc, round(coalesce(CASE WHEN isnan(list_cosine_similarity(a.v, b.v)) THEN 0 ELSE list_cosine_similarity(a.v, b.v) END, 0), 6) AS cos FROM v a JOIN v b ON a.rid <> b.rid AND b.ok WHERE a.rid IN (SELECT qid FROM q)),
vet AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, doc) AS posicao FROM vs) WHERE posicao <= {n})"""  # noqa: E731
_RRF = """l AS (SELECT qid, 'a' AS lista, doc, posicao FROM vet UNION ALL SELECT qid, 'b', doc, posicao FROM lex), fs AS (SELECT qid, doc, round(sum(1.0::DOUBLE / (60 + posicao)), 9) AS score, min(struct_pack(lista := lista, posicao := posicao)) AS seen FROM l GROUP BY ALL),
f AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc) AS posicao FROM fs)"""
_EXT = "coalesce(json_type(meta, '$.is_external') = 'VARCHAR' AND json_extract_string(meta, '$.is_external') = 'true', false)"


def _asks(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunks").where("rid % 100 = 0 AND doc IS NOT NULL")
    words = F.slice(F.split(F.trim("doc"), r"\s+"), 1, 8)
    return checkpoint(c.select(F.col("rid").alias("qid"), F.array_join(words, " ").alias("texto"), "col", "vec"))


def _external() -> Column:
    return P.where_json(P.scope("external"), F.col("meta"))


@query(f"WITH {_LEX('true', 10)} SELECT qid, doc, score, CAST(posicao AS INT) AS posicao FROM lex")
def k02_substring_bm25(spark: SparkSession, d: str) -> DataFrame:
    return H.substring_bm25(_asks(spark, d), load(spark, d, "chunks"), "rid", "doc", 10)


@query(f"WITH {_LEX(_EXT, 10)} SELECT qid, doc, score, CAST(posicao AS INT) AS posicao FROM lex")
def k02_substring_bm25_external(spark: SparkSession, d: str) -> DataFrame:
    """The same among external chunks only; statistics stay those of all chunks."""
    return H.substring_bm25(_asks(spark, d), load(spark, d, "chunks"), "rid", "doc", 10, _external())


@query(f"WITH {_LEX('true', 30)}, {_VET('true', 30)}, {_RRF} SELECT qid, doc, score, CAST(posicao AS INT) AS posicao FROM f WHERE posicao <= 10")
def r02_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Thirty by vector and thirty by text, fused to ten."""
    return H.hybrid(_asks(spark, d), load(spark, d, "chunks"), "rid", "doc", "vec")


@query(f"WITH {_LEX(_EXT, 30)}, {_VET(_EXT, 30)}, {_RRF} SELECT qid, doc, score, CAST(posicao AS INT) AS posicao FROM f WHERE posicao <= 10")
def r02_faceted_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The same with the filter inside both searches."""
    return H.hybrid(_asks(spark, d), load(spark, d, "chunks"), "rid", "doc", "vec", allowed=_external())


_TERMS = "list_distinct(flatten(list_transform(list_distinct(list_filter(list_transform(regexp_extract_all(texto, '([\\p{L}\\p{N}_][\\p{L}\\p{N}_.\\-]*)', 1), lambda t: lower(trim(t, '.-'))), lambda t: length(t) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "], t)))[1:24], lambda t: regexp_extract_all(strip_accents(t), '([\\p{L}\\p{N}]+)', 1))))"


@query(f"""WITH {_LEX('true', 30)}, {_VET('true', 30)}, {_RRF}, qt AS (SELECT qid, {_TERMS} AS ts FROM q), x AS (SELECT doc, strip_accents(t) AS t FROM dd),
h AS (SELECT f.qid, f.doc, f.posicao, CASE WHEN f.posicao <= 20 THEN round(CASE WHEN len(ts) > 0 THEN len(list_filter(ts, lambda z: contains(coalesce(x.t, ''), z)))::DOUBLE / len(ts) ELSE 0 END, 9) END AS r FROM f JOIN qt ON qt.qid = f.qid LEFT JOIN x ON x.doc = f.doc),
d1 AS (SELECT qid, max(score) FILTER (posicao = 1) AS s1, max(score) FILTER (posicao = 2) AS s2, max(doc) FILTER (posicao = 1) AS fixo FROM lex GROUP BY qid)
SELECT qid, doc, CAST(n AS INT) AS posicao FROM (SELECT h.qid, h.doc, row_number() OVER (PARTITION BY h.qid ORDER BY coalesce(h.doc = fixo AND (s2 IS NULL OR (s2 > 0 AND s1 / s2 >= 1.5)), false) DESC, r IS NULL, r DESC, posicao) AS n FROM h LEFT JOIN d1 ON d1.qid = h.qid) WHERE n <= 10""")
def r03_combined(spark: SparkSession, d: str) -> DataFrame:
    """The fusion reordered by the share of the question's terms, a dominant lexical hit on top."""
    asks, c = _asks(spark, d), load(spark, d, "chunks")
    vet = checkpoint(H.vector_lists(asks, c, "rid", "vec", 30))
    lex = checkpoint(H.substring_bm25(asks, c, "rid", "doc", 30))
    return H.combined(vet, lex, c.select(F.col("rid").alias("doc"), F.col("doc").alias("texto")), asks)


@query(rows("escopo grafo cliente reordenador plano", ("all", None, None, True, "hibrida"), ("notes", None, None, True, "hibrida"), ("generated", None, None, True, "densa"), ("all", "g", None, True, "densa"), ("all", None, "c", True, "densa"), ("external", None, None, False, "densa")))
def r05_search_plans(spark: SparkSession, d: str) -> DataFrame:
    cases = [("all", None, None, True), ("notes", None, None, True), ("generated", None, None, True), ("all", "g", None, True), ("all", None, "c", True), ("external", None, None, False)]
    return spark.createDataFrame([(*c, H.search_plan(*c)) for c in cases], "escopo string, grafo string, cliente string, reordenador boolean, plano string")


@query(f"""WITH {_Q}, {_VET('true', 60)}, m AS (SELECT qid, regexp_replace(id, '::chunk_[0-9]+$', '') AS documento, vet.doc AS doc, round(cos * CASE WHEN {_EXT} THEN 0.9 ELSE 1.0 END, 3) AS sim FROM vet JOIN chunks c ON c.rid = vet.doc),
b AS (SELECT qid, documento, min(struct_pack(s := -sim, doc := doc)) AS b FROM m WHERE sim >= 0.3 GROUP BY ALL) SELECT qid, documento, doc, sim, CAST(n AS INT) AS posicao FROM (SELECT qid, documento, b.doc AS doc, -b.s AS sim, row_number() OVER (PARTITION BY qid ORDER BY -b.s DESC, b.doc) AS n FROM b) WHERE n <= 15""")
def k05_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Sixty chunks asked for so that fifteen documents remain; external ones weigh less, below 0.3 nothing counts."""
    c = load(spark, d, "chunks")
    v = H.vector_lists(_asks(spark, d), c, "rid", "vec", H.candidates_wanted(15))
    docs = c.select(F.col("rid").alias("doc"), F.regexp_replace("id", "::chunk_[0-9]+$", "").alias("documento"), F.when(_external(), 0.9).otherwise(1.0).alias("w"))
    return H.collapsed(v, docs, "cos", 15, 0.3, F.col("w"))


@query(rows("n chunks documentos", (1, 20, 20), (5, 20, 20), (15, 60, 60), (20, 60, 80), (100, 100, 400), (400, 400, 700)))
def k06_candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks, and how many documents for reranking by authority, are asked for."""
    return spark.createDataFrame([(n, H.candidates_wanted(n), H.authority_candidates(n)) for n in (1, 5, 15, 20, 100, 400)], "n int, chunks int, documentos int")


@query(f"WITH {_LEX('true', 10)}, {_VET('true', 10)}, j AS (SELECT coalesce(a.qid, b.qid) AS qid, a.posicao AS pa, b.posicao AS pb FROM vet a FULL JOIN lex b ON a.qid = b.qid AND a.doc = b.doc) SELECT qid, count(*) FILTER (pb IS NULL) AS so_a, count(*) FILTER (pa IS NULL) AS so_b, count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) AS comuns, count(*) FILTER (pa = pb) AS mesma_posicao FROM j GROUP BY qid")
def j16_index_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The vector list against the lexical list of the same questions."""
    asks, c = _asks(spark, d), load(spark, d, "chunks")
    return H.index_overlap(H.vector_lists(asks, c, "rid", "vec", 10), H.substring_bm25(asks, c, "rid", "doc", 10), 10)


_SENT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(doc, ''), '(?s)\\A---.*?---', ''), '\\[\\[[^\\]]*\\]\\]', ' ', 'g'), '`[^`]*`', ' ', 'g'), E'\\n'), lambda x: trim(regexp_replace(trim(x, E' \\t\\r\\f'), '^[#\\-*| ]+', ''), E' \\t\\r\\f')), lambda x: length(x) BETWEEN 60 AND 240 AND NOT starts_with(x, 'http') AND NOT starts_with(x, '```'))"


@query(f"SELECT rid, len({_SENT}) AS frases, md5(array_to_string({_SENT}, '|')) AS marca FROM chunks")
def t48_sentences(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each chunk can stand for a question, and their mark."""
    s = H.usable_sentences(F.col("doc"))
    return load(spark, d, "chunks").select("rid", F.size(s).cast("long").alias("frases"), F.md5(F.array_join(s, "|")).alias("marca"))


@query()
def r14_self_recall(spark: SparkSession, d: str) -> DataFrame:
    """Fifty chunks asked for by a sentence of their own, found by their text."""
    c = load(spark, d, "chunks")
    q = checkpoint(H.own_questions(c, "rid", "doc", 50))
    return H.self_recall(q, H.substring_bm25(q, c, "rid", "doc", 10))


@query("SELECT * FROM (VALUES (0.9, 0.87, 50, false), (0.9, 0.8, 50, true), (0.9, 0.8, 20, false), (1.0, 0.99, 50, true)) x(antes, agora, n, piorou)".replace("SELECT *", "SELECT antes::DOUBLE AS antes, agora::DOUBLE AS agora, n, piorou"))
def r14_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Two standard errors of 0.9 are 0.085 for 50 questions and 0.134 for 20; those of 1 are none."""
    cases = [(0.9, 0.87, 50), (0.9, 0.8, 50), (0.9, 0.8, 20), (1.0, 0.99, 50)]
    return spark.createDataFrame([(*c, H.regressed(*c)) for c in cases], "antes double, agora double, n int, piorou boolean")


_SESSION = " OR ".join([f"contains(t, '{m}')" for m in H.SESSION_ZH] + [f"contains(p, ' {m} ')" for m in (*H.SESSION_EN, *H.SESSION_PT)])
_SAID = [(-1, "what did we decide last time?"), (-2, "o known now"), (-3, "上次的会话"), (-4, "onde paramos ontem"), (-5, "ONDE PARAMOS ONTEM?"), (-6, "the last timeline"), (-7, None)]


@query(f"WITH a AS (SELECT id, texto FROM consultas UNION ALL {rows('id texto', *_SAID)}), b AS (SELECT id, lower(coalesce(texto, '')) AS t, ' ' || regexp_replace(lower(coalesce(texto, '')), '[^\\p{{L}}0-9]', ' ', 'g') || ' ' AS p FROM a) SELECT id, {_SESSION} AS sessao FROM b")
def r08_session_questions(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "consultas").select("id", "texto").unionByName(spark.createDataFrame(_SAID, "id long, texto string"))
    return a.select("id", H.asks_for_session(F.col("texto")).alias("sessao"))


_TOK = "'([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|\\b\\d{4,}\\b|[a-zA-Z0-9_]+)'"


@query(f"""WITH i AS (SELECT category AS g, id, regexp_extract_all(lower(coalesce(title, '')), {_TOK}, 1) AS ts, ['hook', 'cache', 'trace', 'hook'] AS ctx FROM skills WHERE category IS NOT NULL), m AS (SELECT g, avg(len(ts)) AS a FROM i GROUP BY g),
h AS (SELECT g, id, ts, CASE WHEN a > 0 THEN a WHEN len(ts) > 0 THEN len(ts) ELSE 1 END AS a, unnest(CASE WHEN len(list_intersect(list_distinct(ts), ctx)) > 0 THEN list_intersect(list_distinct(ts), ctx) ELSE [NULL] END) AS t, ctx FROM i JOIN m USING (g)),
s AS (SELECT g, id, coalesce(sum(ln(2) * len(list_filter(ts, lambda x: x = t)) * 2.5 / (len(list_filter(ts, lambda x: x = t)) + 1.5 * (0.25 + 0.75 * len(ts) / a)) * len(list_filter(ctx, lambda x: x = t))) FILTER (t IS NOT NULL), 0) AS raw, count(t) AS n FROM h GROUP BY g, id)
SELECT g, id, round(least(raw / 10, 1), 9) AS score, round(CASE WHEN n >= 2 THEN least(greatest(least(raw / 10, 1), 0.3) + 0.2, 1) WHEN n = 1 THEN greatest(least(raw / 10, 1), 0.3) ELSE least(raw / 10, 1) END, 9) AS reforcado FROM s""")
def r10_item_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Titles of each category against a context of four terms, one of them twice."""
    s = load(spark, d, "skills").where("category IS NOT NULL").select(F.col("category").alias("g"), "id", "title", F.lit("hook cache trace hook").alias("ctx"))
    return H.item_relevance(s, "g", "id", "title", "ctx")


@query(rows("id score:DOUBLE reforcado:DOUBLE", (1, 0.438629436, 0.638629436), (2, 0.0, 0.0), (3, 0.069314718, 0.3)))
def r11_boosts(spark: SparkSession, d: str) -> DataFrame:
    """With two terms, one of them long, with none, and with one of two. A term of an item of mean length counts ln 2 times its count, over ten."""
    i = spark.createDataFrame([(1, "a", "scheduler y", "scheduler y"), (2, "b", "none z", "scheduler x"), (3, "c", "x k", "x")], "id int, g string, t string, c string")
    return H.item_relevance(i, "g", "id", "t", "c").select("id", "score", "reforcado")


_WIN = "x " * 100 + "alfa beta " + "y " * 100 + "ALFA béta gama" + " z" * 200


@query(rows("id janela", (1, _WIN[210:310]), (2, "curto"), (3, "q" * 100)))
def r16_best_windows(spark: SparkSession, d: str) -> DataFrame:
    """The later stretch holds three terms, the earlier two; a short text and a text without terms."""
    t = spark.createDataFrame([(1, _WIN, ["alfa", "beta", "gama", "zz"]), (2, "curto", ["alfa"]), (3, "q" * 500, ["alfa"])], "id int, texto string, termos array<string>")
    return t.select("id", H.best_window(F.col("texto"), F.col("termos"), 100).alias("janela"))


_FACT_ASKS = [(1, ["porta", "balanca", "13"]), (2, ["modelo", "fila"]), (3, ["host"]), (4, ["timeout", "workers", "scheduler", "gateway"])]


@query(f"""WITH k AS (SELECT DISTINCT ks, ka FROM fatos WHERE ks IS NOT NULL AND ka IS NOT NULL), a AS (SELECT qid, unnest(termos) AS t FROM ({rows("qid termos", *_FACT_ASKS)})),
s AS (SELECT DISTINCT ks, unnest(regexp_extract_all(ks, '([a-z0-9]+)', 1)) AS p FROM k), b AS (SELECT DISTINCT ka, unnest(regexp_extract_all(regexp_replace(ka, '^setting:', ''), '([a-z0-9]+)', 1)) AS p FROM k),
ts AS (SELECT qid, ks, list(DISTINCT t) AS ts FROM a JOIN s ON p = t OR (length(t) >= 4 AND length(p) >= 4 AND t[1:4] = p[1:4]) GROUP BY ALL), ta AS (SELECT qid, ka, list(DISTINCT t) AS ta FROM a JOIN b ON p = t OR (length(t) >= 4 AND length(p) >= 4 AND t[1:4] = p[1:4]) GROUP BY ALL),
j AS (SELECT qid, ks, ka, len(ts) + len(list_filter(ta, lambda x: NOT list_contains(ts, x))) AS pontos FROM k JOIN ts USING (ks) JOIN ta USING (qid, ka) WHERE len(list_filter(ta, lambda x: NOT list_contains(ts, x))) > 0)
SELECT qid, ks, ka, CAST(pontos AS INT) AS pontos, CAST(n AS INT) AS posicao FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pontos DESC, ks, ka) AS n FROM j) WHERE n <= 3""")
def r15_facts_by_terms(spark: SparkSession, d: str) -> DataFrame:
    return H.facts_by_terms(load(spark, d, "fatos"), spark.createDataFrame(_FACT_ASKS, "qid int, termos array<string>"))


# feedback: a returned path was useful if it was opened from that query

_VOTES = "o AS (SELECT DISTINCT consulta, caminho FROM aberturas WHERE consulta IS NOT NULL AND caminho IS NOT NULL), v AS (SELECT d.consulta AS qid, d.caminho, o.caminho IS NOT NULL AS util FROM devolvidas d LEFT JOIN o ON o.consulta = d.consulta AND o.caminho = d.caminho WHERE d.consulta IS NOT NULL AND d.caminho IS NOT NULL)"


def votes_of(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "aberturas").where("consulta IS NOT NULL AND caminho IS NOT NULL").select("consulta", "caminho").distinct().withColumn("o", F.lit(True))
    v = load(spark, d, "devolvidas").where("consulta IS NOT NULL AND caminho IS NOT NULL").join(o, ["consulta", "caminho"], "left")
    return v.select(F.col("consulta").alias("qid"), "caminho", F.coalesce("o", F.lit(False)).alias("util"))


@query(f"WITH {_VOTES}, g AS (SELECT caminho, count(*) FILTER (util) AS uteis, count(*) FILTER (NOT util) AS nao FROM v GROUP BY caminho) SELECT caminho, uteis, nao, uteis - nao AS saldo, CASE WHEN uteis < nao THEN row_number() OVER (PARTITION BY uteis < nao ORDER BY uteis - nao, caminho) END AS pior FROM g")
def a15_feedback(spark: SparkSession, d: str) -> DataFrame:
    return H.votes_report(votes_of(spark, d))


@query(f"WITH {_VOTES} SELECT qid FROM v GROUP BY qid HAVING count(*) FILTER (util) = 0")
def a15_unhelped(spark: SparkSession, d: str) -> DataFrame:
    return H.unhelped(votes_of(spark, d))


@query(f"WITH {_VOTES} SELECT qid, caminho AS doc, CASE WHEN count(*) > 1 THEN 3 ELSE 2 END AS grau FROM v WHERE util GROUP BY ALL")
def a16_graded_set(spark: SparkSession, d: str) -> DataFrame:
    return H.graded(votes_of(spark, d))


_RECORDS = [(1, "acme", "ana", False), (2, "acme", "bia", False), (3, "acme", "bia", True), (4, "acme", None, False), (5, "other", "ana", True), (6, None, "ana", True)]


@query(rows("id visivel", (1, True), (2, False), (3, True), (4, True), (5, False), (6, False)))
def f18_visible(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame(_RECORDS, "id int, empresa string, agente string, comum boolean")
    return r.select("id", H.visible(F.lit("acme"), F.lit("ana"), F.col("empresa"), F.col("agente"), F.col("comum")).alias("visivel"))
