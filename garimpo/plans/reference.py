"""Queries of the reference's operator families over the project's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import texts as X
from garimpo.operators import entities as E
from garimpo.operators import filters as P
from garimpo.operators import graph as G
from garimpo.operators import ranking as R
from garimpo.operators import sequences as W
from garimpo.operators import sets as S
from garimpo.operators import usage as U
from garimpo.operators.components import components
from garimpo.operators.resolution import similar_labels
from garimpo.runtime import checkpoint, load

NOW = 1_790_000_000.0
SINCE = 1_760_000_000.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# scans and filters

#: Each operator of the filter language once, with the type traps.
BATTERY = {
    "eq": {"folder": "_external"}, "eq_text_number": {"chunk": "2"}, "eq_number_for_text": {"chunk": 2}, "eq_n": {"n": 3}, "eq_n_text": {"n": "3"},
    "ne": {"kind": {"$ne": "generated"}}, "in": {"folder": {"$in": ["Operacao", "Diario"]}}, "nin": {"client": {"$nin": ["gauge", "anchor"]}},
    "gt": {"n": {"$gt": 2}}, "gte": {"n": {"$gte": 2}}, "lt": {"n": {"$lt": 2.5}}, "lte": {"n": {"$lte": 2}}, "gt_text": {"chunk": {"$gt": 1}}, "bool": {"is_external": True},
    "and": {"$and": [{"is_external": "true"}, {"client": {"$ne": "gauge"}}]}, "or": {"$or": [{"kind": "note"}, {"n": {"$gt": 1}}]},
}
_J = lambda k: f"json_extract_string(meta, '$.{k}')"
_T = lambda k: f"json_type(meta, '$.{k}')"
_N = lambda k: f"CASE WHEN {_T(k)} IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN CAST({_J(k)} AS DOUBLE) END"
_EQ = lambda k, v: f"coalesce({_T(k)} = 'VARCHAR' AND {_J(k)} = '{v}', false)"
_BATTERY_SQL = {
    "eq": _EQ("folder", "_external"), "eq_text_number": _EQ("chunk", "2"), "eq_number_for_text": f"{_N('chunk')} = 2", "eq_n": f"{_N('n')} = 3", "eq_n_text": _EQ("n", "3"),
    "ne": f"NOT {_EQ('kind', 'generated')}", "in": f"{_EQ('folder', 'Operacao')} OR {_EQ('folder', 'Diario')}", "nin": f"NOT {_EQ('client', 'gauge')} AND NOT {_EQ('client', 'anchor')}",
    "gt": f"{_N('n')} > 2", "gte": f"{_N('n')} >= 2", "lt": f"{_N('n')} < 2.5", "lte": f"{_N('n')} <= 2", "gt_text": f"{_N('chunk')} > 1", "bool": f"{_T('is_external')} = 'BOOLEAN' AND {_J('is_external')} = 'true'",
    "and": f"{_EQ('is_external', 'true')} AND NOT {_EQ('client', 'gauge')}", "or": f"{_EQ('kind', 'note')} OR {_N('n')} > 1",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS filtro, count(*) FILTER ({v}) AS linhas FROM chunks" for k, v in _BATTERY_SQL.items()))
def p01_where_battery(spark: SparkSession, d: str) -> DataFrame:
    """Every filter in one scan."""
    c = load(spark, d, "chunks")
    one = c.agg(*[F.count_if(P.where_json(w, F.col("meta"))).alias(k) for k, w in BATTERY.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("filtro"), F.col(k).alias("linhas")) for k in BATTERY])).alias("x")).select("x.*")


@query(f"SELECT rid, id, col FROM chunks WHERE {_BATTERY_SQL['and']} ORDER BY rid LIMIT 100 OFFSET 20")
def s01_get(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunks").where(P.where_json(BATTERY["and"], F.col("meta"))).orderBy("rid").offset(20).limit(100).select("rid", "id", "col")


@query("SELECT col, count(*) AS linhas, count(DISTINCT regexp_replace(id, '::chunk_[0-9]+$', '')) AS documentos, count(*) FILTER (NOT coalesce(regexp_matches(id, '::chunk_[1-9][0-9]*$'), false)) AS inicios FROM chunks GROUP BY col")
def a14_rows_and_documents(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunks")
    return c.groupBy("col").agg(F.count("*").alias("linhas"), F.countDistinct(F.regexp_replace("id", "::chunk_[0-9]+$", "")).alias("documentos"), F.count_if(~F.coalesce(F.col("id").rlike("::chunk_[1-9][0-9]*$"), F.lit(False))).alias("inicios"))


@query("SELECT rid FROM chunks WHERE doc LIKE '%índice%' AND NOT doc LIKE '%cofre%'")
def p06_where_document(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunks").where(P.where_document({"$and": [{"$contains": "índice"}, {"$not_contains": "cofre"}]}, F.col("doc"))).select("rid")


_SCOPES = ["external", "notes", "generated", "notes+external"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS escopo, count(*) FILTER ({q}) AS linhas FROM chunks" for n, q in zip(_SCOPES, [_EQ("is_external", "true"), _EQ("kind", "note"), _EQ("kind", "generated"), f"NOT {_EQ('kind', 'generated')}"])))
def p08_scopes(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunks").agg(*[F.count_if(P.where_json(P.scope(s), F.col("meta"))).alias(s) for s in _SCOPES])
    return c.select(F.explode(F.array(*[F.struct(F.lit(s).alias("escopo"), F.col(f"`{s}`").alias("linhas")) for s in _SCOPES])).alias("x")).select("x.*")


@query("SELECT doc_id, coalesce(nullif(regexp_extract(regexp_extract(caminho, '[^/]*$'), '[0-9]{4}-[0-9]{2}-[0-9]{2}'), ''), strftime(criado_em, '%Y-%m-%d')) AS data FROM documents")
def p12_date_facet(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", P.date_facet(F.col("caminho"), None, F.col("criado_em")).alias("data"))


@query("SELECT doc_id FROM documents WHERE coalesce(length(trim(text, ' ')), 0) < 200")
def s10_without_substance(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(P.without_substance(F.col("text"))).select("doc_id")


_FIND = "CASE WHEN lower(title) = 'hook' THEN 0 WHEN starts_with(lower(title), 'hook') THEN 1 WHEN contains(lower(title), 'hook') THEN 2 WHEN contains(lower(rel_path), 'hook') THEN 3 END"


@query(f"SELECT id, {_FIND} AS posto FROM skills WHERE ({_FIND}) IS NOT NULL ORDER BY posto, length(title), rel_path, id LIMIT 50")
def p16_find_notes(spark: SparkSession, d: str) -> DataFrame:
    t, p = F.lower("title"), F.lower("rel_path")
    rank = F.when(t == "hook", 0).when(t.startswith("hook"), 1).when(t.contains("hook"), 2).when(p.contains("hook"), 3)
    return load(spark, d, "skills").withColumn("posto", rank).where(F.col("posto").isNotNull()).orderBy("posto", F.length("title"), "rel_path", "id").limit(50).select("id", "posto")


# joins


@query("SELECT d.caminho, count(*) AS vezes, count(DISTINCT c.hash) AS consultas, max(c.melhor) AS melhor FROM devolvidas d JOIN consultas c ON d.consulta = c.id GROUP BY 1")
def j01_returned_queries(spark: SparkSession, d: str) -> DataFrame:
    j = load(spark, d, "devolvidas").join(load(spark, d, "consultas").select(F.col("id").alias("consulta"), "hash", "melhor"), "consulta")
    return j.groupBy("caminho").agg(F.count("*").alias("vezes"), F.countDistinct("hash").alias("consultas"), F.max("melhor").alias("melhor"))


@query("""WITH o AS (SELECT em, caminho FROM aberturas WHERE em IS NOT NULL AND caminho IS NOT NULL GROUP BY ALL),
s AS (SELECT d.caminho, c.em, c.id FROM devolvidas d JOIN consultas c ON d.consulta = c.id WHERE c.em IS NOT NULL)
SELECT o.em, o.caminho, (SELECT max(struct_pack(e := s.em, i := s.id)).i FROM s WHERE s.caminho = o.caminho AND s.em <= o.em AND o.em - s.em <= 900) AS consulta_atribuida FROM o""")
def j02_attributed_opens(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "aberturas").where("em IS NOT NULL AND caminho IS NOT NULL").select("em", "caminho").distinct()
    o = o.withColumn("oid", F.concat_ws("|", F.col("em").cast("string"), "caminho"))
    shown = load(spark, d, "devolvidas").join(load(spark, d, "consultas").where("em IS NOT NULL").select(F.col("id").alias("consulta"), "em"), "consulta")
    return U.attribute_opens(o, shown).select("em", "caminho", "consulta_atribuida")


@query("SELECT doc_id, caminho FROM documents WHERE caminho IS NOT NULL AND caminho NOT IN (SELECT caminho FROM devolvidas WHERE caminho IS NOT NULL)")
def j03_never_recalled(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(F.col("caminho").isNotNull()).join(load(spark, d, "devolvidas").select("caminho").distinct(), "caminho", "left_anti").select("doc_id", "caminho")


@query("SELECT nota, ks, ka, valor FROM fatos WHERE (ks, ka) IN (SELECT ks, ka FROM fatos WHERE nota LIKE 'Decisoes/%' AND ks IS NOT NULL AND ka IS NOT NULL)")
def j04_facts_of_notes(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "fatos")
    return f.join(f.where(F.col("nota").startswith("Decisoes/")).select("ks", "ka").distinct(), ["ks", "ka"], "left_semi").select("nota", "ks", "ka", "valor")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`\n]*`', '', 'g'), '\\[\\[([^\\]\n]+)\\]\\]', 1), lambda t: trim(regexp_extract(t, '^([^|#]*)', 1), ' ')), lambda t: t <> ''))) AS alvo FROM documents),
n AS (SELECT DISTINCT regexp_replace(caminho, '\\.md$', '') AS alvo FROM documents WHERE caminho IS NOT NULL)
SELECT w.alvo, count(DISTINCT doc_id) AS citado_por, n.alvo IS NULL AS quebrado FROM w LEFT JOIN n USING (alvo) GROUP BY w.alvo, n.alvo""")
def j07_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    """Targets of wikilinks, how many documents cite them and whether they lead nowhere."""
    docs = load(spark, d, "documents")
    w = docs.select("doc_id", F.explode(F.array_distinct(X.wikilinks(F.col("text")))).alias("alvo"))
    n = docs.where(F.col("caminho").isNotNull()).select(F.regexp_replace("caminho", r"\.md$", "").alias("alvo")).distinct().withColumn("ha", F.lit(True))
    return w.groupBy("alvo").agg(F.countDistinct("doc_id").alias("citado_por")).join(n, "alvo", "left").select("alvo", "citado_por", F.col("ha").isNull().alias("quebrado"))


# aggregates


@query(f"SELECT count(*) AS total_calls, count(*) FILTER (status = 'error') AS total_errors, round(count(*) FILTER (status = 'error') / count(*) * 100, 2) AS error_rate_pct, round(avg(duration_ms) FILTER (NOT isnan(duration_ms)), 2) AS avg_ms, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM spans WHERE started_at >= {SINCE}")
def a01_span_totals(spark: SparkSession, d: str) -> DataFrame:
    return U.span_totals(load(spark, d, "spans"), SINCE)


@query(f"SELECT span_type, count(*) AS calls, round(avg(duration_ms) FILTER (NOT isnan(duration_ms)), 2) AS avg_ms, count(*) FILTER (status = 'error') AS errors FROM spans WHERE started_at >= {SINCE} GROUP BY 1")
def a02_spans_by_type(spark: SparkSession, d: str) -> DataFrame:
    return U.span_breakdown(load(spark, d, "spans"), "span_type", SINCE)


@query(f"SELECT name, count(*) AS calls, round(avg(duration_ms) FILTER (NOT isnan(duration_ms)), 2) AS avg_ms, count(*) FILTER (status = 'error') AS errors FROM spans WHERE started_at >= {SINCE} GROUP BY 1 ORDER BY calls DESC, name LIMIT 10")
def a02_top_spans(spark: SparkSession, d: str) -> DataFrame:
    return U.span_breakdown(load(spark, d, "spans"), "name", SINCE).orderBy(F.desc("calls"), "name").limit(10)


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY ferramenta ORDER BY segundos) - 1 AS i, count(*) OVER (PARTITION BY ferramenta) AS n FROM chamadas WHERE em >= 0 AND segundos IS NOT NULL AND NOT isnan(segundos))
SELECT ferramenta, count(*) AS chamadas, count(*) FILTER (coalesce(erro, '') <> '') AS erros, round(sum(CAST(segundos AS DECIMAL(20, 6))), 1)::DOUBLE AS segundos_total, CAST(sum(chars_saida) AS BIGINT) AS chars_saida, CAST(sum(chars_apontados) AS BIGINT) AS chars_apontados,
round(CAST((max(segundos) FILTER (i = (n - 1) // 2) + max(segundos) FILTER (i = n // 2)) / 2 AS DECIMAL(20, 6)), 3)::DOUBLE AS p50, round(CAST(max(segundos) FILTER (i = least(n - 1, CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT))) AS DECIMAL(20, 6)), 3)::DOUBLE AS p95 FROM c GROUP BY ferramenta""")
def a03_ledger(spark: SparkSession, d: str) -> DataFrame:
    return U.ledger(load(spark, d, "chamadas"))


@query("SELECT hash, count(*) AS vezes, max(melhor) AS melhor, max(em) AS ultima FROM consultas WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) >= 2 AND bool_and(coalesce(confianca, '') IN ('baixa', ''))")
def a04_gaps(spark: SparkSession, d: str) -> DataFrame:
    return U.gaps(load(spark, d, "consultas"), 2, ["baixa", ""])


@query(f"SELECT d.caminho, count(*) AS vezes, count(DISTINCT c.hash) AS consultas, round(sum(pow(2.0, -greatest(0.0, ({NOW} - c.em) / 86400.0) / 14.0)), 4) AS peso, max(c.em) AS ultima FROM devolvidas d JOIN consultas c ON d.consulta = c.id WHERE d.posicao <= 5 GROUP BY 1 HAVING count(DISTINCT c.hash) >= 3")
def a05_most_recalled(spark: SparkSession, d: str) -> DataFrame:
    return U.most_recalled(load(spark, d, "devolvidas"), load(spark, d, "consultas"), NOW)


@query("""WITH a AS (SELECT posicao, count(*) AS mostradas FROM devolvidas GROUP BY 1), b AS (SELECT posicao, count(*) AS abertas FROM aberturas WHERE posicao IS NOT NULL GROUP BY 1)
SELECT posicao, coalesce(mostradas, 0) AS mostradas, coalesce(abertas, 0) AS abertas, CASE WHEN mostradas > 0 THEN round(coalesce(abertas, 0) / mostradas, 3) END AS taxa FROM a FULL JOIN b USING (posicao)""")
def a06_open_rate(spark: SparkSession, d: str) -> DataFrame:
    return U.open_rate(load(spark, d, "devolvidas"), load(spark, d, "aberturas"))


@query("SELECT count(*) FILTER (consulta IS NULL) AS sem_busca, count(DISTINCT caminho) AS caminhos, count(*) AS aberturas FROM aberturas")
def a07_opens_without_search(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "aberturas").agg(F.count_if(F.col("consulta").isNull()).alias("sem_busca"), F.countDistinct("caminho").alias("caminhos"), F.count("*").alias("aberturas"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY ks, ka ORDER BY data DESC NULLS LAST, nota DESC NULLS LAST, valor DESC NULLS LAST) AS k FROM fatos WHERE ks IS NOT NULL AND ka IS NOT NULL)
SELECT ks, ka, count(*) AS n, max(valor) FILTER (k = 1) AS atual, count(DISTINCT kv) > 1 AS diverge FROM f GROUP BY ks, ka""")
def a08_fact_groups(spark: SparkSession, d: str) -> DataFrame:
    return U.fact_groups(load(spark, d, "fatos"))


_SINGLE = ["port", "version", "host", "config_path", "model", "url"]


@query(f"""WITH f AS (SELECT * FROM fatos WHERE ka IN ({", ".join(f"'{x}'" for x in _SINGLE)}) AND ks IS NOT NULL AND kv IS NOT NULL),
g AS (SELECT ks, ka, count(DISTINCT kv) AS valores, count(DISTINCT nota) AS notas, max(struct_pack(n := length(kv), v := kv)).v AS longest, list(DISTINCT kv) AS vs FROM f GROUP BY ks, ka)
SELECT ks, ka, valores, notas FROM g WHERE valores > 1 AND notas > 1 AND len(list_filter(vs, lambda v: NOT contains(longest, v))) > 0""")
def a09_divergences(spark: SparkSession, d: str) -> DataFrame:
    return U.fact_divergences(load(spark, d, "fatos"), _SINGLE)


@query("SELECT count(DISTINCT nota) AS notas, count(*) AS fatos, count(DISTINCT (ks, ka)) FILTER (ks IS NOT NULL AND ka IS NOT NULL) AS grupos FROM fatos")
def a10_fact_statistics(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "fatos").agg(F.countDistinct("nota").alias("notas"), F.count("*").alias("fatos"), F.countDistinct("ks", "ka").alias("grupos"))


@query("""WITH f AS (SELECT col, min(seq) AS primeira FROM mudancas GROUP BY col)
SELECT m.rid, m.col, count(*) AS versoes, max(seq) AS ultima, any_value(f.primeira) AS primeira FROM mudancas m JOIN f USING (col) WHERE seq >= 1000 AND rid IS NOT NULL GROUP BY m.rid, m.col""")
def a11_changes_since(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "mudancas")
    first = m.groupBy("col").agg(F.min("seq").alias("primeira"))
    return m.where((F.col("seq") >= 1000) & F.col("rid").isNotNull()).groupBy("rid", "col").agg(F.count("*").alias("versoes"), F.max("seq").alias("ultima")).join(first, "col")


@query("SELECT projeto, count(DISTINCT caminho) AS caminhos, count(*) AS documentos, CAST(sum(length(text)) AS BIGINT) AS caracteres FROM documents GROUP BY projeto")
def a13_documents_per_project(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy("projeto").agg(F.countDistinct("caminho").alias("caminhos"), F.count("*").alias("documentos"), F.sum(F.length("text").cast("long")).alias("caracteres"))


@query("""WITH e AS (SELECT unnest(json_keys(metadata_json)) AS chave, metadata_json AS m FROM spans), v AS (SELECT chave, json_extract_string(m, '$.' || chave) AS v FROM e)
SELECT chave, count(*) AS n, count(DISTINCT v) AS unicos, min(CAST(v AS DOUBLE)) AS menor, max(CAST(v AS DOUBLE)) AS maior, round(avg(CAST(v AS DOUBLE)), 4) AS media, round(var_samp(CAST(v AS DOUBLE)), 4) AS variancia FROM v GROUP BY chave""")
def a19_field_profile(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "spans").select(F.explode(F.from_json("metadata_json", "map<string,string>")).alias("chave", "v")).withColumn("x", F.col("v").try_cast("double"))
    return e.groupBy("chave").agg(F.count("*").alias("n"), F.countDistinct("v").alias("unicos"), F.min("x").alias("menor"), F.max("x").alias("maior"), F.round(F.avg("x"), 4).alias("media"), F.round(F.var_samp("x"), 4).alias("variancia"))


@query("SELECT event_type, min(value) AS menor, max(value) AS maior, round(avg(value), 4) AS media, round(median(value), 4) AS mediana, round(stddev_samp(value), 4) AS desvio, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75 FROM events GROUP BY 1")
def a20_number_summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return load(spark, d, "events").groupBy("event_type").agg(F.min(v).alias("menor"), F.max(v).alias("maior"), F.round(F.avg(v), 4).alias("media"), F.round(F.percentile(v, 0.5), 4).alias("mediana"), F.round(F.stddev_samp(v), 4).alias("desvio"), F.round(F.percentile(v, 0.25), 4).alias("p25"), F.round(F.percentile(v, 0.75), 4).alias("p75"))


@query("SELECT source_repo, count(*) AS n, CAST(sum(char_count) AS BIGINT) AS caracteres FROM skills GROUP BY 1")
def a21_skills_per_repo(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "skills").groupBy("source_repo").agg(F.count("*").alias("n"), F.sum("char_count").alias("caracteres"))


@query("SELECT lower(trim(status)) AS estado, count(*) AS n, CAST(sum(total_steps) AS BIGINT) AS passos, CAST(sum(completed_steps) AS BIGINT) AS feitos FROM dag_runs GROUP BY 1")
def a24_runs_by_status(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "dag_runs").groupBy(F.lower(F.trim("status")).alias("estado")).agg(F.count("*").alias("n"), F.sum(F.col("total_steps").cast("long")).alias("passos"), F.sum(F.col("completed_steps").cast("long")).alias("feitos"))


@query("""WITH s AS (SELECT dag_name, finished_at - started_at AS s FROM dag_runs WHERE finished_at >= started_at),
g AS (SELECT dag_name, count(*) AS n, round(min(s), 3) AS menor, round(median(s), 3) AS mediana, round(max(s), 3) AS maior FROM s GROUP BY 1)
SELECT *, CASE WHEN menor > 0 THEN maior / menor >= 10 ELSE false END AS larga FROM g""")
def a25_duration_hint(spark: SparkSession, d: str) -> DataFrame:
    return U.duration_hint(load(spark, d, "dag_runs"), "dag_name", F.col("finished_at") - F.col("started_at"))


@query("SELECT col, lower(trim(op)) AS op, count(*) AS n, grouping(col, lower(trim(op))) AS nivel FROM mudancas GROUP BY CUBE (col, lower(trim(op)))")
def a29_cube(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "mudancas").withColumn("op", F.lower(F.trim("op")))
    return m.cube("col", "op").agg(F.count("*").alias("n"), F.grouping_id().alias("nivel"))


# windows


@query("SELECT col, rid, seq, ordem FROM (SELECT col, rid, seq, row_number() OVER (PARTITION BY col, rid ORDER BY seq DESC) AS ordem FROM (SELECT DISTINCT col, rid, seq FROM mudancas WHERE seq IS NOT NULL AND rid IS NOT NULL)) WHERE ordem <= 3")
def w01_newest_versions(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "mudancas").where("seq IS NOT NULL AND rid IS NOT NULL").select("col", "rid", "seq").distinct()
    return W.newest(m, ["col", "rid"], [F.desc("seq")], 3)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER w AS p, row_number() OVER w AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE i = 1 OR p IS DISTINCT FROM o_orderstatus")
def w03_changed_only(spark: SparkSession, d: str) -> DataFrame:
    return W.changed_only(load(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT documento, rid, n FROM (SELECT regexp_replace(id, '::chunk_[0-9]+$', '') AS documento, rid, length(doc) AS n, row_number() OVER (PARTITION BY regexp_replace(id, '::chunk_[0-9]+$', '') ORDER BY length(doc) DESC NULLS LAST, rid) AS k FROM chunks) WHERE k = 1")
def w04_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunks").select(F.regexp_replace("id", "::chunk_[0-9]+$", "").alias("documento"), "rid", F.length("doc").alias("n"))
    return S.keep_first(c, ["documento"], [F.desc_nulls_last("n"), F.asc("rid")])


_CHANGE = """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS antes, avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS depois, stddev_samp(value) OVER (PARTITION BY user_id) AS sd FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, event_id, i - 1 AS i, round(antes, 4) AS antes, round(depois, 4) AS depois FROM e WHERE i - 1 >= 5 AND i - 1 < n - 5 AND sd > 0 AND abs(depois - antes) > 2 * sd)"""


@query(_CHANGE + """, k AS (SELECT user_id, min(i) AS i FROM c GROUP BY user_id UNION ALL SELECT c.user_id, min(c.i) FROM k JOIN c ON c.user_id = k.user_id AND c.i - k.i > 5 GROUP BY c.user_id, k.i)
SELECT user_id, event_id, antes, depois FROM c WHERE (user_id, i) IN (SELECT user_id, i FROM k)""")
def w05_change_points(spark: SparkSession, d: str) -> DataFrame:
    """Level shifts of each user's values, over five rows apart."""
    c = W.change_points(load(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value")
    return c.select("user_id", "event_id", F.round("antes", 4).alias("antes"), F.round("depois", 4).alias("depois"))


@query(_CHANGE + " SELECT user_id, event_id, antes, depois FROM c")
def w06_array_change_points(spark: SparkSession, d: str) -> DataFrame:
    """Every level shift, however near the one before."""
    c = W.change_points(load(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value", gap=False)
    return c.select("user_id", "event_id", F.round("antes", 4).alias("antes"), F.round("depois", 4).alias("depois"))


#: A short high stretch among zeros, a group that is too short, equal values, and a null.
SHIFT = [("a", i, 9.0 if 30 <= i < 35 else 0.0) for i in range(65)] + [("a", 99, None)] + [("b", i, 9.0 if i > 2 else 0.0) for i in range(9)] + [("c", i, 5.0) for i in range(20)]


@query("SELECT g, CAST(i AS INT) AS i, antes::DOUBLE AS antes, depois::DOUBLE AS depois FROM (VALUES ('a', 28, 0.0, 5.4), ('a', 34, 7.2, 1.8)) x(g, i, antes, depois)")
def w05_literal_shift(spark: SparkSession, d: str) -> DataFrame:
    """Literal rows: of ten places over two deviations, the first and the first over five behind it."""
    df = spark.createDataFrame(SHIFT, "g string, i int, x double")
    return W.change_points(df, ["g"], [F.col("i")], "x").select("g", "i", F.round("antes", 4).alias("antes"), F.round("depois", 4).alias("depois"))


@query("SELECT event_id FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1) USING (event_type) WHERE sd > 0 AND abs(value - m) > 2 * sd")
def w07_outliers(spark: SparkSession, d: str) -> DataFrame:
    return W.outliers(load(spark, d, "events"), ["event_type"], "value").select("event_id")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS novo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(novo) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS corrida FROM e)
SELECT user_id, event_type, CAST(corrida AS BIGINT) AS corrida, count(*) AS tamanho FROM r GROUP BY ALL""")
def w08_runs(spark: SparkSession, d: str) -> DataFrame:
    return W.runs(load(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")


@query("SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS fim FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def w09_span_ends(spark: SparkSession, d: str) -> DataFrame:
    return W.ends_before_next(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber")


@query("""WITH e AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, round(avg((value >= p)::INT), 4) AS sobe, round(avg((value <= p)::INT), 4) AS desce FROM e WHERE p IS NOT NULL AND value IS NOT NULL GROUP BY 1""")
def w10_monotone_share(spark: SparkSession, d: str) -> DataFrame:
    return W.monotone_share(load(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value")


@query("""WITH RECURSIVE c AS (SELECT cliente, ferramenta, em, row_number() OVER (PARTITION BY cliente, ferramenta ORDER BY em) AS i FROM (SELECT DISTINCT * FROM chamadas) WHERE em IS NOT NULL),
r AS (SELECT cliente, ferramenta, em, i, [em] AS ok, 0.0::DOUBLE AS espera FROM c WHERE i = 1
UNION ALL SELECT c.cliente, c.ferramenta, c.em, c.i, CASE WHEN len(list_filter(ok, lambda x: c.em - x < 600)) >= 3 THEN list_filter(ok, lambda x: c.em - x < 600) ELSE list_append(list_filter(ok, lambda x: c.em - x < 600), c.em) END,
CASE WHEN len(list_filter(ok, lambda x: c.em - x < 600)) >= 3 THEN round(600 - (c.em - list_min(list_filter(ok, lambda x: c.em - x < 600))), 3) ELSE 0 END FROM r JOIN c ON c.i = r.i + 1 AND c.cliente IS NOT DISTINCT FROM r.cliente AND c.ferramenta IS NOT DISTINCT FROM r.ferramenta)
SELECT cliente, ferramenta, em, espera FROM r""")
def w11_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """At most 3 calls a client and tool in 600 s, repeated deliveries apart."""
    c = load(spark, d, "chamadas").distinct().withColumn("h", F.xxhash64("em", "ferramenta", "cliente", "segundos", "chars_entrada"))
    return W.rate_limited(c, ["cliente", "ferramenta"], "em", "h", 3, 600.0).drop("h")


@query("SELECT rid, max_by(op, seq) AS op, max(seq) AS seq FROM (SELECT DISTINCT rid, seq, lower(trim(op)) AS op FROM mudancas WHERE rid IS NOT NULL AND seq IS NOT NULL AND op IS NOT NULL) GROUP BY rid")
def w12_last_op(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "mudancas").where("rid IS NOT NULL AND seq IS NOT NULL AND op IS NOT NULL").withColumn("op", F.lower(F.trim("op")))
    return m.groupBy("rid").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS l, generate_subscripts(string_split(text, E'\\n'), 1) - 1 AS i FROM documents WHERE lower(trim(source)) = 'log' AND text IS NOT NULL),
s AS (SELECT *, max(regexp_matches(l, '(?i)\\bERROR\\b')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM l) SELECT doc_id, CAST(i AS INT) AS linha FROM s WHERE s = 1""")
def w13_error_context(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where((F.lower(F.trim("source")) == "log") & F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("linha", "l"))
    return W.context_of(lines, ["doc_id"], [F.col("linha")], F.col("l").rlike(r"(?i)\bERROR\b")).select("doc_id", "linha")


# ranking


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.qid, b.vec_id AS doc, round(coalesce(list_cosine_similarity(q.e::DOUBLE[], b.embedding::DOUBLE[]), 0), 6) AS cos FROM q JOIN embeddings b ON b.vec_id <> q.qid)
SELECT qid, doc, cos, posicao FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, doc) AS posicao FROM s) WHERE posicao <= 10""")
def k01_exact_knn(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    e = load(spark, d, "embeddings")
    return R.knn_blocks(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)


_BM_Q = "SELECT id AS qid, list_distinct(regexp_extract_all(strip_accents(lower(texto)), '([\\p{L}\\p{N}]+)', 1)) AS terms FROM consultas WHERE id % 100 = 0 AND texto IS NOT NULL"
_BM_SQL = f"""WITH q AS ({_BM_Q}), t AS (SELECT id AS doc, unnest(regexp_extract_all(strip_accents(lower(coalesce(title, ''))), '([\\p{{L}}\\p{{N}}]+)', 1)) AS term, 3.0 AS w FROM skills UNION ALL SELECT id, unnest(regexp_extract_all(strip_accents(lower(coalesce(content, ''))), '([\\p{{L}}\\p{{N}}]+)', 1)), 1.0 FROM skills),
tf AS (SELECT term, doc, sum(w)::DOUBLE AS tf FROM t GROUP BY ALL), len AS (SELECT doc, sum(tf) AS l FROM tf GROUP BY doc), st AS (SELECT count(*) AS n, avg(l) AS a FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT qid, unnest(terms) AS term FROM q),
s AS (SELECT qid, tf.doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc), st GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS posicao FROM s) WHERE posicao <= 10)
"""


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    q = checkpoint(load(spark, d, "consultas").where("id % 100 = 0 AND texto IS NOT NULL").select(F.col("id").alias("qid"), R.plain_terms(F.col("texto")).alias("terms")))
    return checkpoint(R.bm25_of_texts(q, load(spark, d, "skills"), "id", {"title": 3.0, "content": 1.0}, 10))


@query(_BM_SQL + "SELECT qid, doc, score, posicao FROM lex")
def k03_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose id is divisible by 100 against all skills, title weighing three."""
    return _lexical(spark, d)


_BY_SIZE = "sz AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY char_count NULLS LAST, doc) AS posicao FROM lex JOIN skills ON doc = id)"


@query(_BM_SQL + f""", {_BY_SIZE}, l AS (SELECT qid, 'a' AS lista, doc, posicao FROM lex UNION ALL SELECT qid, 'b', doc, posicao FROM sz),
f AS (SELECT qid, doc, round(sum(1.0::DOUBLE / (60 + posicao)), 9) AS score, min(struct_pack(lista := lista, posicao := posicao)) AS seen FROM l GROUP BY ALL)
SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, doc) AS posicao FROM f""")
def r01_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    lex = _lexical(spark, d)
    by = lex.join(load(spark, d, "skills").select(F.col("id").alias("doc"), "char_count"), "doc").withColumn("posicao", F.row_number().over(Window.partitionBy("qid").orderBy(F.asc_nulls_last("char_count"), "doc")))
    lists = lex.select("qid", F.lit("a").alias("lista"), "doc", "posicao").union(by.select("qid", F.lit("b"), "doc", "posicao"))
    return R.rrf(lists)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS qid, b.vec_id AS doc, q.label = b.label AS rel, round(coalesce(list_cosine_similarity(q.e, b.e), 0), 6) AS cos FROM q JOIN e b ON b.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, doc) AS p FROM s), n AS (SELECT qid, count(*) FILTER (rel) AS n FROM s GROUP BY qid HAVING count(*) FILTER (rel) > 0),
h AS (SELECT qid, min(p) AS first, sum(1 / log2(p + 1.0)) AS dcg FROM r WHERE rel AND p <= 10 GROUP BY qid),
b AS (SELECT qid, list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(x + 1.0))) AS best FROM n)
SELECT round(avg(coalesce((first <= 1)::INT, 0)), 6) AS hit_1, round(avg(coalesce((first <= 3)::INT, 0)), 6) AS hit_3, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS hit_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / best, 0)), 6) AS ndcg, count(*) AS consultas FROM b LEFT JOIN h USING (qid)""")
def r13_retrieval_measures(spark: SparkSession, d: str) -> DataFrame:
    """How well exact search finds vectors of the query's own label."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    ranked = R.knn_blocks(e, q, "vec_id", "embedding", 10)
    rel = q.select(F.col("vec_id").alias("qid"), "label").join(e.select(F.col("vec_id").alias("doc"), "label"), "label").where("qid <> doc").select("qid", "doc", F.lit(1).alias("grau"))
    return R.retrieval_measures(ranked, rel, 10)


@query("SELECT id, CASE WHEN melhor >= 0.62 THEN 'alta' WHEN melhor >= 0.50 THEN 'media' ELSE 'baixa' END AS faixa FROM consultas")
def r09_confidence(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "consultas").select("id", R.confidence_band(F.col("melhor")).alias("faixa"))


@query("""SELECT doc_id, round(least(greatest(1.0 + CASE lower(trim(source)) WHEN 'conversa' THEN -0.15 WHEN 'skill' THEN 0.12 ELSE 0 END + CASE WHEN lower(trim(source)) = 'log' THEN -0.08 ELSE 0.10 END
 + CASE WHEN starts_with(caminho, 'investigations/') THEN -0.05 WHEN starts_with(caminho, '_lint/') THEN -0.20 ELSE 0 END, 0.55), 1.5), 6)::DOUBLE AS fator FROM documents""")
def r06_authority(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.trim("source"))
    kind = F.when(s == "conversa", "session").when(s == "skill", "procedure").otherwise("")
    tier = F.when(s == "log", "episodic").otherwise("semantic")
    return load(spark, d, "documents").select("doc_id", F.round(R.authority(F.coalesce("caminho", F.lit("")), kind, tier, F.lit(False), F.array().cast("array<string>")), 6).alias("fator"))


# sets

_SPLIT = "'2025-12-01'"


@query(f"""WITH a AS (SELECT rid, max(seq) AS s FROM mudancas WHERE chegou_em < {_SPLIT} AND rid IS NOT NULL GROUP BY rid), b AS (SELECT rid, max(seq) AS s FROM mudancas WHERE chegou_em >= {_SPLIT} AND rid IS NOT NULL GROUP BY rid)
SELECT rid, CASE WHEN a.rid IS NULL THEN 'indexar' WHEN b.rid IS NULL THEN 'remover' WHEN a.s IS DISTINCT FROM b.s THEN 'indexar' ELSE 'manter' END AS acao FROM a FULL JOIN b USING (rid)""")
def u03_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "mudancas").where("rid IS NOT NULL")
    side = lambda c: m.where(c).groupBy("rid").agg(F.max("seq").alias("s"))
    return S.sync_plan(side(f"chegou_em < {_SPLIT}"), side(f"chegou_em >= {_SPLIT}"), "rid", "s")


@query("""WITH o AS (SELECT c_nationkey AS n, o_orderpriority AS p, o_orderdate AS t FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 AS m FROM orders),
a AS (SELECT DISTINCT n, p FROM o, m WHERE t < m), b AS (SELECT DISTINCT n, p FROM o, m WHERE t >= m)
SELECT n, p, CASE WHEN a.n IS NULL THEN 'nova' WHEN b.n IS NULL THEN 'removida' ELSE 'igual' END AS estado FROM (SELECT n, p FROM a UNION SELECT n, p FROM b) k LEFT JOIN a USING (n, p) LEFT JOIN b USING (n, p)""")
def u01_graph_diff(spark: SparkSession, d: str) -> DataFrame:
    """Edges nation to priority in the two halves of the orders' time."""
    o = load(spark, d, "orders").join(load(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select(F.col("c_nationkey").alias("n"), F.col("o_orderpriority").alias("p"), F.col("o_orderdate").alias("t"))
    ends = load(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z")).select((F.col("a") + (F.col("z") - F.col("a")) / 2).alias("m"))
    t = o.join(F.broadcast(ends))  # one row
    return S.diff(t.where("t < m").select("n", "p").distinct(), t.where("t >= m").select("n", "p").distinct(), ["n", "p"])


_U08 = "x AS (SELECT consulta AS id, CAST(count(DISTINCT caminho) AS INT) AS n FROM devolvidas WHERE consulta > 0 GROUP BY 1)"


def _returned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = load(spark, d, "devolvidas").where("consulta > 0").groupBy(F.col("consulta").alias("id")).agg(F.countDistinct("caminho").cast("int").alias("n"))
    return load(spark, d, "consultas").select("id", "hash", "confianca", "melhor", "n"), n


@query(f"WITH {_U08} SELECT id, b.hash, b.confianca, b.melhor, coalesce(x.n, b.n) AS n FROM consultas b FULL JOIN x USING (id)")
def u08_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All queries, merged with the number of different paths returned to each; lost queries come out with that alone."""
    return S.upsert(*_returned(spark, d), ["id"])


@query(f"WITH {_U08} SELECT id, b.hash, b.confianca, b.melhor, CASE WHEN b.id IS NULL THEN x.n ELSE b.n END AS n FROM consultas b FULL JOIN x USING (id)")
def u08_add(spark: SparkSession, d: str) -> DataFrame:
    """The same, ignoring queries that are there."""
    return S.upsert(*_returned(spark, d), ["id"], "add")


@query(f"WITH {_U08} SELECT id, b.hash, b.confianca, b.melhor, coalesce(x.n, b.n) AS n FROM consultas b LEFT JOIN x USING (id)")
def u08_update(spark: SparkSession, d: str) -> DataFrame:
    """The same, ignoring queries that are not there."""
    return S.upsert(*_returned(spark, d), ["id"], "update")


@query("SELECT id, source_repo FROM skills WHERE NOT coalesce(category IS NOT NULL AND char_count < 1000 AND source_repo IN (SELECT source_repo FROM skills WHERE source_repo IS NOT NULL GROUP BY 1 HAVING count(*) > 10), false)")
def u09_delete(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "skills")
    big = s.groupBy("source_repo").agg(F.count("*").alias("n")).where("n > 10")
    return S.delete(s, big, ["source_repo"], F.col("category").isNotNull() & (F.col("char_count") < 1000)).select("id", "source_repo")


# entities


@query("SELECT id, min(id) OVER (PARTITION BY md5(content)) AS primeiro FROM skills WHERE content IS NOT NULL QUALIFY primeiro <> id")
def d09_exact_copies(spark: SparkSession, d: str) -> DataFrame:
    return E.exact_copies(load(spark, d, "skills"), "id", "content")


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch, length(p_name) AS n FROM part), f AS (SELECT p_partkey, ch, count(*) / any_value(n) AS p FROM c GROUP BY ALL)
SELECT p_partkey, round(-sum(p * log2(p)), 4) AS bits FROM f GROUP BY 1""")
def d02_label_entropy(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.round(E.entropy(F.col("p_name")), 4).alias("bits"))


@query("""WITH p AS (SELECT p_partkey, list_distinct(list_transform(range(1, greatest(length(replace(p_name, ' ', '')) - 2, 1) + 1), lambda i: substring(replace(p_name, ' ', ''), i, 3))) AS s FROM part) SELECT p_partkey, len(s) AS trigramas FROM p""")
def d03_label_shingles(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.size(E.char_shingles(F.col("p_name"))).cast("long").alias("trigramas"))


_NORM = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
#: Distinct normal forms that say enough, by the letters' entropy.
_LABELS = lambda c, t: f"""l AS (SELECT DISTINCT {_NORM(c)} AS l FROM {t} WHERE {c} IS NOT NULL), ch AS (SELECT l, unnest(string_split(l, '')) AS c FROM l WHERE l <> ''),
fr AS (SELECT l, count(*)::DOUBLE / any_value(length(l)) AS p FROM ch GROUP BY l, c), g AS (SELECT l FROM fr GROUP BY l HAVING -sum(p * log2(p)) >= 2.5)"""  # noqa: E731


@query(f"WITH {_LABELS('ks', 'fatos')} SELECT a.l AS a, b.l AS b, round(jaro_winkler_similarity(a.l, b.l), 6) AS sim FROM g a JOIN g b ON a.l < b.l WHERE jaro_winkler_similarity(a.l, b.l) >= 0.9")
def d06_similar_labels(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of subjects with Jaro-Winkler of 0.9 or more."""
    return similar_labels(load(spark, d, "fatos"), "ks", 0.9, exact=True).withColumn("sim", F.round("sim", 6))


_BIT = ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))
_MARK = " + ".join(f"CASE WHEN 2 * b{i} > n THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))


@query(f"""WITH g AS (SELECT id, unnest(list_transform(range(1, greatest(length(lower(content)) - 2, 2)), lambda i: substring(lower(content), i, 4))) AS g FROM skills WHERE content IS NOT NULL),
h AS (SELECT id, CAST(CAST('0x' || substring(md5(g), 1, 16) AS UBIGINT) AS UBIGINT) AS h FROM g), b AS (SELECT id, count(*) AS n, {_BIT} FROM h GROUP BY id), m AS (SELECT id, {_MARK} AS m FROM b)
SELECT id, CAST(CASE WHEN m >= 9223372036854775808::HUGEINT THEN m - 18446744073709551616::HUGEINT ELSE m END AS BIGINT) AS marca FROM skills LEFT JOIN m USING (id)""")
def d14_simhash(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "skills").select("id", E.simhash("content").alias("marca"))


# graphs: regions, nations, customers and suppliers


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t, k, name, kind: load(spark, d, t).select(F.concat(F.lit(kind), F.col(k).cast("string")).alias("id"), F.col(name).alias("label"))
    return reduce(DataFrame.unionByName, [n("region", "r_regionkey", "r_name", "R"), n("nation", "n_nationkey", "n_name", "N"), n("customer", "c_custkey", "c_name", "C"), n("supplier", "s_suppkey", "s_name", "S")])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    e = lambda t, a, ka, b, kb, rel: load(spark, d, t).select(F.concat(F.lit(ka), F.col(a).cast("string")).alias("source"), F.concat(F.lit(kb), F.col(b).cast("string")).alias("target"), F.lit(rel).alias("relation"))
    return reduce(DataFrame.unionByName, [e("nation", "n_nationkey", "N", "n_regionkey", "R", "references"), e("customer", "c_custkey", "C", "c_nationkey", "N", "calls"), e("supplier", "s_suppkey", "S", "s_nationkey", "N", "contains")])


_G = """WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, 'references' AS relation FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'calls' FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'contains' FROM supplier)
"""


@query(_G + ", d AS (SELECT source AS id, 0 AS entra, 1 AS sai FROM e WHERE relation <> 'contains' UNION ALL SELECT target, 1, 0 FROM e WHERE relation <> 'contains') SELECT id, CAST(sum(entra) AS BIGINT) AS entra, CAST(sum(sai) AS BIGINT) AS sai, CAST(count(*) AS BIGINT) AS grau FROM d GROUP BY id")
def a18_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


@query(_G + ", r AS (SELECT 'R1' AS id, 0 AS nivel UNION SELECT e.source, nivel + 1 FROM r JOIN e ON e.target = r.id AND e.relation IN ('references', 'calls') WHERE nivel < 3) SELECT 'R1' AS seed, id, min(nivel) AS nivel FROM r GROUP BY id")
def g04_affected(spark: SparkSession, d: str) -> DataFrame:
    return G.affected(_edges(spark, d), spark.createDataFrame([("R1",)], "id string"), 3)


@query(_G + """, m AS (SELECT 'N' || n_nationkey AS id, n_regionkey AS community FROM nation UNION ALL SELECT 'R' || r_regionkey, r_regionkey FROM region UNION ALL SELECT 'C' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
i AS (SELECT a.community, count(*) AS internas FROM (SELECT DISTINCT least(source, target) AS x, greatest(source, target) AS y FROM e) JOIN m a ON a.id = x JOIN m b ON b.id = y AND a.community = b.community GROUP BY 1), n AS (SELECT community, count(*) AS n FROM m GROUP BY 1)
SELECT community, n, coalesce(internas, 0) AS internas, CASE WHEN n <= 1 THEN 1.0 ELSE round(coalesce(internas, 0) / (n * (n - 1) / 2), 6) END AS coesao FROM n LEFT JOIN i USING (community)""")
def g09_cohesion(spark: SparkSession, d: str) -> DataFrame:
    nat = load(spark, d, "nation")
    m = nat.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))
    m = m.union(load(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey"), "r_regionkey")).union(load(spark, d, "customer").join(nat, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("C"), "c_custkey"), "n_regionkey"))
    return G.cohesion(_edges(spark, d), m)


@query(_G + ", b AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), r AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS id FROM region UNION SELECT root, b.b FROM r JOIN b ON b.a = r.id) SELECT id AS node, min(m) AS component FROM (SELECT id, root FROM r) JOIN (SELECT root, min(id) AS m FROM r GROUP BY root) USING (root) GROUP BY id")
def g06_components(spark: SparkSession, d: str) -> DataFrame:
    return components(_edges(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst")))


_STEP = "s AS (SELECT DISTINCT source, target FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL AND source <> target)"


@query(f"""WITH RECURSIVE {_STEP}, p AS (SELECT source AS f, target AS l, [source, target] AS path FROM s WHERE source < target UNION ALL SELECT f, s.target, list_append(path, s.target) FROM p JOIN s ON s.source = p.l WHERE s.target > f AND NOT list_contains(path, s.target) AND len(path) < 5)
SELECT array_to_string(path, '>') AS ciclo, CAST(len(path) AS INT) AS tamanho FROM p JOIN s ON s.source = l AND s.target = f""")
def g14_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of up to five among the types of consecutive events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = load(spark, d, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target")).where("target IS NOT NULL")
    return G.cycles(s).select(F.array_join("ciclo", ">").alias("ciclo"), "tamanho")


@query(_G + ", near AS (SELECT 'N' || n_nationkey AS id FROM nation) SELECT n.id, sentido, relation, vizinho, grau, ordem FROM (SELECT id, sentido, relation, vizinho, grau, row_number() OVER (PARTITION BY id, sentido ORDER BY relation, grau DESC, vizinho) AS ordem FROM (SELECT source AS id, 'sai' AS sentido, relation, target AS vizinho FROM e WHERE relation <> 'contains' UNION ALL SELECT target, 'entra', relation, source FROM e WHERE relation <> 'contains') JOIN (SELECT id AS vizinho, count(*) AS grau FROM (SELECT source AS id FROM e WHERE relation <> 'contains' UNION ALL SELECT target FROM e WHERE relation <> 'contains') GROUP BY id) USING (vizinho)) n JOIN near ON near.id = n.id WHERE ordem <= 20")
def g01_neighbors(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"))
    return G.neighbors_of(_edges(spark, d), ids, 20).select("id", "sentido", "relation", "vizinho", "grau", "ordem")


@query("SELECT * FROM (VALUES ('a', 'a'), ('b', 'a'), ('c', 'a'), ('d', 'a'), ('w', 'w'), ('x', 'w'), ('y', 'w'), ('z', 'w'), ('p', 'p'), ('q', 'p')) v(id, community)")
def g07_communities(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of four, each knit closely, with one edge between them, and a pair apart."""
    four = lambda g: [(x, y) for i, x in enumerate(g) for y in g[i + 1 :]]
    return G.communities(spark.createDataFrame([*four("abcd"), *four("wxyz"), ("d", "w"), ("p", "q")], "source string, target string"))


@query()
def g07_all_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(_edges(spark, d))


@query(_G + " SELECT 'C' || c_custkey AS src, 'R' || n_regionkey AS dst, 2 AS passos, 'C' || c_custkey || '>N' || c_nationkey || '>R' || n_regionkey AS caminho, '>>' AS sentidos, true AS dirigido FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g02_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """From every customer to its region."""
    pairs = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"))
    return G.shortest_paths(_edges(spark, d), pairs).withColumn("caminho", F.array_join("caminho", ">"))


@query(_G + """ SELECT 'R' || a.r_regionkey AS src, 'R' || b.r_regionkey AS dst, 0 AS passos, 'R' || a.r_regionkey AS caminho, '' AS sentidos, true AS dirigido FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey
UNION ALL SELECT 'N' || a.n_nationkey, 'N' || b.n_nationkey, 2, 'N' || a.n_nationkey || '>R' || a.n_regionkey || '>N' || b.n_nationkey, '><', false FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def g02_undirected_paths(spark: SparkSession, d: str) -> DataFrame:
    """Between nations, which meet only against the edges' direction, and from each region to itself."""
    nat = load(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("x"))
    reg = load(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("x"))
    pairs = nat.toDF("src").crossJoin(F.broadcast(nat.toDF("dst"))).where("src <> dst").unionByName(reg.select(F.col("x").alias("src"), F.col("x").alias("dst")))  # 25 nations
    nations = _edges(spark, d).where("relation = 'references'")
    return G.shortest_paths(nations, pairs).withColumn("caminho", F.array_join("caminho", ">"))


@query(_G + ", n AS (SELECT 'R' || r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, c_name FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier) SELECT 'MERGE (n {id: ''' || id || '''}) SET n.label = ''' || label || ''';' AS linha FROM n UNION ALL SELECT 'MATCH (a {id: ''' || source || '''}), (b {id: ''' || target || '''}) MERGE (a)-[:' || upper(relation) || ']->(b);' FROM e")
def s20_cypher(spark: SparkSession, d: str) -> DataFrame:
    return G.cypher(_nodes(spark, d), _edges(spark, d))


# texts


@query("""WITH c AS (SELECT rid, id, doc, length(doc) AS n, CASE WHEN length(doc) <= 3072 THEN 1 ELSE CAST(ceil((length(doc) - 200) / 2872.0) AS INT) END AS k FROM chunks WHERE length(doc) > 0)
SELECT rid, CASE WHEN k > 1 THEN id || '::chunk_' || i ELSE id END AS chunk_id, CAST(i AS INT) AS i, CAST(i * 2872 AS INT) AS inicio, substring(doc, i * 2872 + 1, 3072) AS chunk FROM (SELECT *, unnest(range(k)) AS i FROM c)""")
def t01_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return X.fixed_chunks(load(spark, d, "chunks"), "rid", "id", "doc")


@query("SELECT id, substring(sha1(trim(regexp_replace(lower(texto), '\\s+', ' ', 'g'))), 1, 16) AS marca FROM consultas WHERE texto IS NOT NULL")
def t47_query_hash(spark: SparkSession, d: str) -> DataFrame:
    """The mark of every text that is not null."""
    return load(spark, d, "consultas").where(F.col("texto").isNotNull()).select("id", X.query_hash(F.col("texto")).alias("marca"))


@query("SELECT id, array_to_string(list_filter(regexp_extract_all(strip_accents(lower(regexp_replace(title, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))), '([a-z0-9]+)', 1), lambda x: length(x) > 1), ' ') AS termos FROM skills")
def t08_identifier_terms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "skills").select("id", F.array_join(X.identifier_terms(F.col("title")), " ").alias("termos"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS l FROM documents WHERE lower(trim(source)) = 'log' AND text IS NOT NULL)
SELECT CASE WHEN regexp_matches(l, '(?i)\\b(error|fatal|critical|exception|traceback|failed)\\b') THEN 'error' WHEN regexp_matches(l, '(?i)\\bwarn(ing)?\\b') THEN 'warning' WHEN regexp_matches(l, '(?i)\\binfo\\b') THEN 'info' WHEN regexp_matches(l, '(?i)\\bdebug\\b') THEN 'debug' ELSE 'text' END AS nivel, count(*) AS linhas FROM l GROUP BY 1""")
def t30_log_levels(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where((F.lower(F.trim("source")) == "log") & F.col("text").isNotNull())
    return docs.select(F.explode(F.split("text", "\n")).alias("l")).groupBy(X.log_level(F.col("l")).alias("nivel")).agg(F.count("*").alias("linhas"))


@query("SELECT id, nullif(trim(regexp_extract(regexp_extract(content, '(?s)\\A---\\r?\\n(.*?)\\r?\\n---', 1), '(?m)^name:[ \\t]*(.*)$', 1), ' '), '') AS nome FROM skills WHERE content IS NOT NULL")
def t16_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "skills").where(F.col("content").isNotNull()).select("id", X.frontmatter(F.col("content"), "name").alias("nome"))


@query("""WITH l AS (SELECT id, unnest(string_split(regexp_replace(content, '(?s)```.*?```', '', 'g'), E'\\n')) AS l, generate_subscripts(string_split(regexp_replace(content, '(?s)```.*?```', '', 'g'), E'\\n'), 1) - 1 AS i FROM skills WHERE content IS NOT NULL)
SELECT id, CAST(i AS INT) AS linha, CAST(length(regexp_extract(l, '^(#+)', 1)) AS INT) AS nivel, trim(regexp_extract(l, '^#+[ \\t]+(.*)$', 1), ' ') AS titulo FROM l WHERE regexp_matches(l, '^#{1,6}[ \\t]+\\S')""")
def s17_headings(spark: SparkSession, d: str) -> DataFrame:
    return X.headings(load(spark, d, "skills"), "id", "content")


@query(f"""WITH a AS (SELECT c.c_custkey AS id, count(o_orderkey) AS n, max(epoch(o_orderdate)) AS last, min(epoch(o_orderdate)) AS first FROM customer c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT id, round(exp(-0.02 * greatest(({NOW} - coalesce(first, {NOW})) / 86400.0, 0)) + CASE WHEN last IS NULL THEN 0 ELSE 0.6 * ln(1.0 + n) * exp(-0.04 * greatest(({NOW} - last) / 86400.0, 0)) END, 6) AS nota FROM a""")
def t22_retention(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.max(F.col("o_orderdate").cast("timestamp").cast("double")).alias("last"), F.min(F.col("o_orderdate").cast("timestamp").cast("double")).alias("first"))
    j = load(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left")
    days = lambda c: (F.lit(NOW) - c) / 86400.0
    return j.select("id", F.round(U.retention(days(F.coalesce("first", F.lit(NOW))), F.coalesce("n", F.lit(0)), days(F.col("last"))), 6).alias("nota"))


# event time


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS dia, event_type, count(*) AS n, round(sum(value), 4) AS soma FROM events GROUP BY ALL")
def x14_daily_windows(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("soma"))
    return g.select(F.col("w.start").alias("dia"), "event_type", "n", "soma")


@query("""WITH e AS (SELECT user_id, ts, event_id, (coalesce(ts - lag(ts) OVER w >= INTERVAL 15 minute, true))::INT AS novo FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(novo) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS inicio, count(*) AS n FROM s GROUP BY user_id, k""")
def x15_sessions(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "events").groupBy("user_id", F.session_window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("inicio"), "n")


@query("SELECT caminho, count(*) AS total, max(em) AS ultimo FROM aberturas WHERE caminho IS NOT NULL GROUP BY 1")
def x04_access_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "aberturas").where("caminho IS NOT NULL").groupBy("caminho").agg(F.count("*").alias("total"), F.max("em").alias("ultimo"))
