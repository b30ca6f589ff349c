"""Queries of text compaction and of JSON arrays, with their SQL or literal answers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import compact as K
from garimpo.operators import crusher as J
from garimpo.plans.registry import registry, rows
from garimpo.runtime import load

QUERIES, ORACLE, query = registry()

_W = lambda ws: "(?i)(^|[^A-Za-z0-9_])(" + "|".join(sorted(ws, key=len, reverse=True)) + ")($|[^A-Za-z0-9_])"
_LOGS = "l AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS l, generate_subscripts(string_split(text, E'\\n'), 1) - 1 AS i FROM documents WHERE lower(trim(source)) = 'log' AND text IS NOT NULL)"


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where((F.lower(F.trim("source")) == "log") & F.col("text").isNotNull())


@query(f"WITH {_LOGS}, s AS (SELECT lower(regexp_extract(l, '{_W([*K.ERROR, *K.IMPORTANCE])}', 2)) AS w, regexp_matches(l, '{_W(K.WARNING)}') AS a FROM l) SELECT CASE WHEN list_contains({K.ERROR}, w) THEN 'error' WHEN w <> '' THEN 'importance' WHEN a THEN 'warning' END AS sinal, count(*) AS linhas FROM s GROUP BY 1")
def t52_signals(spark: SparkSession, d: str) -> DataFrame:
    lines = _logs(spark, d).select(F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy(K.signal(F.col("l"), "log").alias("sinal")).agg(F.count("*").alias("linhas"))


_KINDS = [
    (1, '[{"id": 1}, {"id": 2}]', "json"), (2, "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b", "diff"), (3, "<!doctype html><html><body><div><p>x</p></div></body></html>", "html"), (4, "src/a.py:1:x\nsrc/b.py:22:y\nz", "search"),
    (5, "2025-01-01 INFO start\n2025-01-01 ERROR boom\n  more", "log"), (6, "a,b,c\n1,2,3\n4,5,6\n7,8,9", "table"), (7, "| a | b |\n|---|---|\n| 1 | 2 |", "table"), (8, "[core]\nname = x\nport = 80\n# c", "config"), (9, "def f(x):\n    return x\nclass A:\n    pass\nimport os", "code"),
    (10, "Uma frase, com virgulas, e mais.\nOutra frase, igual, aqui.\nFim, enfim, acabou.", "text"), (11, " \n", "text"), (12, None, "text"), (13, "{not json}", "text"),
]


@query(rows("id tipo", *[(i, k) for i, _, k in _KINDS]))
def t27_kinds(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t, _ in _KINDS], "id int, t string").select("id", K.content_kind("t").alias("k")).select("id", F.col("k.tipo").alias("tipo"))


@query("SELECT doc_id, md5(text) AS marca, true AS curto FROM documents WHERE text IS NOT NULL UNION ALL SELECT id, md5(content), true FROM skills WHERE content IS NOT NULL")
def t29_folded(spark: SparkSession, d: str) -> DataFrame:
    """Every document and skill folded and unfolded again, and whether the folded text is no longer."""
    t = load(spark, d, "documents").select("doc_id", "text").unionByName(load(spark, d, "skills").select(F.col("id").alias("doc_id"), F.col("content").alias("text"))).where("text IS NOT NULL")
    f = t.withColumn("f", K.fold_text("text"))
    return f.select("doc_id", F.md5(K.unfold_text(F.col("f.texto"), F.col("f.dobras"))).alias("marca"), (F.length("f.texto") <= F.length("text")).alias("curto"))


_BLOCK = "alfa e mais\nbeta e mais\ngama e mais\ndelta e mais"


@query(rows("id texto dobras", (1, "a\n... (repeated 3 times)\nb", ["runs"]), (2, f"{_BLOCK}\nx\n... (repeats 4 lines from 5 lines back)", ["blocks"]), (3, "src/longo.py:\n  1:x\n  22:y\nz", ["files"]), (4, "a\nb", []), (5, None, None)))
def t29_literal_folds(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, "a\na\na\nb".replace("a", "a" * 20)), (2, f"{_BLOCK}\nx\n{_BLOCK}"), (3, "src/longo.py:1:x\nsrc/longo.py:22:y\nz"), (4, "a\nb"), (5, None)]
    return spark.createDataFrame(t, "id int, t string").select("id", K.fold_text("t").alias("f")).select("id", F.replace("f.texto", F.lit("a" * 20), F.lit("a")).alias("texto"), "f.dobras")


@query("SELECT count(*) AS textos, true AS menor FROM documents WHERE text IS NOT NULL")
def t28_routed(spark: SparkSession, d: str) -> DataFrame:
    """All documents in the short form of their kind; none costs more than before."""
    r = K.routed(load(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return r.agg(F.count("*").alias("textos"), F.min(F.col("depois") <= F.col("antes")).alias("menor"))


_OUT = "\x1b[31mred\x1b[0m line\nnoise 1\nkeep a\nkeep b that is long enough\nnoise 2\nkeep c\nkeep d"


@query(rows("id saida", (1, "red line\nkeep a\n... (2 lines omitted)\nkeep d"), (2, "keep a\nkeep ..."), (3, "all good"), (4, "nothing"), (5, "... (5 lines omitted)\nkeep c\nkeep d"), (6, "RED line\n... (6 lines truncated)")))
def t41_filters(spark: SparkSession, d: str) -> DataFrame:
    """Each stage of the output filters on one output."""
    df = spark.createDataFrame([(i, _OUT) for i in range(1, 7)], "id int, t string")
    c = F.col("t")
    of = {
        1: K.output_filter(c, strip_ansi=True, strip=("^noise",), head_lines=2, tail_lines=1), 2: F.slice(F.split(K.output_filter(c, keep=("^keep [ab]",), truncate_lines_at=8), "\n"), 1, 2), 3: K.output_filter(c, match_output=(("boom", "bad", None), ("red", "all good", "missing"))),
        4: K.output_filter(c, keep=("^zzz",), on_empty="nothing"), 5: K.output_filter(c, tail_lines=2), 6: K.output_filter(c, strip_ansi=True, replace=(("^red", "RED"),), max_lines=1),
    }
    out = F.lit(None).cast("string")
    for i, x in of.items():
        out = F.when(F.col("id") == i, F.array_join(x, "\n") if i == 2 else x).otherwise(out)
    return df.select("id", out.alias("saida"))


@query("WITH e AS (SELECT user_id, event_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN a = 1 THEN 0 WHEN z = 1 THEN 1 ELSE 2 END, value DESC, event_id) AS k FROM e) SELECT user_id, event_id FROM r WHERE k <= 10")
def k10_first_last_best(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's events the first, the last and the greatest, ten in all."""
    return K.first_last_best(load(spark, d, "events"), ["user_id"], "event_id", "value", 10).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k <= 5 OR event_type = 'error'")
def k11_best_and_pinned(spark: SparkSession, d: str) -> DataFrame:
    """Five greatest of each user and all errors."""
    return K.best_and_pinned(load(spark, d, "events"), ["user_id"], "event_id", "value", 5, F.col("event_type") == "error").select("user_id", "event_id")


@query(rows("linha nivel pilha resumo nota:DOUBLE", (0, "info", False, False, 0.1), (1, "error", False, False, 1.0), (2, "unknown", True, False, 0.4), (3, "unknown", True, False, 0.4), (4, "warn", False, False, 0.5), (5, "fail", False, True, 1.0), (6, "debug", False, False, 0.05), (7, "unknown", False, False, 0.1)))
def t30_scored_lines(spark: SparkSession, d: str) -> DataFrame:
    log = "INFO start\nERROR boom\nTraceback (most recent call last)\n  File \"a.py\", line 3, in f\nwarning: old\n=== 2 failed, 3 passed ===\ndebug x\nplain"
    return K.log_lines(spark.createDataFrame([(1, log)], "id int, t string"), "id", "t").select("linha", "nivel", "pilha", "resumo", F.round(F.col("nota").cast("double"), 6).alias("nota"))


_HITS = "\n".join([*(f"src/a.py:{i}:linha {i}" for i in range(1, 9)), "src/a.py:9:an error in cache", "src/b.py-3-cache de notas", "lixo sem lugar", "src/c.py:1:nada"])


@query(rows("arquivo linha nota:DOUBLE omitidas:BIGINT", ("src/a.py", 1, 0.0, 6), ("src/a.py", 9, 0.8, 6), ("src/a.py", 2, 0.0, 6), ("src/b.py", 3, 0.3, 0)))
def t31_matches(spark: SparkSession, d: str) -> DataFrame:
    """Two files of three, three matches each: the first, the last, the best."""
    m = K.scored_matches(K.search_matches(spark.createDataFrame([(1, _HITS)], "id int, t string"), "id", "t"), "o cache")
    return K.chosen_matches(m, "id", 2, 3).select("arquivo", "linha", F.round(F.col("nota").cast("double"), 6).alias("nota"), "omitidas")


_DIFF = "diff --git a/x.py b/x.py\nindex 12ab..34cd 100644\n--- a/x.py\n+++ b/x.py\n" + "".join(f"@@ -{i},7 +{i},7 @@\n c1\n c2\n c3\n-old {i}\n+new {i}{' with a timeout' if i == 20 else ''}\n c4\n c5\n c6\n" for i in (10, 20, 30, 40)) + "diff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n-a\n+b"


@query(rows("arquivo trecho:BIGINT nota:DOUBLE linhas:BIGINT", ("x.py", 1, 0.02, 7), ("x.py", 2, 0.52, 7), ("x.py", 4, 0.02, 7), ("y.py", 5, 0.02, 3)))
def t53_hunks(spark: SparkSession, d: str) -> DataFrame:
    """The first, the last and the best of four hunks, each with its head, its changes and two lines around them."""
    h = K.chosen_hunks(K.diff_hunks(spark.createDataFrame([(1, _DIFF)], "id int, t string"), "id", "t"), "id", "a timeout", 3)
    return h.groupBy("arquivo", "trecho", "nota").agg(F.count("*").alias("linhas"))


@query("SELECT id, md5(content) AS marca FROM skills")
def t40_recalled(spark: SparkSession, d: str) -> DataFrame:
    """Skills by their marks, and back from the store."""
    s = load(spark, d, "skills")
    store = K.stored(s, "content")
    return K.recalled(s.select("id", F.substring(F.md5("content"), 1, 24).alias("marca")), store).select("id", F.md5("texto").alias("marca"))


@query("SELECT source_repo, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS pasta, count(DISTINCT regexp_extract(rel_path, '[^/]*$')) AS n, string_agg(DISTINCT regexp_extract(rel_path, '[^/]*$'), ' ' ORDER BY regexp_extract(rel_path, '[^/]*$')) AS nomes FROM skills WHERE rel_path IS NOT NULL GROUP BY 1, 2")
def t61_folded_paths(spark: SparkSession, d: str) -> DataFrame:
    return K.folded_paths(load(spark, d, "skills"), "source_repo", "rel_path")


@query(rows("id saida", (1, "12L 34W 56B a/b.txt\n1L 2W 3B total"), (2, "7L"), (3, "wc: x: No such file")))
def t62_counts(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, "  12  34  56 a/b.txt\n 1 2 3 total"), (2, "7"), (3, "wc: x: No such file")]
    df = spark.createDataFrame(t, "id int, t string")
    return df.select("id", F.when(F.col("id") == 2, K.count_output(F.col("t"), "l")).otherwise(K.count_output(F.col("t"))).alias("saida"))


# JSON arrays

def _arrays(spark: SparkSession) -> DataFrame:
    """Six arrays: numbered events with a level shift, scored results, unique entities, logs, a short one, and one of repeated content."""
    a = {
        "series": [{"ts": f"2025-01-{1 + i // 24:02d}T{i % 24:02d}:00:00", "v": 9.0 if 30 <= i < 35 else 0.0} for i in range(65)],
        "results": [{"title": f"titulo {i % 4}", "score": round(1 - i / 50, 3)} for i in range(30)],
        "entities": [{"id": f"{i:08x}-1234-4abc-8def-{i:012x}", "name": f"nome {'abcdefghij'[i % 10]}{i}"} for i in range(20)],
        "logs": [{"message": f"uma mensagem comprida de registro {i % 5}", "trace": f"um caminho unico e comprido de numero {i}", "level": "info" if i % 20 else "error", "n": i} for i in range(60)],
        "short": [{"a": 1}, {"a": 2}],
        "same": [{"k": i, "s": "igual", "t": "mesmo"} for i in range(40)] + [{"k": 40, "s": "igual", "t": "mesmo", "odd": "error here"}],
    }
    return spark.createDataFrame([(g, i, json.dumps(x)) for g, xs in a.items() for i, x in enumerate(xs)], "grp string, pos int, item string")


@query("""WITH e AS (SELECT s.span_id, unnest(json_keys(metadata_json)) AS chave, metadata_json AS m, name FROM spans s WHERE metadata_json IS NOT NULL AND name IS NOT NULL), v AS (SELECT name, chave, json_extract(m, '$.' || chave) AS j, json_extract_string(m, '$.' || chave) AS t, json_type(m, '$.' || chave) AS k FROM e),
n AS (SELECT name, count(*) AS n FROM spans WHERE metadata_json IS NOT NULL AND json_type(metadata_json) = 'OBJECT' AND name IS NOT NULL GROUP BY name)
SELECT name AS grp, chave, n, count(DISTINCT j) + CASE WHEN n > count(*) THEN 1 ELSE 0 END AS unicos, min(TRY_CAST(t AS DOUBLE)) AS menor, max(TRY_CAST(t AS DOUBLE)) AS maior, round(avg(TRY_CAST(t AS DOUBLE)), 4) AS media, round(coalesce(var_samp(TRY_CAST(t AS DOUBLE)), 0), 4) AS variancia FROM v JOIN n USING (name) GROUP BY name, chave, n""")
def a19_span_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of the metadata of each span name's rows."""
    s = load(spark, d, "spans").where("metadata_json IS NOT NULL AND name IS NOT NULL").select(F.col("name").alias("grp"), F.monotonically_increasing_id().alias("pos"), F.col("metadata_json").alias("item"))
    p = J.field_profile(s)
    return p.select("grp", "chave", "n", "unicos", "menor", "maior", F.round("media", 4).alias("media"), F.round("variancia", 4).alias("variancia"))


@query(rows("chave tipo n:BIGINT unicos:BIGINT constante valor_constante tamanho:DOUBLE", ("a", "numeric", 5, 3, False, None, None), ("b", "string", 5, 1, True, "x", 1.0), ("c", "boolean", 5, 2, False, None, None), ("d", "null", 5, 0, True, None, None), ("e", "array", 5, 2, False, None, None)))
def a19_literal_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mixed values, a constant, a key that is missing, one that is always null, an array."""
    i = ['{"a": 1, "b": "x", "d": null}', '{"a": 2, "b": "x", "c": true}', '{"a": "z", "b": "x"}', '{"a": 1, "b": "x", "e": [1, 2]}', '{"a": 1, "b": "x"}', "7"]
    df = spark.createDataFrame([("g", k, x) for k, x in enumerate(i)], "grp string, pos int, item string")
    return J.field_profile(df).select("chave", "tipo", "n", "unicos", "constante", "valor_constante", "tamanho")


@query(rows("grp chave id_conf:DOUBLE score_conf:DOUBLE", ("entities", "id", 0.95, 0.0), ("entities", "name", 0.8, 0.0), ("logs", "n", 0.9, 0.0), ("logs", "trace", 0.8, 0.0), ("results", "score", 0.85, 0.8), ("same", "k", 0.9, 0.0)))
def t37_roles(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the literal arrays that are identifiers or scores."""
    i = _arrays(spark).where("grp NOT IN ('series', 'short')")
    e = J.entries(i)
    r = J.field_roles(i, e, J.field_profile(i, e)).where("id_conf > 0 OR score_conf > 0")
    return r.select("grp", "chave", "id_conf", "score_conf")


@query(rows("grp padrao estrategia", ("series", "time_series", "time_series"), ("results", "search_results", "top_n"), ("entities", "generic", "skip"), ("logs", "logs", "cluster_sample"), ("short", "generic", "none"), ("same", "generic", "smart_sample")))
def t33_strategies(spark: SparkSession, d: str) -> DataFrame:
    return J.strategies(_arrays(spark)).select("grp", "padrao", "estrategia")


@query(rows("grp todas", ("series", False), ("results", False), ("entities", True), ("logs", False), ("short", True), ("same", False)))
def t33_crushed(spark: SparkSession, d: str) -> DataFrame:
    """Which of the literal arrays are kept whole."""
    i = _arrays(spark)
    n = i.groupBy("grp").agg(F.count("*").alias("n"))
    return J.crushed(i).groupBy("grp").agg(F.count("*").alias("k")).join(n, "grp").select("grp", (F.col("k") == F.col("n")).alias("todas"))


@query(rows("grp pos:BIGINT motivo", ("same", 40, "forma"), ("series", 30, "anomalia"), ("series", 28, "mudanca"), ("results", 0, "melhor")))
def t36_kept_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Why the rare shape, the spike, the change before it and the best result are kept."""
    k = J.crushed(_arrays(spark))
    want = spark.createDataFrame([("same", 40), ("series", 30), ("series", 28), ("results", 0)], "grp string, pos long")
    return k.join(F.broadcast(want), ["grp", "pos"]).select("grp", "pos", "motivo")


@query(rows("grp n:BIGINT unicos:BIGINT k", ("all", 8, 8, 8), ("one", 20, 1, 3)))
def t38_adaptive_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Eight items stay; of twenty equal ones the least number does."""
    i = [("all", k, w) for k, w in enumerate(["sol nascente", "mar revolto", "fila parada", "porta aberta", "cofre fechado", "grafo denso", "vento frio", "livro raro"])] + [("one", k, "sempre o mesmo item de texto") for k in range(20)]
    return J.adaptive_sizes(spark.createDataFrame(i, "grp string, pos int, item string")).select("grp", "n", "unicos", "k")


@query(rows("grp pos:BIGINT", *[("a", p) for p in (0, 1, 2, 3, 4, 50, 96, 97, 98, 99)], *[("b", p) for p in (0, 1, 2)]))
def t39_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Ten anchors of a hundred items: five, one and four; and three of three."""
    return J.anchors(spark.createDataFrame([("a", 100, 40, "generic"), ("b", 3, 3, "generic")], "grp string, n long, k int, padrao string"))


_TAB = ['{"b": "x, y", "a": 1}', '{"a": 2.5, "b": "say \\"hi\\""}', '{"a": null, "b": ""}', '{"a": 3, "c": [1, 2]}', "5"]


@query(rows("linha:BIGINT texto", (0, "a:numeric,b:string,c:array"), (1, '1,"x, y",'), (2, '2.5,"say ""hi""",'), (3, ',"",'), (4, '3,,"[1,2]"')))
def t35_csv(spark: SparkSession, d: str) -> DataFrame:
    return J.as_table(spark.createDataFrame([("g", i, x) for i, x in enumerate(_TAB)], "grp string, pos int, item string")).select("linha", "texto")


@query(rows("linha:BIGINT texto", (0, "| a | b |\n| --- | --- |"), (1, "| 1 | x\\|y |"), (2, "| 2 |  |")))
def t35_markdown(spark: SparkSession, d: str) -> DataFrame:
    i = ['{"a": 1, "b": "x|y"}', '{"a": 2}']
    return J.as_table(spark.createDataFrame([("g", k, x) for k, x in enumerate(i)], "grp string, pos int, item string"), "markdown").select("linha", "texto")


@query(rows("linha:BIGINT texto", (0, "a b"), (1, "- a: 1\n- b: x"), (2, "- a: 2")))
def t35_key_values(spark: SparkSession, d: str) -> DataFrame:
    i = ['{"a": 1, "b": "x"}', '{"a": 2}']
    return J.as_table(spark.createDataFrame([("g", k, x) for k, x in enumerate(i)], "grp string, pos int, item string"), "kv").select("linha", "texto")


@query("""WITH o AS (SELECT name AS grp, unnest(json_keys(metadata_json)) AS chave, span_id, metadata_json FROM spans WHERE name IS NOT NULL AND metadata_json IS NOT NULL), n AS (SELECT grp, chave, count(*) AS n FROM o GROUP BY ALL)
SELECT grp, chave, CAST(row_number() OVER (PARTITION BY grp ORDER BY n DESC, chave) AS INT) AS ordem, n FROM n""")
def t34_table_columns(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "spans").where("metadata_json IS NOT NULL AND name IS NOT NULL").select(F.col("name").alias("grp"), F.monotonically_increasing_id().alias("pos"), F.col("metadata_json").alias("item"))
    return J.table_columns(s)


@query("WITH s AS (SELECT name AS grp, metadata_json AS item FROM spans WHERE metadata_json IS NOT NULL AND name IS NOT NULL) SELECT grp, CAST(sum(octet_length(encode(item)) + 1) + 1 AS BIGINT) AS antes, true AS vale FROM s GROUP BY grp HAVING count(*) > 5")
def t54_worthwhile_tables(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of spans as tables: of names with over five rows every table saves more than it must."""
    s = load(spark, d, "spans").where("metadata_json IS NOT NULL AND name IS NOT NULL").select(F.col("name").alias("grp"), F.monotonically_increasing_id().alias("pos"), F.col("metadata_json").alias("item"))
    many = s.groupBy("grp").agg(F.count("*").alias("n")).where("n > 5").select("grp")
    return J.worth_it(s, J.as_table(s)).join(many, "grp", "left_semi").select("grp", F.col("antes").cast("long").alias("antes"), "vale")


@query(rows("grp especie n:BIGINT", ("1", "object", 5), ("2.xs", "number", 6), ("2.ys", "mixed", 5), ("3", "string", 5)))
def t54_walked(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, json.dumps([{"a": i} for i in range(5)])), (2, json.dumps({"xs": [1, 2.5, 3, 4, 5, 6], "ys": [1, "a", None, 2, 3], "short": [1], "z": 5})), (3, json.dumps(list("abcde"))), (4, "no json"), (5, None)]
    return J.walked_arrays(spark.createDataFrame(t, "id int, t string"), "id", "t").groupBy("grp", "especie").agg(F.count("*").alias("n"))
