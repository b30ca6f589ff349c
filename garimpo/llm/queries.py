"""Queries of the problems tagged llm over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import garbled, mixing, neardup, neighbors, percentiles, split, tokens
from garimpo.runtime import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.neighbors(load(spark, d, "chunks"), "col", "rid", "vec", k=5, least=0.90)
    return near.select(F.least("r", "vizinho").alias("rid_a"), F.greatest("r", "vizinho").alias("rid_b")).distinct()


def p1_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar vectors of every usable vector."""
    return neighbors.neighbors(load(spark, d, "chunks"), "col", "rid", "vec", k=5, rerank=None, cell=neighbors.WIDE_CELL, probes=None).select(F.col("r").alias("rid"), "vizinho", "cos", "ordem")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(load(spark, d, "chunks"), "rid", "id", "doc").withColumnRenamed("chave", "rid")


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Length and mark of every text as its pieces give it back."""
    t = split.rejoined(split.split_texts(load(spark, d, "chunks"), "rid", "id", "doc"))
    return t.select(F.col("chave").alias("rid"), F.length("texto").alias("n"), F.md5("texto").alias("marca"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_texts(load(spark, d, "chunks"), "rid", "id", "doc")
    return split.oversized(pieces).withColumnRenamed("chave", "rid")


def _similar(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates([("skills", load(spark, d, "skills"), "id", "content"), ("chunks", load(spark, d, "chunks"), "rid", "doc")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).pairs()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).groups()


QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _measured(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str, str, str]]:
    return [
        (load(spark, d, "spans"), "spans", "name", "duration_ms", "started_at"),
        (load(spark, d, "chamadas"), "chamadas", "ferramenta", "segundos", "em"),
    ]


def _days(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.day_sketches(_measured(spark, d))


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per name and tool over all days, from the days' sketches."""
    return percentiles.percentiles(percentiles.merge(_days(spark, d), False), QUANTILES).drop("dia")


def p7_daily(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per name and tool of each day."""
    return percentiles.percentiles(_days(spark, d), QUANTILES)


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact ranks of all reported percentiles lie within the stated bounds."""
    return percentiles.checked(_measured(spark, d), QUANTILES)


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Mark of every document's text as its ids give it back."""
    t = tokens.decode_table(p8_ids(spark, d), "doc_id")
    return t.select("doc_id", F.md5("texto").alias("marca"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_table(load(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "pesos_fontes"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "pesos_fontes"))[1]


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source, whether no text is used too often and its share is within two blocks and texts of its target."""
    uses, shares = mixing.mix(load(spark, d, "documents"), load(spark, d, "pesos_fontes"))
    caps = load(spark, d, "pesos_fontes").select(mixing.source_key(F.col("source")).alias("fonte"), "max_rep")
    worst = uses.groupBy("fonte", "doc_id").agg(F.count("*").alias("n"), F.max("n_tokens").alias("t")).groupBy("fonte").agg(F.max("n").alias("n"), F.max("t").alias("t"))
    total = shares.agg(F.sum("tokens").alias("total"))  # one row
    j = shares.join(caps, "fonte").join(worst, "fonte", "left").join(F.broadcast(total))
    near = F.abs(F.col("alcancado") - F.col("alvo")) * F.col("total") <= 2 * (mixing.BLOCK + F.coalesce("t", F.lit(0)))
    return j.select("fonte", (F.coalesce("n", F.lit(0)) <= F.col("max_rep")).alias("teto"), F.coalesce(near, F.lit(True)).alias("alvo"))


#: Literal texts and what misread them: (id, original, written in, read as); a null encoding is a text that was read right.
MISREAD = [
    (1, "Não há razão: a coração já é grande", "utf-8", "cp1252"), (2, "größer als früher", "utf-8", "cp850"), (3, "l’été déjà passé", "utf-8", "mac_roman"),
    (4, "¿Dónde está el señor Núñez?", "utf-8", "cp1251"), (5, "coração à mão", "utf-8", "cp437"), (6, "a caixa não abriu", None, None), (7, "MAÇÃ, Ã e Â", None, None), (8, "naïve “quotes” — 20°", None, None),
]


def p10_literals(spark: SparkSession, d: str) -> DataFrame:
    """Literal misread texts, which must come back, among texts that were read right."""
    read = lambda t, w, r: t if w is None else t.encode(w).decode(r, "replace" if r == "cp1252" else "strict")
    df = spark.createDataFrame([(i, read(t, w, r)) for i, t, w, r in MISREAD], "doc_id int, text string")
    return garbled.repaired(df, "doc_id", "text").select(F.col("chave").alias("doc_id"), "restaurado")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(load(spark, d, "documents"), "doc_id", "text").withColumnRenamed("chave", "doc_id")


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    return garbled.repaired(load(spark, d, "documents"), "doc_id", "text").withColumnRenamed("chave", "doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_neighbors": p1_neighbors,
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rejoined": p2_rejoined,
    "p6_found": p6_found, "p6_groups": p6_groups,
    "p7_percentiles": p7_percentiles, "p7_daily": p7_daily, "p7_checked": p7_checked,
    "p8_ids": p8_ids, "p8_decoded": p8_decoded,
    "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_checked": p9_checked,
    "p10_found": p10_found, "p10_repaired": p10_repaired, "p10_literals": p10_literals,
}

_GOOD = "vec IS NOT NULL AND len(vec) = usual AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) AND list_bool_or(list_transform(vec, lambda x: x <> 0))"
#: All pairs, exactly: for the small tables only.
_SIMILAR = """WITH t AS (SELECT 'skills' AS tabela, id AS r, content AS x FROM skills UNION ALL SELECT 'chunks', rid, doc FROM chunks),
w AS (SELECT tabela, r, regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+') AS w FROM t WHERE x IS NOT NULL AND r IS NOT NULL),
s AS (SELECT DISTINCT tabela, r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT tabela, r, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT x.tabela, x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.tabela = y.tabela AND x.g = y.g AND x.r < y.r GROUP BY ALL),
p AS (SELECT c.tabela, a, b FROM c JOIN n na ON na.tabela = c.tabela AND na.r = a JOIN n nb ON nb.tabela = c.tabela AND nb.r = b WHERE c >= 0.6 * (na.n + nb.n - c))
"""

ORACLE = {
    "p1_found": f"""WITH l AS (SELECT col, len(vec) AS l, count(*) AS n FROM chunks WHERE len(vec) > 0 AND col IS NOT NULL AND rid IS NOT NULL GROUP BY ALL), u AS (SELECT col, max_by(l, n * 1000000 + l) AS usual FROM l GROUP BY col),
v AS (SELECT col, rid, vec::DOUBLE[] AS v FROM chunks JOIN u USING (col) WHERE rid IS NOT NULL AND {_GOOD}),
s AS (SELECT a.rid AS r, b.rid AS o, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.col = b.col AND a.rid <> b.rid),
k AS (SELECT r, o FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c DESC, o) AS k FROM s WHERE c >= 0.90) WHERE k <= 5)
SELECT DISTINCT least(r, o) AS rid_a, greatest(r, o) AS rid_b FROM k""",
    "p2_rejoined": "SELECT rid, CAST(length(doc) AS INT) AS n, md5(doc) AS marca FROM chunks",
    "p6_found": _SIMILAR + "SELECT tabela, a, b FROM p",
    "p7_checked": "".join(f"""{u}SELECT '{t}' AS tabela, {g} AS grupo, count(*) AS n, true AS dentro FROM (SELECT DISTINCT * FROM {t}) WHERE {v} >= 0 AND NOT isnan({v}) AND NOT isinf({v}) GROUP BY {g}""" for u, t, g, v in [("", "spans", "name", "duration_ms"), (" UNION ALL ", "chamadas", "ferramenta", "segundos")]),
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS marca FROM documents",
    "p9_checked": "SELECT lower(trim(source, E' \\t\\r\\n')) AS fonte, true AS teto, true AS alvo FROM pesos_fontes",
    "p10_literals": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t, w, _ in MISREAD if w) + ") x(doc_id, restaurado)",
    "p2_found": "SELECT rid, CASE WHEN list_max(list_transform(regexp_split_to_array(doc, '[ \\t\\r\\n]'), lambda x: length(x))) > 3072 THEN 'forcado' ELSE 'natural' END AS corte FROM chunks WHERE length(doc) > 3072",
}
