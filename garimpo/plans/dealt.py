"""Queries of the general problems 3, 4 and 5 over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions.text import outer_trim
from garimpo.operators.changes import apply_changes, latest_changes, rebuild
from garimpo.operators.orphans import Children, Parents, orphan_references, orphan_report
from garimpo.operators.wide import COLUMN_TYPES, columns_of, compact, filled_cells, merge_runs, to_deltas, wide_table
from garimpo.runtime import checkpoint, load


def references(spark: SparkSession, d: str) -> DataFrame:
    """All orphan references of the project's tables."""
    t = {n: load(spark, d, n) for n in ("dag_runs", "dag_step_runs", "consultas", "devolvidas", "aberturas", "chunks", "mudancas")}
    run, query = F.lower(outer_trim(F.col("run_id"))), F.when(F.col("consulta") > 0, F.col("consulta"))
    last = latest_changes(t["mudancas"], ["rid"], arrived="chegou_em")
    return orphan_references(
        [
            Parents(t["dag_runs"], "dag_runs", run, F.coalesce(F.lower(outer_trim(F.col("status"))) != "deleted", F.lit(True))),
            Parents(t["consultas"], "consultas", F.col("id")),
            Parents(t["chunks"], "chunks", F.col("rid")),
        ],
        [
            Children(t["dag_step_runs"], "dag_step_runs", "dag_runs", run, F.col("chegou_em")),
            Children(t["devolvidas"], "devolvidas", "consultas", query, F.col("chegou_em")),
            Children(t["aberturas"], "aberturas", "consultas", query, F.col("chegou_em")),
            Children(last.where(F.col("op") == "u"), "mudancas", "chunks", F.col("rid"), F.col("chegou_em")),
        ],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references(spark, d).select("tabela", "ref", "periodo")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(references(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return apply_changes(load(spark, d, "mudancas"), ["col", "rid"])


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """``chunks`` after all changes, whole rows, with what became of each; texts and vectors as marks."""
    r = rebuild(load(spark, d, "mudancas"), ["col", "rid"], load(spark, d, "chunks").select("col", "rid", "id", "doc", "meta"))
    return r.select("col", "rid", "id", F.md5("doc").alias("doc"), F.md5("meta").alias("meta"), "situacao")


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same changes merged into ``chunks`` as the base."""
    return apply_changes(load(spark, d, "mudancas"), ["col", "rid"], base=load(spark, d, "chunks"))


def compacted_facts(spark: SparkSession, d: str) -> DataFrame:
    """One delta a month of ``data``; deltas are merged into written runs of years, and these into one."""
    deltas = to_deltas(load(spark, d, "fatos"), "sujeito", "atributo", "valor", ["data", "nota"], F.substring("data", 1, 7))
    years = checkpoint(merge_runs(deltas, F.substring("lote", 1, 4)))
    return compact(years)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_cells(compacted_facts(spark, d))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity: a column for each attribute that has a type of its own, all other filled cells as text in ``outras``.

    The set of attributes is open, so a fixed schema holds the others as ``column=value`` lines; ``p5_wide_all`` gives each a column.
    """
    typed = list(COLUMN_TYPES)
    w = wide_table(compacted_facts(spark, d), typed, rest="outras")
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("outras"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    return w.select("entidade", *typed, lines.alias("outras"))


def p5_wide_all(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity, one typed column for every attribute there is."""
    c = checkpoint(compacted_facts(spark, d))
    return wide_table(c, columns_of(c))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_merged": p4_merged, "p4_rebuilt": p4_rebuilt, "p5_found": p5_found, "p5_wide": p5_wide, "p5_wide_all": p5_wide_all}

_LAST = """
mud AS (SELECT col, rid, seq, chegou_em, lower(trim(op, E' \\t\\r\\n')) AS op FROM mudancas WHERE seq IS NOT NULL AND rid IS NOT NULL),
valid AS (SELECT * FROM mud WHERE op IN ('u', 'd')),
"""
_REFS = f"""
WITH {_LAST}
ranked AS (SELECT rid, op, chegou_em, row_number() OVER (PARTITION BY rid ORDER BY seq DESC, op, chegou_em NULLS LAST) AS k FROM valid),
runs AS (SELECT DISTINCT lower(trim(run_id, E' \\t\\r\\n')) AS k FROM dag_runs WHERE run_id IS NOT NULL AND coalesce(lower(trim(status, E' \\t\\r\\n')) <> 'deleted', true)),
refs AS (
  SELECT 'dag_step_runs' AS tabela, lower(trim(run_id, E' \\t\\r\\n')) AS ref, chegou_em FROM dag_step_runs
   WHERE run_id IS NOT NULL AND lower(trim(run_id, E' \\t\\r\\n')) NOT IN (SELECT k FROM runs)
  UNION ALL SELECT 'devolvidas', CAST(consulta AS VARCHAR), chegou_em FROM devolvidas WHERE consulta > 0 AND consulta NOT IN (SELECT id FROM consultas WHERE id IS NOT NULL)
  UNION ALL SELECT 'aberturas', CAST(consulta AS VARCHAR), chegou_em FROM aberturas WHERE consulta > 0 AND consulta NOT IN (SELECT id FROM consultas WHERE id IS NOT NULL)
  UNION ALL SELECT 'mudancas', CAST(rid AS VARCHAR), chegou_em FROM ranked WHERE k = 1 AND op = 'u' AND rid NOT IN (SELECT rid FROM chunks WHERE rid IS NOT NULL)
)
"""
_STATE = f"""
WITH {_LAST}
ranked AS (SELECT col, rid, op, row_number() OVER (PARTITION BY col, rid ORDER BY seq DESC, op) AS k FROM valid)
"""


def _key(c: str) -> str:
    # strip_accents leaves compatibility forms; the tables' keys hold none
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9.]+', '_', 'g'), '_.')"


_CELLS = f"""
WITH k AS (SELECT {_key("sujeito")} AS entidade, {_key("atributo")} AS coluna, data, nota, valor FROM fatos),
r AS (SELECT *, row_number() OVER (PARTITION BY entidade, coluna ORDER BY data DESC NULLS LAST, nota DESC NULLS LAST, valor DESC NULLS LAST) AS n FROM k WHERE entidade <> '' AND coluna <> ''),
v AS (SELECT entidade, coluna, valor, trim(valor, E' \\t\\r\\n') AS t FROM r WHERE n = 1),
c AS (SELECT entidade, coluna, CASE
  WHEN coluna IN ('port', 'setting_timeout_ms', 'setting_workers') THEN
    CASE WHEN len(regexp_extract_all(valor, '[0-9]+')) = 1 THEN regexp_replace(regexp_extract(valor, '[0-9]+'), '^0+([0-9])', '\\1') END
  WHEN coluna IN ('setting_enabled', 'setting_cache') THEN
    CASE WHEN lower(t) IN ('true', 'yes', 'on', 'sim', '1') THEN 'true' WHEN lower(t) IN ('false', 'no', 'off', 'não', 'nao', '0') THEN 'false' END
  WHEN coluna = 'setting_temperature' THEN
    CASE WHEN regexp_full_match(t, '[0-9]+([.,][0-9]{{1,2}})?') THEN printf('%.2f', CAST(replace(t, ',', '.') AS DOUBLE)) END
  ELSE nullif(trim(valor, E' \\t\\r\\n`"''*'), '') END AS valor FROM v)
"""
ORACLE = {
    "p3_found": _REFS + "SELECT DISTINCT tabela, ref, strftime(chegou_em, '%Y-%m') AS periodo FROM refs",
    "p3_report": _REFS + "SELECT tabela, strftime(chegou_em, '%Y-%m') AS periodo, count(DISTINCT ref) AS refs, CAST(count(*) AS BIGINT) AS linhas FROM refs GROUP BY 1, 2",
    "p4_found": _STATE + "SELECT col, rid FROM ranked WHERE k = 1 AND op = 'u'",
    "p4_merged": _STATE + """, keys AS (SELECT col, rid FROM ranked WHERE k = 1 AND op = 'u' UNION SELECT col, rid FROM chunks)
SELECT col, rid FROM keys WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.k = 1 AND r.op = 'd' AND r.rid = keys.rid AND r.col IS NOT DISTINCT FROM keys.col)""",
    "p5_found": _CELLS + "SELECT entidade, coluna, valor FROM c WHERE valor IS NOT NULL",
    "p4_rebuilt": _STATE + """, l AS (SELECT * FROM ranked WHERE k = 1)
SELECT coalesce(c.col, l.col) AS col, coalesce(c.rid, l.rid) AS rid, id, md5(doc) AS doc, md5(meta) AS meta, CASE WHEN c.rid IS NULL THEN 'nova' WHEN l.op IS NULL THEN 'mantida' ELSE 'alterada' END AS situacao
FROM chunks c FULL JOIN l ON c.rid = l.rid AND c.col IS NOT DISTINCT FROM l.col WHERE coalesce(l.op, 'u') = 'u'""",
    "p5_wide": _CELLS + """SELECT entidade, CAST(max(valor) FILTER (coluna = 'port') AS DECIMAL(38, 0)) AS port, CAST(max(valor) FILTER (coluna = 'setting_timeout_ms') AS DECIMAL(38, 0)) AS setting_timeout_ms,
CAST(max(valor) FILTER (coluna = 'setting_workers') AS DECIMAL(38, 0)) AS setting_workers, CAST(max(valor) FILTER (coluna = 'setting_enabled') AS BOOLEAN) AS setting_enabled, CAST(max(valor) FILTER (coluna = 'setting_cache') AS BOOLEAN) AS setting_cache,
CAST(max(valor) FILTER (coluna = 'setting_temperature') AS DECIMAL(38, 2)) AS setting_temperature,
coalesce(string_agg(coluna || '=' || valor, E'\\n' ORDER BY coluna || '=' || valor) FILTER (valor IS NOT NULL AND coluna NOT IN ('port', 'setting_timeout_ms', 'setting_workers', 'setting_enabled', 'setting_cache', 'setting_temperature')), '') AS outras
FROM c GROUP BY entidade""",
}
