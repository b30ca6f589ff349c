"""Queries of the graph operators: on literal graphs with answers worked out by hand, and over whole tables with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions.text import fold_latin
from garimpo.operators import codegraph as C
from garimpo.operators import dedup as D
from garimpo.operators import graph as G
from garimpo.operators.notes import latest_wins
from garimpo.operators.resolution import remap_edges, resolve
from garimpo.plans.registry import registry, rows
from garimpo.runtime import load

QUERIES, ORACLE, query = registry()

#: A file with two functions, a fusion with its reason, a search with its test, and a concept without a file.
NODES = [
    ("arq_indice", "indice.py", "src/indice.py", "L1", "code", 0), ("gravar", "gravar_indice()", "src/indice.py", "L10", "code", 0), ("ler", "ler_indice()", "src/indice.py", "L40", "code", 0),
    ("fusao", "FusaoRRF", "src/fusao.py", "L5", "code", 1), ("rrf", "rrf()", "src/fusao.py", "L20", "code", 1), ("busca", "buscar()", "src/busca.py", "L3", "code", 1),
    ("t_busca", "test_buscar_rrf()", "tests/test_busca.py", "L8", "code", 2), ("porque", "Por que RRF e nao soma", "src/fusao.py", "L21", "rationale", 1), ("solto", "Conceito solto", "", None, "concept", 3),
]
#: The last edge begins at a node that is not there.
EDGES = [
    ("arq_indice", "gravar", "contains", "EXTRACTED"), ("arq_indice", "ler", "contains", "EXTRACTED"), ("busca", "rrf", "calls", "EXTRACTED"), ("busca", "ler", "calls", "INFERRED"), ("fusao", "rrf", "calls", "EXTRACTED"),
    ("t_busca", "busca", "calls", "EXTRACTED"), ("gravar", "ler", "calls", "EXTRACTED"), ("porque", "rrf", "rationale_for", "EXTRACTED"), ("fusao", "gravar", "references", "AMBIGUOUS"), ("x", "rrf", "calls", "EXTRACTED"),
]


def nodes_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NODES, "id string, label string, source_file string, source_location string, file_type string, community int")


def edges_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "source string, target string, relation string, confidence string")


def members_of(spark: SparkSession) -> DataFrame:
    return nodes_of(spark).select("id", "community")


@query(rows("seed id nivel relation", ("arq_indice", "fusao", 1, "references"), ("arq_indice", "busca", 1, "calls"), ("arq_indice", "t_busca", 2, "calls"), ("rrf", "busca", 1, "calls"), ("rrf", "fusao", 1, "calls"), ("rrf", "x", 1, "calls"), ("rrf", "t_busca", 2, "calls")))
def g04_affected_members(spark: SparkSession, d: str) -> DataFrame:
    return C.affected_by(edges_of(spark), spark.createDataFrame([("arq_indice",), ("rrf",)], "id string"), 2)


@query(rows("medida chave n:BIGINT", ("nos", None, 9), ("arestas", None, 10), ("comunidades", None, 4), ("relacao", "contains", 2), ("relacao", "calls", 6), ("relacao", "rationale_for", 1), ("relacao", "references", 1), ("tipo", "code", 7), ("tipo", "rationale", 1), ("tipo", "concept", 1), ("central", "rrf", 4), ("central", "busca", 3), ("central", "fusao", 2)))
def a17_graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    n = nodes_of(spark)
    return C.statistics(n, edges_of(spark), 3)


@query(rows("id label grau:BIGINT", ("rrf", "rrf()", 4), ("busca", "buscar()", 3), ("gravar", "gravar_indice()", 3), ("ler", "ler_indice()", 3)))
def k04_god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return C.god_nodes(nodes_of(spark), edges_of(spark), 4)


@query(rows("source target relation nota", ("fusao", "gravar", "references", 4), ("busca", "ler", "calls", 3), ("busca", "rrf", "calls", 1)))
def r17_surprises(spark: SparkSession, d: str) -> DataFrame:
    return C.surprises(nodes_of(spark), edges_of(spark))


@query(rows("ca cb source target relation confidence", (0, 1, "fusao", "gravar", "references", "AMBIGUOUS"), (1, 2, "t_busca", "busca", "calls", "EXTRACTED")))
def g13_community_bridges(spark: SparkSession, d: str) -> DataFrame:
    return C.bridges_of_communities(edges_of(spark), members_of(spark))


@query(rows("id community:BIGINT", ("fusao", 0), ("rrf", 0), ("busca", 0), ("porque", 0), ("arq_indice", 1), ("gravar", 1), ("ler", 1), ("solto", 2), ("t_busca", 3)))
def g08_numbered(spark: SparkSession, d: str) -> DataFrame:
    return C.numbered_communities(members_of(spark))


@query(rows("id community", ("rrf", 1), ("x", None), ("gravar", 0)))
def g08_reattached(spark: SparkSession, d: str) -> DataFrame:
    """Hubs by the majority of their neighbors; one whose only neighbor is a hub too stays without."""
    hubs = spark.createDataFrame([("rrf",), ("x",), ("gravar",)], "id string")
    return C.reattached(edges_of(spark), members_of(spark).join(hubs, "id", "left_anti"), hubs)


@query(rows("community rotulo", (0, "gravar_indice()"), (1, "rrf()"), (2, "test_buscar_rrf()"), (3, None)))
def g10_community_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.community_labels(nodes_of(spark), edges_of(spark), members_of(spark))


@query(rows("id valor", ("a", 0.0), ("b", 0.666667), ("c", 0.666667), ("d", 0.0)))
def g11_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """A path of four nodes: each inner node lies between two of three pairs."""
    return C.betweenness(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "d"), ("c", "b")], "source string, target string"))


@query("WITH n AS (SELECT 'N' || n_nationkey AS id, 'R' || n_regionkey AS r FROM nation), s AS (SELECT r, count(*) AS k FROM n GROUP BY r) SELECT id, 0.0::DOUBLE AS valor FROM n UNION ALL SELECT r, round(k * (k - 1) / ((SELECT count(*) FROM n) + (SELECT count(*) FROM s) - 1.0) / ((SELECT count(*) FROM n) + (SELECT count(*) FROM s) - 2.0), 6) FROM s")
def g11_star_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Regions and their nations are stars: a region lies between every pair of its nations."""
    e = load(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("source"), F.concat(F.lit("R"), "n_regionkey").alias("target"))
    return C.betweenness(e)


@query(rows("tipo alvo n:BIGINT", ("ambigua", "fusao>gravar", 1), ("ponte", "busca", 2), ("ponte", "ler", 1), ("dispersa", "9", 6)))
def g15_questions(spark: SparkSession, d: str) -> DataFrame:
    between = spark.createDataFrame([("rrf", 0.5), ("busca", 0.4), ("ler", 0.3), ("gravar", 0.2)], "id string, valor double")
    cohesion = spark.createDataFrame([(9, 6, 0.1), (8, 4, 0.1), (7, 9, 0.5)], "community int, n long, coesao double")
    return C.questions(nodes_of(spark), edges_of(spark), members_of(spark), between, cohesion)


@query(rows("community final:BIGINT", (10, 5), (11, 0), (12, 1), (13, 2)))
def j15_remapped(spark: SparkSession, d: str) -> DataFrame:
    """Two old numbers go to those that overlap most; the others take the smallest free numbers by size."""
    new = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 11), ("e", 11), ("f", 12), ("g", 12), ("h", 13)], "id string, community int")
    old = spark.createDataFrame([("a", 5), ("b", 5), ("d", 5), ("c", 0), ("e", 0)], "id string, community int")
    return C.remap_to_previous(new, old)


_PH = [("p", "a.py"), ("t", "b.ts"), ("q", "c.py"), ("m", "d.md"), ("n", None)]


@query(rows("source target relation confidence", ("p", "q", "calls", "INFERRED"), ("p", "t", "calls", "EXTRACTED"), ("p", "n", "calls", "INFERRED"), ("p", "m", "references", "EXTRACTED"), ("p", "p", "calls", "EXTRACTED")))
def g25_without_phantoms(spark: SparkSession, d: str) -> DataFrame:
    e = [("p", "q", "calls", "INFERRED"), ("p", "t", "calls", "INFERRED"), ("p", "t", "calls", "EXTRACTED"), ("p", "m", "calls", "INFERRED"), ("p", "n", "calls", "INFERRED"), ("p", "t", "imports", "EXTRACTED"), ("p", "m", "references", "EXTRACTED"), ("p", "p", "calls", "EXTRACTED"), ("p", "p", "imports_from", "EXTRACTED")]
    return C.without_phantoms(spark.createDataFrame(_PH, "id string, source_file string"), spark.createDataFrame(e, "source string, target string, relation string, confidence string"))


@query(rows("id ini fim", ("arq_indice", 5, 12), ("gravar", 5, 12), ("ler", 100, 100), ("rrf", 20, 20)))
def j10_touched_nodes(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([("src/indice.py", 5, 12), ("src/indice.py", 100, 100), ("src/fusao.py", 20, 20), ("src/fusao.py", 1, 4), ("other.py", 1, 9)], "source_file string, ini long, fim long")
    return C.touched_nodes(nodes_of(spark), r)


_CITES = [
    (1, "Ver `rrf()` e `FusaoRRF` no motor-extra"), (2, "`Indice.gravar_indice()` chama `ler_indice`; `plain` nao conta, `ab()` tambem nao"), (3, "nada citado"), (4, None), (5, "`busca_hibrida.py` e `rrf()`"),
]
_INDEX = [("motor", "m1", "rrf"), ("motor-extra", "x1", "rrf"), ("motor", "m2", "fusaorrf"), ("motor-extra", "x2", "fusaorrf"), ("motor", "m3", "gravar_indice"), ("outro", "o3", "gravar_indice"), ("motor", "m4", "ler_indice"), ("motor", "m5", "busca_hibrida.py"), *[("outro", f"o{i}", "plain") for i in range(9)]]


@query(rows("id grafo citado no", (1, "motor-extra", "rrf()", "x1"), (1, "motor-extra", "FusaoRRF", "x2"), (2, "motor", "Indice.gravar_indice()", "m3"), (2, "motor", "ler_indice", "m4"), (5, "motor", "busca_hibrida.py", "m5"), (5, "motor", "rrf()", "m1")))
def j09_cited_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The graph named in the text wins a tie, the longest name first; else votes, then the shortest name."""
    t = spark.createDataFrame(_CITES, "k int, texto string")
    i = spark.createDataFrame(_INDEX, "grafo string, id string, chave string")
    return C.cited_nodes(t, "k", "texto", i).select(F.col("k").alias("id"), "grafo", "citado", F.col("id").alias("no"))


@query(rows("id inicio fim trecho", ("gravar", 10, 11, "linha 10\nlinha 11"), ("arq_indice", 1, 2, "linha 1\nlinha 2"), ("ler", 40, 40, "linha 40")))
def g21_excerpts(spark: SparkSession, d: str) -> DataFrame:
    f = spark.createDataFrame([("src/indice.py", "\n".join(f"linha {i}" for i in range(1, 41)))], "source_file string, texto string")
    return C.code_excerpt(nodes_of(spark), f, 2)


@query("SELECT id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS nome FROM skills")
def g19_make_id(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "skills").select("id", C.make_id(F.col("title")).alias("nome"))


@query("SELECT source_repo || '::' || id AS id FROM skills WHERE source_repo <> (SELECT min(source_repo) FROM skills)")
def g20_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Skills as nodes of their repositories, without those of the first one."""
    s = load(spark, d, "skills")
    first = s.agg(F.min("source_repo").alias("r")).first()["r"]
    n = s.where("source_repo IS NOT NULL").select(F.concat_ws("::", "source_repo", F.col("id").cast("string")).alias("id"))
    return C.without_tag(n, first, ["id"])


@query(rows("hid membros", (1, ["arq_indice", "rrf"]), (2, ["busca"])))
def g27_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    h = spark.createDataFrame([(1, ["Arq-Indice", "nope", "rrf", "rrf"]), (2, ["BUSCA"]), (3, ["nope"]), (4, [])], "hid int, membros array<string>")
    return C.prune_hyperedges(h, nodes_of(spark))


@query(rows("arquivo nome id", ("a.py", "f", "a_f"), ("a.py", "g2", "b_g"), ("a.py", "h", "c_h"), ("a.py", "only", "d_only")))
def g30_resolved_names(spark: SparkSession, d: str) -> DataFrame:
    """Own names, an alias, a star import and a name declared once; a name declared twice elsewhere stays open."""
    dec = spark.createDataFrame([("a.py", "f", "a_f"), ("b.py", "f", "b_f"), ("b.py", "g", "b_g"), ("c.py", "h", "c_h"), ("d.py", "h", "d_h"), ("d.py", "only", "d_only"), ("b.py", "two", "b_two"), ("c.py", "two", "c_two")], "arquivo string, nome string, id string")
    imp = spark.createDataFrame([("a.py", "b.py", "g", "g2"), ("a.py", "c.py", "*", None)], "arquivo string, de string, nome string, como string")
    use = spark.createDataFrame([("a.py", n) for n in ("f", "g2", "h", "only", "nope")] + [("e.py", "two")], "arquivo string, nome string")
    return C.resolve_names(dec, imp, use)


@query(rows("parte a b", ("no", "src_a", "A"), ("no", "src_b", "B"), ("aresta", "src_a", "src_b"), ("aresta", "src_b", "src_b")))
def g18_built(spark: SparkSession, d: str) -> DataFrame:
    """Two extractions of one node, an end in another spelling, a reverse repeat, a dangling edge and a call of itself."""
    n = spark.createDataFrame([("src_a", "A", "src/a.py", "code"), ("src_a", "A longer", "src/a.py", "code"), ("src_b", "B", "src/b.py", "code")], "id string, label string, source_file string, file_type string")
    e = spark.createDataFrame([("src_a", "src-B", "calls", "EXTRACTED", "x"), ("src_b", "src_a", "calls", "EXTRACTED", "1"), ("src_a", "gone", "calls", "EXTRACTED", "1"), ("src_b", "src_b", "calls", "EXTRACTED", "1"), ("src_b", "src_b", "imports", "EXTRACTED", "1")], "source string, target string, relation string, confidence string, weight string")
    nodes, edges = C.build_graph(n, e)
    return nodes.select(F.lit("no").alias("parte"), F.col("id").alias("a"), F.col("label").alias("b")).unionByName(edges.select(F.lit("aresta").alias("parte"), F.col("source").alias("a"), F.col("target").alias("b")))


@query(rows("source_file v", ("a", 9), ("c", 3), ("d", 4)))
def u07_replaced(spark: SparkSession, d: str) -> DataFrame:
    of = lambda r: spark.createDataFrame(r, "source_file string, v int")
    return C.replaced_sources(of([("a", 1), ("b", 2), ("c", 3)]), of([("a", 9), ("d", 4)]), of([("b", 0)]).select("source_file"))


_PROC = [("a", "aberto", ["b", "z"]), ("b", "aberto", ["c"]), ("c", "Cancelado", []), ("d", "concluido", []), ("e", "aberto", ["d", "f"]), ("f", "aberto", ["g"]), ("g", "aberto", ["e", "f"])]


@query(rows("id bloqueado_por classe", ("a", "b", "aberto"), ("a", "z", "ausente"), ("b", "c", "cancelado"), ("e", "d", "concluido"), ("e", "f", "aberto"), ("f", "g", "aberto"), ("g", "e", "aberto"), ("g", "f", "aberto")))
def j17_blockers(spark: SparkSession, d: str) -> DataFrame:
    return C.blockers(spark.createDataFrame(_PROC, "id string, estado string, bloqueios array<string>"))


@query(rows("membros tamanho", (["e", "f", "g"], 3), (["f", "g"], 2)))
def g16_blocking_cycles(spark: SparkSession, d: str) -> DataFrame:
    return C.blocking_cycles(j17_blockers(spark, d))


@query(rows("id nivel estado", ("a", 0, "feito"), ("b", 1, "falhou"), ("c", 2, "pulado"), ("e", 3, "pulado"), ("f", 0, "feito")))
def g17_run_states(spark: SparkSession, d: str) -> DataFrame:
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "e")], "source string, target string")
    return C.run_states(spark.createDataFrame([(x,) for x in "abcef"], "id string"), deps, spark.createDataFrame([("b",)], "id string"))


@query(rows("ciclo tamanho", (["a.py", "b.py"], 2), (["a.py", "c.py", "d.py"], 3)))
def g14_import_cycles(spark: SparkSession, d: str) -> DataFrame:
    n = spark.createDataFrame([("a1", "a.py"), ("a2", "a.py"), ("b", "b.py"), ("c", "c.py"), ("dd", "d.py")], "id string, source_file string")
    e = spark.createDataFrame([("a1", "b", "imports"), ("b", "a2", "imports_from"), ("a1", "c", "imports"), ("c", "dd", "re_exports"), ("dd", "a1", "imports"), ("a1", "a2", "imports"), ("dd", "c", "calls")], "source string, target string, relation string")
    return C.import_cycles(n, e)


@query(rows("qid tipo a relation b nivel", (1, "semente", "rrf", None, None, 0), (1, "semente", "fusao", None, None, 0), (1, "aresta", "busca", "calls", "rrf", 1), (1, "aresta", "fusao", "calls", "rrf", 1), (1, "aresta", "x", "calls", "rrf", 1), (1, "aresta", "fusao", "references", "gravar", 1), (1, "racional", "rrf", "rationale_for", "porque", None)))
def g03_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """One hop around the two nodes that a question names: the function first, then the class of the rarer word."""
    return C.question_subgraph(nodes_of(spark), edges_of(spark), spark.createDataFrame([(1, "rrf fusao")], "qid int, texto string"), depth=1, seeds=2)


_E = [("b", "a", "r", "2", None), ("a", "b", "r", "nan", ""), ("a", "c", "r", "-1", "own.py"), ("z", "a", "s", None, None), ("a", "a", "r", "Infinity", None)]


def _weighed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_E, "source string, target string, relation string, weight string, source_file string")


@query(rows("source target weight:DOUBLE source_file", ("b", "a", 2.0, "b.py"), ("a", "b", 1.0, "b.py"), ("a", "c", 1.0, "own.py"), ("z", "a", 1.0, None), ("a", "a", 1.0, None)))
def g24_backfilled(spark: SparkSession, d: str) -> DataFrame:
    """Weights that are none become 1; files come from the source, else the target."""
    n = spark.createDataFrame([("a", None), ("b", "b.py"), ("c", "c.py")], "id string, source_file string")
    return G.backfilled(_weighed(spark), n).select("source", "target", "weight", "source_file")


@query(rows("source target relation", ("a", "b", "r"), ("a", "c", "r"), ("z", "a", "s"), ("a", "a", "r")))
def g26_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return G.collapse_undirected(_weighed(spark).select("source", "target", "relation"))


@query(rows("source target relation", *[e[:3] for e in EDGES if e[0] != "x"]))
def j06_pruned(spark: SparkSession, d: str) -> DataFrame:
    return G.prune_dangling(edges_of(spark), nodes_of(spark)).select("source", "target", "relation")


@query(rows("source target relation", ("indice", "fusao", "references"), ("busca", "indice", "calls")))
def j11_remapped_edges(spark: SparkSession, d: str) -> DataFrame:
    """The functions of the index as one node: what was between them goes."""
    s = spark.createDataFrame([("gravar", "indice"), ("ler", "indice")], "id string, sobrevivente string")
    e = spark.createDataFrame([("gravar", "ler", "calls"), ("gravar", "fusao", "references"), ("ler", "fusao", "references"), ("busca", "ler", "calls"), (None, "ler", "calls")], "source string, target string, relation string")
    return remap_edges(e, s, "id").select("source", "target", "relation")


@query(rows("source target relation w", ("a", "b", "r", 1), ("a", "b", "s", 2)))
def u06_first_edges(spark: SparkSession, d: str) -> DataFrame:
    """Of edges of one source, target and relation the first that came."""
    e = spark.createDataFrame([("a", "b", "r", 1), ("a", "b", "s", 2), ("a", "b", "r", 3)], "source string, target string, relation string, w int")
    return latest_wins(e, ["source", "target", "relation"], [F.asc("w")])


# over whole tables: skills as nodes, linked to the next skill of their repository

def _skill_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = load(spark, d, "skills")
    n = s.select(F.col("id").cast("string").alias("id"), F.col("title").alias("label"), F.col("rel_path").alias("source_file"), F.lit("code").alias("file_type"))
    e = s.select(F.col("id").cast("string").alias("source"), F.lead("id").over(Window.partitionBy("source_repo").orderBy("id")).cast("string").alias("target"), F.lit("references").alias("relation")).where("target IS NOT NULL")
    return n, e


_TERMS = lambda c: f"list_filter(regexp_extract_all(strip_accents(lower(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))), '([a-z0-9]+)', 1), lambda x: length(x) > 1)"
_LOW = lambda c: f"strip_accents(lower(coalesce({c}, '')))"
ASKS = [(1, "hook cache"), (2, "trace"), (3, "fila de teste"), (4, "Índice  cache hook"), (5, "!!")]


@query(f"""WITH n AS (SELECT CAST(id AS VARCHAR) AS id, title, rel_path FROM skills), t AS (SELECT id, unnest(list_distinct(list_concat({_TERMS('title')}, {_TERMS('id')}))) AS t FROM n), df AS (SELECT t, ln(1 + (SELECT count(*) FROM n) / count(*)::DOUBLE) AS idf FROM t GROUP BY t),
a AS ({rows("qid texto", *ASKS)}), q AS (SELECT qid, trim({_LOW('texto')}) AS alvo, {_TERMS('texto')} AS ts FROM a), w AS (SELECT qid, unnest(ts) AS t FROM q), p AS (SELECT qid, id, sum(idf) AS p FROM w JOIN t USING (t) JOIN df USING (t) GROUP BY ALL),
e AS (SELECT CAST(id AS VARCHAR) AS source, CAST(lead(id) OVER (PARTITION BY source_repo ORDER BY id) AS VARCHAR) AS target FROM skills), g AS (SELECT id, count(*) AS grau FROM (SELECT source AS id FROM e WHERE target IS NOT NULL UNION ALL SELECT target FROM e WHERE target IS NOT NULL) GROUP BY id),
s AS (SELECT qid, p.id, round((p + CASE WHEN {_LOW('title')} = alvo OR {_TERMS('title')} = ts THEN 1000 WHEN contains({_LOW('title')}, alvo) THEN 10 ELSE 0 END) / greatest(len(list_filter(regexp_extract_all({_LOW('title')}, '([a-z0-9]+)', 1), lambda x: length(x) > 1)), 1)
 * CASE WHEN (regexp_matches('/' || lower(coalesce(rel_path, '')), '/tests?/') OR starts_with(regexp_extract(lower(coalesce(rel_path, '')), '[^/]*$'), 'test_')) AND NOT len(list_filter(ts, lambda x: starts_with(x, 'test'))) > 0 THEN 0.3 ELSE 1 END, 6) AS score FROM p JOIN q USING (qid) JOIN n USING (id))
SELECT qid, id, score, CAST(posicao AS INT) AS posicao FROM (SELECT qid, s.id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(grau, 0) DESC, s.id) AS posicao FROM s LEFT JOIN g USING (id)) WHERE posicao <= 10""")
def r12_search_nodes(spark: SparkSession, d: str) -> DataFrame:
    return C.search_nodes(*_skill_nodes(spark, d), spark.createDataFrame(ASKS, "qid int, texto string"))


@query("""WITH n AS (SELECT CAST(id AS VARCHAR) AS id, lower(title) AS l, lower(rel_path) AS f FROM skills), q AS (SELECT id AS qid, CASE id % 4 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN upper(title) WHEN 2 THEN rel_path || '/' ELSE substring(title, 1, 12) END AS t FROM skills),
k AS (SELECT qid, regexp_replace(t, '[/\\\\]+$', '') AS raw FROM q WHERE t IS NOT NULL), h AS (
SELECT qid, 1 AS r, id FROM k JOIN n ON id = raw UNION ALL SELECT qid, 2, id FROM k JOIN n ON l = lower(raw) UNION ALL SELECT qid, 3, id FROM k JOIN n ON regexp_replace(l, '\\(\\)$', '') = regexp_replace(lower(raw), '\\(\\)$', '')
UNION ALL SELECT qid, 4, id FROM k JOIN n ON f = lower(raw) UNION ALL SELECT qid, 5, id FROM k JOIN n ON contains(l, lower(raw))), u AS (SELECT qid, r, min(id) AS id FROM h GROUP BY qid, r HAVING count(DISTINCT id) = 1), b AS (SELECT qid, min(struct_pack(r := r, id := id)) AS m FROM u GROUP BY qid)
SELECT q.qid, m.id AS id, m.r AS degrau FROM q LEFT JOIN b USING (qid)""")
def g05_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Every skill asked for by its id, its title in capitals, its path, or the beginning of its title."""
    n, _ = _skill_nodes(spark, d)
    k = F.col("id") % 4
    q = load(spark, d, "skills").select(F.col("id").alias("qid"), F.when(k == 0, F.col("id").cast("string")).when(k == 1, F.upper("title")).when(k == 2, F.concat("rel_path", F.lit("/"))).otherwise(F.substring("title", 1, 12)).alias("texto"))
    return C.resolve_seeds(n, q)


# entity resolution

_NORM = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT sujeito AS k, {_NORM('strip_accents(sujeito)')} AS l FROM fatos WHERE sujeito IS NOT NULL AND {_NORM('strip_accents(sujeito)')} <> ''), l AS (SELECT DISTINCT l FROM n), ch AS (SELECT l, unnest(string_split(l, '')) AS c FROM l),
fr AS (SELECT l, count(*)::DOUBLE / any_value(length(l)) AS p FROM ch GROUP BY l, c), g AS (SELECT l FROM fr GROUP BY l HAVING -sum(p * log2(p)) >= 2.5),
e AS (SELECT a.l AS a, b.l AS b FROM g a JOIN g b ON a.l <> b.l AND jaro_winkler_similarity(a.l, b.l) >= 0.92), r AS (SELECT l AS root, l FROM l UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.l), c AS (SELECT l, min(root) AS g FROM r GROUP BY l),
m AS (SELECT g, min(struct_pack(n := length(k), k := k)).k AS s, count(*) AS c FROM n JOIN c USING (l) GROUP BY g) SELECT k AS sujeito, s AS sobrevivente FROM n JOIN c USING (l) JOIN m USING (g) WHERE m.c > 1""")
def d10_resolved_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of facts, as they are written, joined by their labels, marks apart; no similar pair is lost."""
    return resolve(load(spark, d, "fatos").select("sujeito", fold_latin(F.col("sujeito")).alias("l")).distinct(), "sujeito", "l", exact=True)


#: Nodes for every rule: repeats in one file, across files, variants, slips, extensions, numbers, anchored types, communities, code.
MERGES = [
    ("aa_x", "Extractor Engine", "f1", "concept", 1), ("ab_x", "extractor  engine!", "f1", "concept", 2), ("ac_x", "Extractor Engine", "f2", "concept", 1),
    ("v1", "cranel1", "f1", "concept", 1), ("v2", "cranel2", "f1", "concept", 1), ("s1", "extractor", "f3", "concept", 1), ("s2_c4", "extrcator", "f4", "concept", 1), ("e1", "parse configuration", "f1", "concept", 1), ("e2", "parse configuration file", "f1", "concept", 1),
    ("n1", "Decision record 0011", "f1", "concept", 1), ("n2", "Decision record 0013", "f1", "concept", 1), ("d1", "Django settings for billing", "f1", "document", 1), ("d2", "Django settings of billing", "f2", "document", 1),
    ("z1", "retry policy of the scheduler", "f1", "concept", 7), ("z2", "retry polici of the schedulers", "f2", "concept", 7), ("k1", "same name()", "f1", "code", 1), ("k2", "same name()", "f1", "code", 1), ("o1", "nobody knows file", "", "concept", 1), ("o2", "nobody knows file", "", "concept", 1),
]


@query(rows("id sobrevivente", ("aa_x", "aa_x"), ("ab_x", "aa_x"), ("s1", "s1"), ("s2_c4", "s1"), ("z1", "z1"), ("z2", "z1")))
def d07_merge_guards(spark: SparkSession, d: str) -> DataFrame:
    return D.merge_map(spark.createDataFrame(MERGES, "id string, label string, source_file string, file_type string, community int"))


@query(rows("id label source_file place _origin", ("src_indice_grava", "grava", "src/indice.py", "L9", None), ("nota", "a", "", None, None)))
def d11_one_per_id(spark: SparkSession, d: str) -> DataFrame:
    """The defining file's node stays, is filled from nodes of its file only, and takes no mark of origin; without files nothing is filled."""
    r = [("src_indice_grava", "grava", "src/indice.py", None, None), ("src_indice_grava", "grava indice", "src/indice.py", "L9", "ast"), ("src_indice_grava", "g", "docs/x.md", "L1", "llm"), ("nota", "a", "", None, None), ("nota", "bb", "", "L2", "ast")]
    return D.one_per_id(spark.createDataFrame(r, "id string, label string, source_file string, place string, _origin string"))


@query(f"WITH n AS (SELECT CAST(id AS VARCHAR) AS id, {_NORM('title')} AS l FROM skills), b AS (SELECT l, min(struct_pack(s := regexp_matches(id, '_c[0-9]+$'), n := length(id), id := id)).id AS s FROM n WHERE l <> '' GROUP BY l) SELECT id, s AS sobrevivente FROM n JOIN b USING (l)")
def d13_by_label(spark: SparkSession, d: str) -> DataFrame:
    return D.by_label(_skill_nodes(spark, d)[0])


@query("SELECT source_repo, min(id) AS id FROM skills WHERE content IS NOT NULL AND source_repo IS NOT NULL GROUP BY source_repo, md5(content)")
def d18_first_items(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "skills").where("content IS NOT NULL AND source_repo IS NOT NULL")
    return D.first_items(s.select("source_repo", "id", "content"), ["source_repo"], "id", F.col("content")).select("source_repo", "id")


@query("""WITH RECURSIVE m AS (SELECT o_custkey AS g, o_orderkey AS i, CAST(CAST(o_totalprice * 100 AS BIGINT) AS BIGINT) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
r AS (SELECT g, i, k, [m] AS l, true AS lider FROM m WHERE k = 1 UNION ALL SELECT m.g, m.i, m.k, CASE WHEN list_min(list_transform(l, lambda x: bit_count(xor(x, m.m)))) > 8 THEN list_append(l, m.m) ELSE l END, list_min(list_transform(l, lambda x: bit_count(xor(x, m.m)))) > 8 FROM r JOIN m ON m.g = r.g AND m.k = r.k + 1)
SELECT g, i, lider FROM r""")
def d15_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Prices of each customer's orders as marks, leaders at over 8 bits from all leaders before."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") * 100).cast("long").alias("m"))
    return D.mark_leaders(o, ["g"], "i", "m", 8).select("g", "i", "lider")
