"""Queries of extraction from files, snapshots, graph sinks, and what is left of histories and summaries."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions.claims import chunk_size
from garimpo.operators import graph as G
from garimpo.operators import usage as U
from garimpo.plans.graphs import EDGES, NODES, edges_of, members_of, nodes_of
from garimpo.plans.registry import registry, rows
from garimpo.sources import extract as X
from garimpo.sources import snapshots as S
from garimpo.runtime import load

QUERIES, ORACLE, query = registry()


def _zip(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


_W = 'xmlns:w="http://x/w"'
_DOCX = _zip(word__document_xml=f'<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Titulo</w:t></w:r></w:p><w:p><w:r><w:t>Um </w:t></w:r><w:r><w:t>texto</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc/><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
_PPTX = _zip(ppt__slides__slide2_xml='<a xmlns:q="u"><q:p><q:t>dois</q:t></q:p></a>', ppt__slides__slide1_xml='<a xmlns:q="u"><q:p><q:t>um</q:t><q:t>a</q:t></q:p><q:p/></a>', ppt__slides__slide10_xml='<a xmlns:q="u"><q:p><q:t>dez</q:t></q:p></a>')
_XLSX = _zip(xl__workbook_xml='<w><sheets><sheet name="Custos"/></sheets></w>', xl__sharedStrings_xml="<s><si><t>item</t></si><si><t>valor</t></si></s>", xl__worksheets__sheet1_xml='<w><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c></row></w>')
_FILES = [
    ("a/x.md", "# olá".encode()), ("a/y.txt", "ação".encode("cp1252")), ("a/z.csv", b"n,v\n\na|b,1\n , \nc,2\n"), ("a/h.html", b"<html><head><title>t</title></head><body><h1>T</h1><p>um</p><script>x</script></body></html>"), ("a/c.py", b"x = 1\n"),
    ("a/d.docx", _DOCX), ("a/p.pptx", _PPTX), ("a/s.xlsx", _XLSX), ("a/bad.docx", b"no zip"), ("a/q.bin", b"\x00"), ("a/e.md", None),
]


@query(rows("path texto erro", ("a/x.md", "# olá", False), ("a/y.txt", "ação", False), ("a/z.csv", "| n | v |\n| --- | --- |\n| a\\|b | 1 |\n| c | 2 |", False), ("a/h.html", "# T\num", False), ("a/c.py", "```py\nx = 1\n```", False), ("a/d.docx", "# Titulo\n\nUm texto\n\n| a | b\\|c |\n| --- | --- |\n|  | 2 |", False), ("a/p.pptx", "## 1\numa\n\n## 2\ndois\n\n## 3\ndez", False), ("a/s.xlsx", "## Custos\n\n| item |  | valor |\n| --- | --- | --- |\n| 7 |  |  |", False), ("a/bad.docx", None, True), ("a/q.bin", None, True), ("a/e.md", "", False)))
def s06_extracted(spark: SparkSession, d: str) -> DataFrame:
    """A file of each form, broken and unknown ones."""
    e = X.extract(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in _FILES], "path string, content binary"))
    return e.select("path", "texto", F.col("erro").isNotNull().alias("erro"))


_RULES = [("", "*.log"), ("", "build/"), ("", "!keep.log"), ("", "/only.txt"), ("sub", "local.md"), ("", "docs/*.tmp"), ("", "# no"), ("", "a?.c")]
_PATHS = ["x.log", "keep.log", "sub/keep.log", "build/a.txt", "src/build/b.txt", "build", "only.txt", "sub/only.txt", "sub/local.md", "local.md", "sub/deep/local.md", "docs/x.tmp", "docs/y/x.tmp", "ab.c", "abc.c", "plain.txt"]


@query(rows("path", *[(p,) for p in ("keep.log", "sub/keep.log", "build", "sub/only.txt", "local.md", "docs/y/x.tmp", "abc.c", "plain.txt")]))
def s13_kept_files(spark: SparkSession, d: str) -> DataFrame:
    """Patterns at any depth, folders, taken back, anchored, of one folder, with a slash, a single character."""
    return X.kept_files(spark.createDataFrame([(p,) for p in _PATHS], "path string"), _RULES)


@query(rows("path secreto", ("a/.env", True), ("a/.env.local", True), ("k/id_rsa", True), ("k/id_rsa.pub", True), ("x/server.pem", True), ("x/credentials.json", True), ("x/secrets.yaml", True), ("x/secretary.md", False), ("x/environment.py", False)))
def f19_sensitive(spark: SparkSession, d: str) -> DataFrame:
    p = ["a/.env", "a/.env.local", "k/id_rsa", "k/id_rsa.pub", "x/server.pem", "x/credentials.json", "x/secrets.yaml", "x/secretary.md", "x/environment.py"]
    return spark.createDataFrame([(x,) for x in p], "path string").select("path", X.is_sensitive(F.col("path")).alias("secreto"))


_SRC = [
    ("n/guia.md", "# Guia\ntexto [[outra]] e [x](b/c.md#s)\n## Parte\n```\n# nao\n```\n## Parte\n[[outra]] [fora](http://x/y.md)\n"),
    ("db/s.sql", "-- from nada\nCREATE TABLE IF NOT EXISTS users (id int);\ncreate view v as with t as (select * from users) select * from t join app.orders o on true;\nALTER TABLE x ADD FOREIGN KEY (a) REFERENCES users (id);"),
    ("p/package.json", '{"name": "app", "dependencies": {"left-pad": "1"}, "devDependencies": {"jest": "2"}}'), ("p/pyproject.toml", '[project]\nname = "gar"\ndependencies = ["numpy>=1", "pyspark"]\n'), ("p/mcp.json", '{"mcpServers": {"srv": {"command": "/usr/bin/node", "env": {"KEY": "1"}}}}'), ("p/bad.json", "{"),
    ("m/a.py", 'import os\nfrom b import c\n\nclass Base:\n    pass\n\nclass K(Base):\n    """Um motivo."""\n    def run(self):\n        """Roda tudo."""\n        return helper(os.x())\n\ndef helper(v):\n    return v\n'), ("m/bad.py", "def ("), ("m/none.py", None),
]


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return X.code_graph(spark.createDataFrame(_SRC, "path string, texto string"))


@query(rows("source_file id", *[("n/guia.md", i) for i in ("n_guia_md", "n_guia_md_guia", "n_guia_md_parte", "n_guia_md_parte_7")], *[("db/s.sql", i) for i in ("db_s_sql", "db_s_sql_users", "db_s_sql_v")], ("p/package.json", "p_package_json"), ("p/pyproject.toml", "p_pyproject_toml"), ("p/mcp.json", "p_mcp_json"), ("p/mcp.json", "p_mcp_json_srv"), ("p/bad.json", "p_bad_json"), *[("m/a.py", i) for i in ("m_a_py", "m_a_py_base", "m_a_py_k", "m_a_py_k_run", "m_a_py_k_run_rationale", "m_a_py_helper")], ("m/bad.py", "m_bad_py")))
def s18_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a note, a schema, manifests and a module; broken files give themselves."""
    return _graph(spark)[0].select("source_file", "id")


@query(rows("source relation target", ("n_guia_md", "contains", "n_guia_md_guia"), ("n_guia_md_guia", "contains", "n_guia_md_parte"), ("n_guia_md_guia", "contains", "n_guia_md_parte_7"), ("n_guia_md", "references", "outra"), ("n_guia_md", "references", "b_c"),
    ("db_s_sql", "contains", "db_s_sql_users"), ("db_s_sql", "contains", "db_s_sql_v"), ("db_s_sql_v", "references", "db_s_sql_users"), ("db_s_sql_v", "references", "orders"), ("db_s_sql", "references", "db_s_sql_users"),
    ("p_package_json", "depends_on", "pkg_left_pad"), ("p_package_json", "depends_on", "pkg_jest"), ("p_pyproject_toml", "depends_on", "pkg_numpy"), ("p_pyproject_toml", "depends_on", "pkg_pyspark"), ("p_mcp_json", "contains", "p_mcp_json_srv"), ("p_mcp_json_srv", "uses", "node"), ("p_mcp_json_srv", "requires_env", "env_key"),
    ("m_a_py", "imports", "os"), ("m_a_py", "imports_from", "b"), ("m_a_py", "contains", "m_a_py_base"), ("m_a_py", "contains", "m_a_py_k"), ("m_a_py_k", "inherits", "m_a_py_base"), ("m_a_py_k", "method", "m_a_py_k_run"), ("m_a_py_k_run_rationale", "rationale_for", "m_a_py_k_run"), ("m_a_py_k_run", "calls", "m_a_py_helper"), ("m_a_py", "contains", "m_a_py_helper")))
def s18_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark)[1].select("source", "relation", "target")


@query("SELECT rid, id FROM chunks WHERE rid IN (SELECT CAST(rid AS BIGINT) FROM mudancas WHERE rid IS NOT NULL)")
def s02_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the change feed names."""
    return S.by_ids(load(spark, d, "chunks"), load(spark, d, "mudancas").where("rid IS NOT NULL"), ["id"])


@query("SELECT rid, id FROM chunks ORDER BY rid LIMIT 10")
def s04_peek(spark: SparkSession, d: str) -> DataFrame:
    return S.peek(load(spark, d, "chunks")).select("rid", "id")


@query("SELECT 'L' AS lado, count(*) AS linhas FROM chunks UNION ALL SELECT 'R', count(*) FROM chunks WHERE doc IS NOT NULL")
def s22_sums(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of the whole collection and of what has a text, as a backup notes them."""
    c = load(spark, d, "chunks").select("rid", "col", "id", "doc", "meta")
    one = lambda df, n: S.sums(df).select(F.lit(n).alias("lado"), "linhas")
    return one(c, "L").unionByName(one(c.where("doc IS NOT NULL"), "R"))


@query("SELECT vec_id AS qid, 1 AS posicao, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM embeddings WHERE false")
def s21_same_answers(spark: SparkSession, d: str) -> DataFrame:
    """A copy in another order answers alike: no row."""
    e = load(spark, d, "embeddings")
    return S.same_answers(e, e.repartition(3).orderBy(F.desc("vec_id")), e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@query(rows("caminho falha", ("b", "mudou"), ("c", "falta"), ("d", "a mais")))
def s24_manifest_faults(spark: SparkSession, d: str) -> DataFrame:
    s = "caminho string, marca string"
    return S.manifest_faults(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], s), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], s))


@query("SELECT * FROM (VALUES " + ", ".join("('<node id=\"{}\"><data key=\"label\">{}</data></node>')".format(n[0], n[1]) for n in NODES) + ", " + ", ".join("('<edge source=\"{}\" target=\"{}\"><data key=\"relation\">{}</data></edge>')".format(*e[:3]) for e in EDGES if e[0] != "x") + ") x(linha)")
def s20_graphml(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges as GraphML, the frame apart."""
    g = S.graphml(nodes_of(spark), G.prune_dangling(edges_of(spark), nodes_of(spark)))
    return g.where("ordem.a IN (1, 2)").select("linha")


@query(rows("caminho texto", ("busca.md", "# buscar()\n\n- calls [[ler|ler_indice()]]\n- calls [[rrf|rrf()]]\n"), ("solto.md", "# Conceito solto\n")))
def s20_vault_notes(spark: SparkSession, d: str) -> DataFrame:
    return S.vault_notes(nodes_of(spark), edges_of(spark)).where("caminho IN ('busca.md', 'solto.md')")


@query(rows("linha", ("# Grafo",), ("9 nodes, 10 edges",), ("## Centrais",), ("- rrf (4)",), ("- busca (3)",), ("## Comunidades",), ("- 1: 4 (busca, fusao, porque, rrf)",), ("- 0: 3 (arq_indice, gravar, ler)",), ("- 2: 1 (t_busca)",), ("- 3: 1 (solto)",)))
def g29_report(spark: SparkSession, d: str) -> DataFrame:
    central = G.degrees(edges_of(spark)).orderBy(F.desc("grau"), "id").limit(2)
    return S.report(nodes_of(spark), edges_of(spark), members_of(spark), central).select("linha")


@query(rows("linha", *[(f"{a} --> {b}",) for a, b, r, _ in EDGES if r == "calls"]))
def g29_call_diagram(spark: SparkSession, d: str) -> DataFrame:
    return S.call_diagram(edges_of(spark))


@query("SELECT count(*) AS versoes, count(DISTINCT rid) AS caminhos, CAST(sum(octet_length(encode(coalesce(op, '')))) AS BIGINT) AS bytes FROM mudancas WHERE seq IS NOT NULL AND rid IS NOT NULL")
def a12_history(spark: SparkSession, d: str) -> DataFrame:
    """Changes as versions, their operation as what is stored."""
    return U.history_statistics(load(spark, d, "mudancas").where("seq IS NOT NULL AND rid IS NOT NULL"), "rid", "op")


@query("SELECT coalesce(cliente, '') AS cliente, count(*) AS pedidos, CAST(sum(coalesce(chars_entrada, 0)) AS BIGINT) AS antes, CAST(sum(coalesce(chars_saida, 0)) AS BIGINT) AS depois, round(CASE WHEN sum(coalesce(chars_entrada, 0)) > 0 THEN 1 - sum(coalesce(chars_saida, 0)) / sum(coalesce(chars_entrada, 0))::DOUBLE END, 4) AS poupado FROM chamadas GROUP BY 1")
def a26_savings(spark: SparkSession, d: str) -> DataFrame:
    """Characters in and out of calls as what a proxy took and gave."""
    return U.savings(load(spark, d, "chamadas"), "cliente", "chars_entrada", "chars_saida")


@query(rows("janela tamanho", (256, 768), (1024, 3072), (8192, 3072), (0, 1)))
def t03_chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A chunk of 3,072 characters in windows of so many tokens."""
    return spark.createDataFrame([(w, chunk_size(3072, w)) for w in (256, 1024, 8192, 0)], "janela int, tamanho int")


@query(rows("caminho saliencia:DOUBLE", ("a", 1.5), ("b", 0.25), ("c", 0.5), ("d", 2.0)))
def x05_salience(spark: SparkSession, d: str) -> DataFrame:
    """Votes in order: two good ones, wrong after good, good after stale, and the ceiling."""
    v = [("a", 1, "helpful"), ("a", 2, "helpful"), ("b", 1, "helpful"), ("b", 2, "wrong"), ("c", 2, "helpful"), ("c", 1, "stale"), *[("d", i, "helpful") for i in range(9)]]
    return U.salience(spark.createDataFrame(v, "caminho string, em int, voto string"), "caminho", "em", "voto")


@query("""WITH r AS (SELECT 'consulta sem resposta' AS regra, hash AS alvo, CAST(count(*) AS DOUBLE) AS valor FROM consultas WHERE hash IS NOT NULL AND coalesce(n, 0) = 0 GROUP BY hash HAVING count(*) > 2
UNION ALL SELECT 'passo falhando', dag_name, avg((lower(trim(status)) = 'failed')::INT) FROM dag_runs WHERE dag_name IS NOT NULL AND status IS NOT NULL GROUP BY dag_name HAVING avg((lower(trim(status)) = 'failed')::INT) > 0.2) SELECT regra, alvo, round(valor, 6) AS valor FROM r""")
def x02_alert_rules(spark: SparkSession, d: str) -> DataFrame:
    """Two rules over the tables: subjects and values over their limits."""
    q = load(spark, d, "consultas").where("hash IS NOT NULL").groupBy(F.col("hash").alias("alvo")).agg(F.count_if(F.coalesce("n", F.lit(0)) == 0).cast("double").alias("valor"))
    r = load(spark, d, "dag_runs").where("dag_name IS NOT NULL AND status IS NOT NULL").groupBy(F.col("dag_name").alias("alvo")).agg(F.avg((F.lower(F.trim("status")) == "failed").cast("double")).alias("valor"))
    return U.breached({"consulta sem resposta": (q, 2.0), "passo falhando": (r, 0.2)})


@query(rows("id n", ("a", 9), ("b", 2), ("c", 3)))
def u05_united(spark: SparkSession, d: str) -> DataFrame:
    """Three extractions, the last writer of a node wins."""
    of = lambda r: spark.createDataFrame(r, "id string, n int")
    return U.united([of([("a", 1), ("b", 2)]), of([("c", 3)]), of([("a", 9)])], ["id"])
