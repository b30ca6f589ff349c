"""Queries of checks and repairs of texts, on literal rows with known answers and over whole tables with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import claims as C
from garimpo.functions import texts as X
from garimpo.operators import ranking as R
from garimpo.plans.registry import registry, rows
from garimpo.runtime import load

QUERIES, ORACLE, query = registry()

_TEXT = "O daemon **escuta** na porta 8787 e grava o índice em disco. Depois disso a fila de notas é lida inteira pela manhã."


@query(rows("id ok", (1, True), (2, True), (3, False), (4, False), (5, True), (6, False), (7, False), (8, False)))
def t12_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Whole, in pieces in order, in the wrong order, too short, sewn from two blocks, invented, of no text, null."""
    q = [(1, "O DAEMON escuta na porta 8787", _TEXT), (2, "daemon escuta … a fila de notas", _TEXT), (3, "a fila de notas ... daemon escuta", _TEXT), (4, "porta 8787", _TEXT), (5, "grava o indice em disco a fila de notas e lida inteira", _TEXT), (6, "o daemon escuta em todas as redes locais", _TEXT), (7, "o daemon escuta na porta", None), (8, None, _TEXT)]
    return spark.createDataFrame(q, "id int, q string, t string").select("id", C.quoted(F.col("q"), F.col("t")).alias("ok"))


@query(rows("rid pos motivo", (1, 1, None), (1, 2, "repetida"), (1, 3, "citacao curta"), (1, 4, "fonte inexistente"), (1, 5, "sem texto ou citacao"), (1, 6, "citacao fora da fonte"), (2, 1, None)))
def t13_claims(spark: SparkSession, d: str) -> DataFrame:
    src = spark.createDataFrame([(1, 1, "A fila “de notas” é lida inteira pela manhã."), (2, 1, "a fila de notas nunca para")], "rid int, fonte int, conteudo string")
    c = [(1, 1, "A fila é lida.", 1, "fila de notas e lida"), (1, 2, "a FILA é lida", 1, "de notas e lida inteira"), (1, 3, "x", 1, "fila de"), (1, 4, "x", 9, "fila de notas e lida"), (1, 5, " ", 1, "fila de notas e lida"), (1, 6, "y", 1, "fila de notas nao existe"), (2, 1, "A fila é lida.", 1, "a fila de notas nunca")]
    return C.checked_claims(spark.createDataFrame(c, "rid int, pos int, texto string, fonte int, citacao string"), src).select("rid", "pos", "motivo")


@query(rows("nota pos sujeito atributo valor", ("n", 1, "Daemon", "port", "8787"), ("n", 9, "x", "setting:cache", "fila")))
def t14_facts(spark: SparkSession, d: str) -> DataFrame:
    """Of ten facts one repeats, and others have an unknown attribute, a value that is not there, is the subject, a link, too long or a description."""
    f = [("n", 1, "Daemon", "Port", "8787"), ("n", 2, "daemon", "port", "`8787`"), ("n", 3, "daemon", "colour", "8787"), ("n", 4, "daemon", "host", "nowhere"), ("n", 5, "Fila de notas", "path", "fila de notas"), ("n", 6, "daemon", "url", "[[porta]]"), ("n", 7, "d" * 121, "port", "8787"), ("n", 8, "daemon", "scope", "a fila de notas e lida inteira pela manha o dia"), ("n", 9, "x", "setting:cache", "fila"), ("n", 10, "x", "setting:", "fila")]
    return C.valid_facts(spark.createDataFrame(f, "nota string, pos int, sujeito string, atributo string, valor string"), spark.createDataFrame([("n", _TEXT)], "nota string, texto string"))


@query(rows("id n primeiro", (1, 2, '{"value": 1}'), (2, 1, '{"value": "a"}'), (3, 0, None), (4, 0, None)))
def t15_objects(spark: SparkSession, d: str) -> DataFrame:
    """Whole JSON in a fence, an answer that was cut, no JSON, null."""
    t = [(1, 'ok ```{"facts": [{"value": 1}, 3, {"value": 2}]}```'), (2, '{"facts": [{"value": "a"}, {"x": 1}, {"value": "b'), (3, "none {a}"), (4, None)]
    o = C.flat_objects(F.col("t"))
    return spark.createDataFrame(t, "id int, t string").select("id", F.size(o).alias("n"), F.try_element_at(o, F.lit(1)).alias("primeiro"))


@query(rows("id nota:DOUBLE", (1, 1.0), (2, 0.0), (3, 0.4), (4, 0.7), (5, 0.0)))
def t18_quality(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, "uma nota curta que diz o que precisa dizer", "x" * 100), (2, "curta", "x" * 600), (3, "segundo John Doe, as an AI, a fila para de manhã", "x" * 100), (4, "y" * 590, "x" * 600), (5, None, None)]
    return spark.createDataFrame(t, "id int, o string, s string").select("id", C.synthesis_quality(F.col("o"), F.col("s")).alias("nota"))


@query(rows("id texto", (1, "# nota\n\nfim"), (2, "corpo"), (3, ""), (4, None)))
def t19_without_thoughts(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, "<think>plano\nlongo</think>\n# nota\n\n\n\nfim\n"), (2, "```markdown\ncorpo\n```"), (3, "<thinking>sem fim"), (4, None)]
    return spark.createDataFrame(t, "id int, t string").select("id", C.without_thoughts(F.col("t")).alias("texto"))


@query("SELECT id, " + " + ".join(f"len(regexp_extract_all(content, '(?i){p}'))" for p in (*C.WORN, *C.IDLE)) + " AS frases FROM skills WHERE content IS NOT NULL")
def t43_worn_phrases(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "skills").where("content IS NOT NULL").select("id", C.worn_phrases(F.col("content")).cast("long").alias("frases"))


@query(rows("id caminho existe ancestral sugestoes", (1, "/home/ana/a/b/c.py", True, None, []), (1, "/opt/x/y/z/old.py", False, "/opt/x/y", ["/srv/x/y/z/old.py", "/srv/deep/x/y/z/old.py"]), (2, "/opt/x", True, None, []), (2, "/etc/gone/f.txt", False, None, [])))
def t44_paths(spark: SparkSession, d: str) -> DataFrame:
    """A file by the home's sign, a dead one that moved, a folder, one without a trace; patterns, foreign disks and relative paths are none."""
    t = [(1, "ver `~/a/b/c.py:12` e `/opt/x/y/z/old.py`, `/opt/{x}/y`, `/mnt/c/a.txt`, `/home/bia/a`"), (2, "`/opt/x/` e `/etc/gone/f.txt`. `a/b.py`"), (3, None)]
    inv = spark.createDataFrame([("/home/ana/a/b/c.py",), ("/opt/x/y/w.py",), ("/srv/x/y/z/old.py",), ("/srv/deep/x/y/z/old.py",), ("/srv/z/old.py",)], "caminho string")
    return C.checked_paths(C.path_references(spark.createDataFrame(t, "id int, t string"), "id", "t", "/home/ana"), inv, "id").select("id", F.rtrim("caminho", F.lit("/")).alias("caminho"), "existe", "ancestral", "sugestoes")


@query("WITH s AS (SELECT id, lower(coalesce(regexp_extract(rel_path, '[^/]*$'), '')) AS n, substring(coalesce(content, ''), 1, 500) AS h FROM skills) SELECT id, starts_with(n, 'session') OR contains(n, 'session-') OR contains(n, 'session_') OR regexp_matches(h, '(?im)^tags:.*\\bsession\\b') OR contains(lower(h), 'session synopsis') OR contains(lower(h), 'session summary') OR contains(lower(h), 'session transcript') AS sessao FROM s")
def f15_sessions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "skills").select("id", C.looks_like_session(F.element_at(F.split("rel_path", "/"), -1), F.col("content")).alias("sessao"))


@query("SELECT doc_id, md5(replace(text, chr(0), ' ')) AS marca FROM documents")
def t04_indexable(spark: SparkSession, d: str) -> DataFrame:
    """Mark of every text as it is indexed."""
    return load(spark, d, "documents").select("doc_id", F.md5(C.indexable(F.col("text"))).alias("marca"))


@query(rows("id n texto", (1, 5, "abcde"), (2, 5, "açaí"[:3]), (3, 4, "👩"), (4, 3, ""), (5, 9, "ok"), (6, 3, None)))
def t55_first_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Cut at a character's border: ASCII, two bytes, four bytes, inside the first, nothing to cut, null."""
    t = [(1, 5, "abcdefg"), (2, 5, "açaí"), (3, 4, "👩x"), (4, 3, "👩"), (5, 9, "ok"), (6, 3, None)]
    df = spark.createDataFrame(t, "id int, n int, t string")
    pick = F.lit(None).cast("string")
    for n in (3, 4, 5, 9):
        pick = F.when(F.col("n") == n, C.first_bytes(F.col("t"), n)).otherwise(pick)
    return df.select("id", "n", pick.alias("texto"))


@query(rows("id rotulo cerca", (1, "ab", "<a>\n\n</a>"), (2, "x", "<a>\nola &lt;a> &lt;/a>\n</a>".replace("a> &lt;/a>", "a&gt; &lt;/a&gt;"))))
def t45_fences(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, "a\x00\x1fb", ""), (2, "xyz"[:1], "ola <a> </a>")]
    return spark.createDataFrame(t, "id int, r string, t string").select("id", C.clean_label(F.col("r")).alias("rotulo"), C.fenced(F.col("t"), "<a>", "</a>").alias("cerca"))


@query(rows("nota bloco", ("n1", "- [[a|Alfa]]\n- [[b]]")))
def t46_related(spark: SparkSession, d: str) -> DataFrame:
    h = [("n1", "x/b.md", "b", 0.7), ("n1", "x/a.md", "Alfa", 0.9), ("n1", "x/a.md", "Alfa", 0.8), ("n1", "x/gone.md", "G", 0.9), ("n1", "/abs/a.md", "A", 0.9), ("n1", None, "N", 0.9), ("n2", "x/a.md", "Alfa", 0.1)]
    return C.related_block(spark.createDataFrame(h, "nota string, caminho string, titulo string, sim double"), spark.createDataFrame([("x/a.md",), ("x/b.md",), ("/abs/a.md",)], "caminho string"), 0.5)


@query(rows("id chave antes depois", (1, "b", "2", "3"), (1, "api_token", "***", "***"), (1, "new", None, "x"), (1, "gone", "y", None), (1, "password", "***", None)))
def t63_config_changes(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([(1, '{"a": 1, "b": 2, "api_token": "k1", "gone": "y", "password": "p", "max_tokens": 5}')], "id int, json string")
    b = spark.createDataFrame([(1, '{"a": 1, "b": 3, "api_token": "k2", "new": "x", "max_tokens": 5}')], "id int, json string")
    return C.config_changes(a, b)


@query(rows("id tokens", (1, ["https://x.y/z", "src/a.py", "a.py", "b.toml", "E0432", "HTTP 503", "cargo run", "MAX_SIZE", "snake_case", "camelCase"]), (2, []), (3, [])))
def t11_durable_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, "Ver (https://x.y/z). MAX_SIZE em src/a.py e b.toml deu E0432 e HTTP 503: `cargo run`, snake_case, camelCase e `cargo run`"), (2, "prosa pura, nada mais"), (3, None)]
    return spark.createDataFrame(t, "id int, t string").select("id", C.durable_tokens(F.col("t")).alias("tokens"))


@query(rows("id texto", (1, "resumo\n\n## Retained facts\n\n- `a.py`\n\nfim\n"), (2, "o primeiro paragrafo\n\nfim\n"), (3, "fim\n")))
def t49_compacted(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, " resumo ", "# x\n\nver a.py"), (2, None, "# titulo\n\no  primeiro\nparagrafo\n\noutro"), (3, "", None)]
    return spark.createDataFrame(t, "id int, s string, b string").select("id", C.compacted(F.col("s"), F.col("b"), "fim").alias("texto"))


@query("SELECT id, md5(content) AS marca FROM skills WHERE trim(content, E' \\t\\r\\n') <> ''")
def t06_turn_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every skill cut as a transcript and put together again."""
    s = load(spark, d, "skills").where(F.btrim("content", F.lit(" \t\r\n")) != "")
    p = C.turn_pieces(s, "id", "content", 2000)
    whole = p.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parte", "texto"))), lambda x: x["texto"]), "").alias("t"))
    # blank ends are dropped: compared as they are but for those
    return s.select("id", "content").join(whole, "id").select("id", F.md5(F.when(F.rtrim("content", F.lit(" \t\r\n")) == F.rtrim("t", F.lit(" \t\r\n")), F.col("content")).otherwise(F.col("t"))).alias("marca"))


_TURNS = [("a", 1, "user", "arruma `src/x.py`"), ("a", 2, "assistant", "feito\n- [ ] testar\n- [x] ler\n- [ ] medir `b.md`"), ("a", 0, "user", "antes"), ("b", 1, "assistant", "so eu")]


@query(rows("c pedido resposta abertos arquivos", ("a", "arruma `src/x.py`", _TURNS[1][3], ["testar", "medir `b.md`"], ["src/x.py", "b.md"]), ("b", None, "so eu", [], [])))
def t57_handoff_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.handoff_summary(spark.createDataFrame(_TURNS, "c string, n int, papel string, texto string"), ["c"], "n")


@query(rows("caminho titulo", ("a/x.pdf", "Um titulo"), ("a/y.pdf", None)))
def t60_sidecars(spark: SparkSession, d: str) -> DataFrame:
    f = [("a/x.pdf", "..."), ("a/y.pdf", "..."), ("a/x.pdf.meta.yaml", "titulo: 'Um titulo'\nlista:\n  - a\nano: 2025\n")]
    return C.with_sidecars(spark.createDataFrame(f, "caminho string, texto string")).select("caminho", F.try_element_at("meta", F.lit("titulo")).alias("titulo"))


_HEADS = [
    (1, '---\ntitle: Um: dois\ntags: [a, "b, c", \'d\'\'e\']\n---\ncorpo'), (2, "---\naliases:\n  - Um nome\n  - \"Outro: nome\"\nx: 1\n---\n"), (3, "---\ntags: so um\n---\n"), (4, "sem cabeca"), (5, None),
]


@query(rows("id tags aliases", (1, ["a", "b, c", "d'e"], []), (2, [], ["Um nome", "Outro: nome"]), (3, ["so um"], []), (4, [], []), (5, [], [])))
def t16_front_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists in one line with quotes, in lines, of one value, of no head."""
    return spark.createDataFrame(_HEADS, "id int, t string").select("id", C.front_list(F.col("t"), "tags").alias("tags"), C.front_list(F.col("t"), "aliases").alias("aliases"))


@query(rows("id texto", (1, '---\ntitle: "Um: dois"\nok: simples\ntags: [a, "x: y", \'z\']\nn: "q: r"\n---\ncorpo: livre'), (2, "sem cabeca: x: y"), (3, "---\na: @b\n---\n".replace("@b", '"@b"'))))
def t58_repaired_heads(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, "---\ntitle: Um: dois\nok: simples\ntags: [a, x: y, 'z']\nn: \"q: r\"\n---\ncorpo: livre"), (2, "sem cabeca: x: y"), (3, "---\na: @b\n---\n")]
    return spark.createDataFrame(t, "id int, t string").select("id", C.repaired_head(F.col("t")).alias("texto"))


@query(rows("nome em:TIMESTAMP", ("Screenshot_20250301-101530.png", "2025-03-01 10:15:30"), ("IMG-2024-02-29 at 23.59.01.jpg", "2024-02-29 23:59:01"), ("2023_12_24.png", "2023-12-24 00:00:00"), ("20230231.png", None), ("foto.png", None), ("1234567890123.png", None)))
def t59_capture_dates(spark: SparkSession, d: str) -> DataFrame:
    n = ["Screenshot_20250301-101530.png", "IMG-2024-02-29 at 23.59.01.jpg", "2023_12_24.png", "20230231.png", "foto.png", "1234567890123.png"]
    return spark.createDataFrame([(x,) for x in n], "nome string").select("nome", C.capture_date(F.col("nome")).alias("em"))


@query("SELECT id, list_distinct(list_filter(list_transform(regexp_extract_all(texto, '([\\p{L}\\p{N}_][\\p{L}\\p{N}_.\\-]*)', 1), lambda t: lower(trim(t, '.-'))), lambda t: length(t) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "], t)))[1:24].len() AS termos FROM consultas WHERE texto IS NOT NULL")
def t07_query_terms(spark: SparkSession, d: str) -> DataFrame:
    """How many terms each query has."""
    return load(spark, d, "consultas").where("texto IS NOT NULL").select("id", F.size(R.query_terms(F.col("texto"))).cast("long").alias("termos"))


@query("WITH s AS (SELECT id, greatest(1800000000 - em, 0) AS s FROM consultas WHERE em IS NOT NULL) SELECT id, CASE WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || ' min' WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || ' h' WHEN s < 2592000 THEN CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || ' d' ELSE CAST(CAST(floor(s / 2592000) AS BIGINT) AS VARCHAR) || ' m' END AS idade FROM s")
def t21_ages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "consultas").where("em IS NOT NULL").select("id", X.human_age(F.lit(1_800_000_000.0) - F.col("em")).alias("idade"))
