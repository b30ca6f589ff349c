"""Queries of queues, schedules, conversations and composed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import claims as C
from garimpo.operators import conversations as V
from garimpo.operators import jobs as J
from garimpo.operators import queues as Q
from garimpo.operators import ranking as R
from garimpo.plans.graphs import nodes_of
from garimpo.plans.more import _JUNK_NAME
from garimpo.plans.registry import registry, rows
from garimpo.operators import notes as N
from garimpo.runtime import load

QUERIES, ORACLE, query = registry()


# schedules, queues, locks

@query(rows("id proxima:TIMESTAMP", (1, "2025-03-03 08:00:00"), (2, "2025-03-01 10:45:00"), (3, "2025-04-01 00:00:00"), (4, "2028-02-29 12:00:00"), (5, None), (6, "2025-03-03 00:00:00"), (7, None), (8, "2025-03-01 11:00:00")))
def t20_next_fires(spark: SparkSession, d: str) -> DataFrame:
    """From a Saturday morning: working days, quarters, the month's first, a leap day, a day that never is, either day field, no schedule, a name."""
    s = [(1, "0 8 * * 1-5"), (2, "*/15 * * * *"), (3, "0 0 1 * *"), (4, "0 12 29 2 *"), (5, "0 0 31 2 *"), (6, "0 0 15 * 1"), (7, "61 * * * *"), (8, "@hourly")]
    df = spark.createDataFrame(s, "id int, cron string")
    return df.select("id", Q.cron_next(F.lit("2025-03-01 10:30:20").cast("timestamp_ntz"), F.col("cron")).alias("proxima"))


@query(rows("nome devida ancora:TIMESTAMP", ("due", True, "2025-03-01 09:00:00"), ("later", False, "2025-03-01 10:01:00"), ("new", False, "2025-03-01 10:30:00"), ("off", False, "2025-03-01 01:00:00"), ("runs", False, "2025-03-01 09:00:00")))
def x03_due_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("due", "0 * * * *", True), ("later", "0 * * * *", True), ("new", "* * * * *", True), ("off", "* * * * *", False), ("runs", "0 * * * *", True)], "nome string, cron string, ligada boolean")
    s = spark.createDataFrame([("due", "2025-03-01 09:00:00", False), ("later", "2025-03-01 10:01:00", None), ("off", "2025-03-01 01:00:00", False), ("runs", "2025-03-01 09:00:00", True)], "nome string, ancora string, rodando boolean")
    return Q.schedule_step(t, s, "2025-03-01 10:30:00").select("nome", "devida", "ancora")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey) AS vez FROM orders WHERE o_orderstatus = 'O'")
def k07_claim_order(spark: SparkSession, d: str) -> DataFrame:
    """Open orders as a queue: priority, then age."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prioridade"), F.col("o_orderdate").alias("criada"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("estado"))
    return Q.claim_order(o).select("id", "vez")


@query(rows("fila id", ("a", 3), ("b", 5)))
def k08_next_runnable(spark: SparkSession, d: str) -> DataFrame:
    """The oldest that is queued, or scheduled and due."""
    t = [(1, "a", "scheduled", 1.0, 99.0), (2, "a", "running", 0.0, None), (3, "a", "scheduled", 2.0, 9.0), (4, "a", "queued", 3.0, None), (5, "b", "queued", 7.0, None), (6, "c", "scheduled", 1.0, None)]
    return Q.next_runnable(spark.createDataFrame(t, "id int, fila string, estado string, criada double, depois double"), "fila", 10.0)


@query(rows("id vez:BIGINT", (3, 1), (2, 2), (1, 3), (5, 4)))
def k09_questions(spark: SparkSession, d: str) -> DataFrame:
    t = [(1, "aberta", "baixa", 1.0), (2, "aberta", "Alta", 5.0), (3, "aberta", "alta", 2.0), (4, "fechada", "alta", 0.0), (5, "aberta", "outra", 0.0)]
    return Q.open_questions(spark.createDataFrame(t, "id int, estado string, gravidade string, criada double"), {"alta": 0, "media": 1, "baixa": 2}).select("id", "vez")


@query(rows("em:DOUBLE agente acao concedido", (1.0, "a", "pede", True), (2.0, "b", "pede", True), (3.0, "c", "pede", False), (4.0, "a", "pede", False), (5.0, "a", "solta", True), (6.0, "c", "pede", True), (7.0, "x", "solta", False), (400.0, "d", "pede", True)))
def x08_locks(spark: SparkSession, d: str) -> DataFrame:
    """Two at a time: a third waits until one is given back; old locks run out."""
    a = [(1.0, "a", "pede"), (2.0, "b", "pede"), (3.0, "c", "pede"), (4.0, "a", "pede"), (5.0, "a", "solta"), (6.0, "c", "pede"), (7.0, "x", "solta"), (400.0, "d", "pede")]
    return Q.locked(spark.createDataFrame([("g", *r) for r in a], "grupo string, em double, agente string, acao string"), 2).drop("grupo")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 25 AS dentro FROM events")
def x08_budget(spark: SparkSession, d: str) -> DataFrame:
    return Q.within_budget(load(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "dentro")


@query("""WITH RECURSIVE c AS (SELECT cliente, ferramenta, em, row_number() OVER (PARTITION BY cliente, ferramenta ORDER BY em) AS i FROM (SELECT DISTINCT cliente, ferramenta, em FROM chamadas) WHERE em IS NOT NULL),
r AS (SELECT cliente, ferramenta, em, i, em AS feito, false AS do_cache FROM c WHERE i = 1 UNION ALL SELECT c.cliente, c.ferramenta, c.em, c.i, CASE WHEN c.em - feito <= 86400 THEN feito ELSE c.em END, c.em - feito <= 86400 FROM r JOIN c ON c.i = r.i + 1 AND c.cliente IS NOT DISTINCT FROM r.cliente AND c.ferramenta IS NOT DISTINCT FROM r.ferramenta)
SELECT cliente, ferramenta, em, do_cache FROM r""")
def x11_cached_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls that a cache of one day would have answered."""
    c = load(spark, d, "chamadas").select("cliente", "ferramenta", "em").distinct()
    return Q.cached_results(c, ["cliente", "ferramenta"], "em", 86_400.0)


@query(rows("em:DOUBLE acao resultado", (1.0, "aprova", "aprovado"), (2.0, "usa", "usado"), (3.0, "usa", "pendente"), (4.0, "aprova", "aprovado"), (200.0, "usa", "pendente"), (5.0, "usa", "pendente")))
def x11_approvals(spark: SparkSession, d: str) -> DataFrame:
    """An approval is good once, for its arguments, until it runs out."""
    e = [("c", "f", "x", 1.0, "aprova"), ("c", "f", "x", 2.0, "usa"), ("c", "f", "x", 3.0, "usa"), ("c", "f", "x", 4.0, "aprova"), ("c", "f", "x", 200.0, "usa"), ("c", "f", "y", 5.0, "usa")]
    return Q.consumed_approvals(spark.createDataFrame(e, "cliente string, ferramenta string, args string, em double, acao string"), 100.0).select("em", "acao", "resultado")


@query("WITH l AS (SELECT DISTINCT cliente AS leitor FROM chamadas WHERE cliente IS NOT NULL), i AS (SELECT DISTINCT caminho AS id FROM devolvidas WHERE caminho IS NOT NULL), s AS (SELECT DISTINCT cliente AS leitor, ferramenta AS id FROM chamadas) SELECT leitor, id FROM i, l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.leitor = l.leitor AND s.id = i.id)")
def x13_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Returned paths that each client has not seen; what they called stands for what they saw."""
    c = load(spark, d, "chamadas").where("cliente IS NOT NULL")
    return Q.unseen(load(spark, d, "devolvidas").where("caminho IS NOT NULL").select(F.col("caminho").alias("id")), c.select(F.col("cliente").alias("leitor"), F.col("ferramenta").alias("id")), c.select(F.col("cliente").alias("leitor")))


@query(rows("cartao mudou novos:BIGINT sumiram:BIGINT", ("a", True, 1, 1), ("b", False, 0, 0), ("c", True, 0, 0), ("d", True, 0, 0)))
def u04_card_deltas(spark: SparkSession, d: str) -> DataFrame:
    """A card with a path more and one less, one that is the same, one with a newer path, and one never read."""
    s = "cartao string, caminho string, mtime double"
    return Q.card_delta(spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 1.2), ("c", "x", 1.0)], s), spark.createDataFrame([("a", "x", 1.0), ("a", "z", 1.0), ("b", "x", 1.4), ("c", "x", 9.0), ("d", "x", 1.0)], s))


@query("""WITH b AS (SELECT title AS caminho, max(md5(content)) AS m FROM skills WHERE title IS NOT NULL AND indexed_at < '2025-10-01' GROUP BY 1), w AS (SELECT title AS caminho, max(md5(content)) AS m FROM skills WHERE title IS NOT NULL AND indexed_at >= '2025-10-01' GROUP BY 1)
SELECT caminho, CASE WHEN w.caminho IS NULL THEN 'apagar' WHEN b.caminho IS NOT NULL AND w.m IS NOT DISTINCT FROM b.m THEN 'manter' ELSE 'escrever' END AS acao FROM w FULL JOIN b USING (caminho)""")
def u02_filing_plan(spark: SparkSession, d: str) -> DataFrame:
    """Titles indexed before a day against those from it on."""
    s = load(spark, d, "skills").where("title IS NOT NULL").select(F.col("title").alias("caminho"), F.md5("content").alias("marca"), "indexed_at")
    return Q.filing_plan(s.where("indexed_at >= '2025-10-01'"), s.where("indexed_at < '2025-10-01'"))


@query(rows("k itens", (1, ["a", "b c", "d"]), (2, []), (3, None)))
def u10_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(1, [" a", "b c", "a", "", None, "d "]), (2, [""]), (3, None)], "k int, x array<string>").select("k", Q.distinct_in_order(F.col("x")).alias("itens"))


# conversations

_OPS = [("c", 1, "read", "f", None, None), ("c", 2, "read", "f", 10, 20), ("c", 3, "read", "g", None, None), ("c", 4, "edit", "g", None, None), ("c", 5, "read", "f", 0, 100), ("c", 6, "read", "g", None, None), ("c", 7, "read", "f", 50, None), ("d", 1, "read", "f", 5, 5)]


@query(rows("conv idx:BIGINT estado", ("c", 1, "fresh"), ("c", 2, "superseded"), ("c", 3, "stale"), ("c", 5, "fresh"), ("c", 6, "fresh"), ("c", 7, "fresh"), ("d", 1, "fresh")))
def t51_read_states(spark: SparkSession, d: str) -> DataFrame:
    """A whole read that no later part covers, a part that one does, a read before an edit, and the last ones."""
    return V.read_states(spark.createDataFrame(_OPS, "conv string, idx int, op string, arquivo string, inicio int, limite int"))


_L = [f"linha numero {i} do arquivo" for i in range(8)]
_CONV = [("c", 1, "assistant", "\n".join(_L)), ("c", 2, "user", "\n".join(_L[2:6])), ("c", 3, "assistant", "antes\n" + "\n".join(f"  {i}\t{x}" for i, x in enumerate(_L[2:7], 90)) + "\ndepois"), ("c", 4, "assistant", "\n".join(_L[:2])), ("d", 9, "assistant", "\n".join(_L))]


@query(rows("conv turno ini fim de_turno de_linha", ("c", 3, 1, 5, 1, 2)))
def d17_repeated_spans(spark: SparkSession, d: str) -> DataFrame:
    """Five lines, numbered now, that an earlier turn showed; the user's turn stays, two lines are too few."""
    return V.repeated_spans(spark.createDataFrame(_CONV, "conv string, turno int, papel string, texto string"))


@query(rows("turno texto", (1, "\n".join(_L)), (2, "\n".join(_L[2:6])), (3, "antes\n[... 5 lines as in turn 1, line 3]\ndepois"), (4, "\n".join(_L[:2])), (9, "\n".join(_L))))
def d17_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame(_CONV, "conv string, turno int, papel string, texto string")
    return V.without_repeats(t, V.repeated_spans(t)).select("turno", "texto")


@query(rows("turno texto menos", (1, "[read: superseded]", True), (2, "pergunta", False), (3, "\n".join(_L), False), (4, '{"a":1,"b":[1,2]}', True), (5, "[... 8 lines as in turn 3, line 1]", True)))
def c15_shorter_conversation(spark: SparkSession, d: str) -> DataFrame:
    """A read that a later one covers, the user's question, the later read, a result in JSON, and a repeat of the read."""
    t = [("c", 1, "assistant", "\n".join(_L[:5])), ("c", 2, "user", "pergunta"), ("c", 3, "assistant", "\n".join(_L)), ("c", 4, "assistant", '{"a": 1,   "b": [1, 2]}'), ("c", 5, "assistant", "\n".join(_L))]
    o = spark.createDataFrame([("c", 1, "read", "f", 0, 5), ("c", 3, "read", "f", None, None)], "conv string, idx int, op string, arquivo string, inicio int, limite int")
    s = V.shorter(spark.createDataFrame(t, "conv string, turno long, papel string, texto string"), o)
    return s.select(F.col("turno").cast("int").alias("turno"), "texto", (F.col("depois") < F.col("antes")).alias("menos"))


# composed jobs

_SECTIONS = "len(list_filter(string_split(regexp_replace(E'\\n' || regexp_replace(content, E'\\n(#{1,2}[ \\t]+[^ \\t\\n\\r\\f\\v])', E'\\n\\x01\\\\1', 'g'), E'^\\n(#{1,2}[ \\t]+\\\\S)', E'\\n\\x01\\\\1'), E'\\x01'), lambda p: trim(p, E' \\t\\r\\n') <> ''))"


@query(f"""WITH s AS (SELECT id, lower(coalesce(regexp_extract(rel_path, '[^/]*$'), '')) AS n, rel_path, content, substring(coalesce(content, ''), 1, 500) AS h FROM skills)
SELECT id, CASE WHEN coalesce({_JUNK_NAME}, false) OR {" OR ".join(f"coalesce(contains(lower(substring(content, 1, 500)), '{t}'), false)" for t in N.JUNK_TEXT)} THEN 'descartar'
WHEN starts_with(n, 'session') OR contains(n, 'session-') OR contains(n, 'session_') OR regexp_matches(h, '(?im)^tags:.*\\bsession\\b') OR contains(lower(h), 'session synopsis') OR contains(lower(h), 'session summary') OR contains(lower(h), 'session transcript') THEN 'sessao'
WHEN length(content) >= 3000 AND len(regexp_extract_all(E'\\n' || content, E'\\n#{{1,2}}[ \\t]+[^ \\t\\r\\n]')) + CASE WHEN trim(regexp_extract(E'\\n' || content, E'^((?:\\n|[^#\\n][^\\n]*|#{{3,}}[^\\n]*)*)', 1), E' \\t\\r\\n') <> '' THEN 1 ELSE 0 END >= 2 THEN 'dividir' ELSE 'arquivar' END AS acao FROM s""")
def c01_inbox_plan(spark: SparkSession, d: str) -> DataFrame:
    """What happens to each skill as a new file."""
    return J.inbox_plan(load(spark, d, "skills"), "id", "rel_path", "content").select("id", "acao")


@query("SELECT id, coalesce(melhor, 0.0) AS nota FROM consultas WHERE coalesce(melhor, 0) < 0.5 ORDER BY nota, id LIMIT 20")
def c02_to_mend(spark: SparkSession, d: str) -> DataFrame:
    return J.to_mend(load(spark, d, "consultas"), "id", F.col("melhor"), 20)


@query("""WITH n AS (SELECT id AS nota, sha256('v2' || chr(0) || content) AS assinatura FROM skills WHERE content IS NOT NULL), d AS (SELECT id AS nota, sha256('v2' || chr(0) || content) AS a FROM skills WHERE category IS NOT NULL UNION ALL SELECT id, sha256('v1' || chr(0) || content) FROM skills)
SELECT nota, assinatura FROM n WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.nota = n.nota AND d.a = n.assinatura)""")
def c03_pending(spark: SparkSession, d: str) -> DataFrame:
    """Skills that only an older prompt has seen."""
    s = load(spark, d, "skills").where("content IS NOT NULL")
    sign = lambda p: F.sha2(F.concat_ws("\0", F.lit(p), "content"), 256).alias("assinatura")
    done = s.where("category IS NOT NULL").select(F.col("id").alias("nota"), sign("v2")).union(s.select("id", sign("v1")))
    return J.pending_extractions(s.select(F.col("id").alias("nota"), F.col("content").alias("texto")), done, "v2")


@query(rows("nota v", ("a", 9), ("c", 3)))
def c03_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a note that was looked at are replaced, those of one without new facts go, others stay."""
    f = lambda r: spark.createDataFrame(r, "nota string, v int")
    return J.replaced_facts(f([("a", 1), ("a", 2), ("b", 2), ("c", 3)]), f([("a", 9)]), f([("a", 0), ("b", 0)]))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS nova, b.vec_id AS antiga, round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS cos FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0)
SELECT nova, antiga, cos FROM (SELECT *, row_number() OVER (PARTITION BY nova ORDER BY cos DESC, antiga) AS k FROM s) WHERE k <= 3 AND cos >= 0.2""")
def c04_dream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose id is divisible by 100 as the recent notes, all others as the older ones."""
    e = load(spark, d, "embeddings")
    return J.dream_pairs(e.where("vec_id % 100 = 0"), e.where("vec_id % 100 <> 0"), "vec_id", "embedding", 3, 0.2)


@query(rows("nova antiga veredito confirmado", (1, 2, "atualiza", True), (1, 3, "contradiz", False)))
def c04_judged(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8)], "nova int, antiga int, cos double")
    said = lambda x: x.withColumn("veredito", F.when(F.col("antiga") == 2, "atualiza").otherwise("contradiz")).withColumn("citacao", F.when(F.col("antiga") == 2, "a porta agora e 8797").otherwise("nunca foi dito assim"))
    return J.judged(p, said, spark.createDataFrame([(1, "Decidido: a **porta** agora é 8797.")], "id int, texto string")).drop("citacao")


_AGE = "greatest((1800000000 - {}) / 86400.0, 0)"


@query(f"""WITH s AS (SELECT hash AS id, min(em) AS a, max(em) AS z, count(*) AS n FROM consultas WHERE hash IS NOT NULL AND em IS NOT NULL GROUP BY 1), r AS (SELECT id, n, exp(-0.02 * {_AGE.format('a')}) + 0.6 * ln(1.0 + n) * exp(-0.04 * {_AGE.format('z')}) AS nota FROM s)
SELECT id, CASE WHEN n = 1 AND nota < 0.05 THEN 'expirada' ELSE 'compactar' END AS plano, round(nota, 6) AS nota FROM r WHERE nota < 0.20 OR (n = 1 AND nota < 0.05) ORDER BY CASE WHEN n = 1 AND nota < 0.05 THEN 0 ELSE 1 END, round(nota, 6), id LIMIT 50""")
def c05_retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Query texts as notes; those asked once and all but forgotten have run out."""
    from garimpo.operators import usage as U

    s = load(spark, d, "consultas").where("hash IS NOT NULL AND em IS NOT NULL").groupBy(F.col("hash").alias("id")).agg(F.min("em").alias("a"), F.max("em").alias("z"), F.count("*").alias("acessos"))
    days = lambda c: (F.lit(1_800_000_000.0) - F.col(c)) / 86400.0
    f = F.lit(False)
    s = s.withColumn("idade", days("a")).withColumn("parado", days("z"))
    s = s.withColumn("vencida", (F.col("acessos") == 1) & (U.retention(F.col("idade"), F.col("acessos"), F.col("parado")) < 0.05))
    return J.retention_sweep(s.select("id", "idade", "acessos", "parado", F.lit("episodic").alias("camada"), f.alias("fixada"), "vencida", f.alias("compactada")), 50)


@query("SELECT run_id AS id FROM dag_runs WHERE run_id NOT IN (SELECT run_id FROM dag_step_runs WHERE run_id IS NOT NULL) AND coalesce(total_steps, 0) > 0")
def c06_undigested(spark: SparkSession, d: str) -> DataFrame:
    """Runs as sessions, their steps as digests, runs without steps as empty ones."""
    r = load(spark, d, "dag_runs").select(F.col("run_id").alias("id"), "total_steps")
    return J.undigested(r.select("id"), load(spark, d, "dag_step_runs").select(F.col("run_id").alias("sessao")), r.where("coalesce(total_steps, 0) <= 0"))


@query(rows("nota id citado", (1, "gravar", "gravar_indice()"), (2, "rrf", "Busca.rrf()")))
def c07_notes_on_changed_code(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(1, "ver `gravar_indice()` e `ler_indice()`"), (2, "usa `Busca.rrf()`"), (3, "`FusaoRRF`"), (4, None)], "nota int, texto string")
    r = spark.createDataFrame([("src/indice.py", 12, 14), ("src/fusao.py", 20, 20)], "source_file string, ini long, fim long")
    return J.notes_on_changed_code(nodes_of(spark), r, t, "nota", "texto", "motor")


@query(rows("id caminho ancestral", (1, "/opt/x/gone.py", "/opt/x")))
def c08_dead_references(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(1, "`/opt/x/gone.py` e `/opt/x/a.py`", False), (2, "`/opt/x/gone.py`", True)], "id int, t string, velho boolean")
    return J.dead_references(t, "id", "t", F.col("velho"), spark.createDataFrame([("/opt/x/a.py",)], "caminho string"), "/home/ana").select("id", "caminho", "ancestral")


@query(rows("caminho pos estado", ("a", 1, "aplicada"), ("a", 2, "velha"), ("a", 3, "aplicada"), ("b", 1, "velha"), ("z", 1, "sem nota")))
def c09_guarded_edits(spark: SparkSession, d: str) -> DataFrame:
    """An edit on the note's text, one on the text before it, one on what the first made, one on another text, one of no note."""
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = spark.createDataFrame([("a", "v1"), ("b", "w1")], "caminho string, texto string")
    e = spark.createDataFrame([("a", 1, h("v1"), "v2"), ("a", 2, h("v1"), "v3"), ("a", 3, h("v2"), "v4"), ("b", 1, h("x"), "w2"), ("z", 1, h("x"), "y")], "caminho string, pos long, base string, novo string")
    return Q.guarded_edits(n, e)


@query(rows("nota fonte", ("n1", "in/Relatorio Anual.pdf"), ("n2", "in/Relatorio Anual.pdf")))
def c10_unreadable(spark: SparkSession, d: str) -> DataFrame:
    n = spark.createDataFrame([("n1", "x/relatorio-anual.md"), ("n2", "Relatorio_Anual.pdf"), ("n3", "outro.pdf")], "nota string, fonte string")
    return J.unreadable_sources(n, spark.createDataFrame([("in/Relatorio Anual.pdf", False), ("in/outro.pdf", True)], "caminho string, legivel boolean"))


@query(f"""WITH s AS (SELECT id, rel_path, content, length(content) AS n FROM skills WHERE NOT (coalesce({_JUNK_NAME}, false) OR {" OR ".join(f"coalesce(contains(lower(substring(content, 1, 500)), '{t}'), false)" for t in N.JUNK_TEXT)}) AND length(trim(coalesce(content, ''), ' ')) > 0)
SELECT id, CASE WHEN n <= 3072 THEN 1 ELSE CAST(ceil((n - 200) / 2872.0) AS BIGINT) END AS pedacos FROM s""")
def c11_rebuilt_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each skill in an index made anew."""
    return J.rebuilt_index(load(spark, d, "skills"), "id", "rel_path", "content").groupBy("id").agg(F.count("*").alias("pedacos"))


@query(rows("p o linha", ("x", 1, "T1: corpo um"), ("x", 2, "T2: abertura"), ("x", 3, "T3"), ("y", 1, "U1: u")))
def c12_session_brief(spark: SparkSession, d: str) -> DataFrame:
    """Whole, its opening, its title, nothing: as long as the budget lasts."""
    i = [("x", 1, "T1", "corpo um"), ("x", 2, "T2", "# h\n\nabertura\n\n" + "z" * 50), ("x", 3, "T3", "q" * 40), ("x", 4, "T4", "w" * 40), ("y", 1, "U1", "u")]
    return J.session_brief(spark.createDataFrame(i, "p string, o int, t string, b string"), "p", ["o"], "t", "b", 27)


@query(rows("id titulo corpo", (1, "T", "S\n- a (x)\n- b (?)"), (2, "U", "")))
def c13_evidence(spark: SparkSession, d: str) -> DataFrame:
    b = [(1, '{"title": "T", "summary": "S", "evidence": [{"claim": "a", "source": "x"}, {"claim": "b"}], "open_questions": ["q", "q"]}'), (2, '{"title": "U"}'), (3, "no json"), (4, None)]
    return J.evidence_notes(spark.createDataFrame(b, "id int, json string"))[0]


@query("SELECT id, indexed_at FROM skills WHERE category IS NOT NULL AND indexed_at IS NOT NULL AND (indexed_at < (SELECT max(indexed_at) FROM skills WHERE category IS NOT NULL) OR id > (SELECT min(id) FROM skills WHERE category IS NOT NULL AND indexed_at = (SELECT max(indexed_at) FROM skills WHERE category IS NOT NULL))) ORDER BY indexed_at DESC, id LIMIT 25")
def c14_second_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of records behind the first one."""
    s = load(spark, d, "skills").where("indexed_at IS NOT NULL")
    scope = F.col("category").isNotNull()
    first = J.page(s, scope, "indexed_at", "id", None, 1).first()
    after = None if first is None else (first["indexed_at"], first["id"])
    return J.page(s, scope, "indexed_at", "id", after, 25).select("id", "indexed_at")


@query(rows("caminho v", ("c.md", 1), ("c.md", 2), ("z.md", 3)))
def c16_renamed_versions(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([("a.md", 1), ("b.md", 2), ("z.md", 3)], "caminho string, v int")
    return Q.following_versions(v, spark.createDataFrame([("a.md", "b.md"), ("b.md", "c.md"), ("q.md", "q.md")], "de string, para string"))


@query(rows("id texto", (1, "velha\n\n---\n\nnova A\n\n---\n\nnova B"), (2, "grande"), (3, "longe")))
def d16_merged_notes(spark: SparkSession, d: str) -> DataFrame:
    """Two new notes go into the first similar note that is small enough."""
    r = spark.createDataFrame([(10, 2, 0.95, 1), (10, 1, 0.9, 2), (11, 1, 0.89, 1), (12, 3, 0.5, 1)], "qid int, doc int, cos double, posicao int")
    old = spark.createDataFrame([(1, "velha"), (2, "grande"), (3, "longe")], "id int, texto string")
    t = J.merge_target(r, spark.createDataFrame([(1, 5), (2, 99_999), (3, 5)], "doc int, n int"))
    return J.merged_notes(t, spark.createDataFrame([(10, "nova A"), (11, "nova B"), (12, "nova C")], "id int, texto string"), old, "---")


@query("WITH s AS (SELECT id, regexp_replace(regexp_replace(coalesce(content, ''), '(?s)\\A---\\r?\\n.*?\\r?\\n---\\r?\\n?', ''), '(?s)```.*?```', '', 'g') AS b FROM skills), p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(b, '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '' AND NOT regexp_matches(p, '^(#|[-*+] |\\d+\\. |>|\\||!\\[|\\[\\[)')) AS p FROM s) SELECT id, coalesce(p[1], '') AS abertura FROM p")
def t26_openings(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "skills").select("id", J.opening_excerpt(F.col("content")).alias("abertura"))
