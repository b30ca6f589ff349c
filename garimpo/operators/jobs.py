"""Composed jobs: what each of them would do next, as tables. Models are inputs: their answers come as tables, or as a function of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import claims as C
from garimpo.functions import texts as X
from garimpo.operators import codegraph as G
from garimpo.operators import notes as N
from garimpo.operators import ranking as R
from garimpo.operators import usage as U

#: Characters from which a text is split; quality under which a note is to be mended.
SPLIT, MEND = 3000, 0.5


def inbox_plan(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """``(key, acao, secoes)`` for new files: descartar boilerplate, sessao for session logs, dividir long texts with several sections, else arquivar."""
    name = F.element_at(F.split(path, "/"), -1)
    s = files.select(key, path, text)
    n = N.sections(s, key, text).groupBy(key).agg(F.count("*").alias("secoes"))
    j = s.join(n, key, "left").withColumn("secoes", F.coalesce("secoes", F.lit(0)))
    act = F.when(N.is_junk(F.col(path), F.col(text)), "descartar").when(C.looks_like_session(name, F.col(text)), "sessao").when((F.length(text) >= SPLIT) & (F.col("secoes") >= 2), "dividir").otherwise("arquivar")
    return j.select(key, act.alias("acao"), "secoes")


def to_mend(notes: DataFrame, key: str, quality: Column, limit: int) -> DataFrame:
    """``(key, nota)``: up to ``limit`` notes under the least quality, the worst first; what cannot be read counts 0."""
    q = F.coalesce(quality.try_cast("double"), F.lit(0.0))
    return notes.select(key, q.alias("nota")).where(F.col("nota") < MEND).orderBy("nota", key).limit(limit)


def pending_extractions(notes: DataFrame, done: DataFrame, prompt: str) -> DataFrame:
    """``(nota, assinatura)`` of notes ``(nota, texto)`` whose text and prompt no run ``(nota, assinatura)`` has seen."""
    n = notes.where("texto IS NOT NULL").select("nota", F.sha2(F.concat_ws("\0", F.lit(prompt), "texto"), 256).alias("assinatura"))
    return n.join(done.select("nota", "assinatura").distinct(), ["nota", "assinatura"], "left_anti")


def replaced_facts(old: DataFrame, new: DataFrame, looked_at: DataFrame) -> DataFrame:
    """Facts after a run: those of notes that were looked at are the new ones, none if it found none."""
    return old.join(looked_at.select("nota").distinct(), "nota", "left_anti").unionByName(new.join(looked_at.select("nota").distinct(), "nota", "left_semi").select(old.columns))


def dream_pairs(recent: DataFrame, older: DataFrame, key: str, vec: str, k: int = 3, least: float = 0.6) -> DataFrame:
    """``(nova, antiga, cos)``: for each recent note the most similar older ones that a judge should look at."""
    base = older.select(key, vec)
    near = R.knn_blocks(base, recent.select(key, vec), key, vec, k)
    return near.where(F.col("cos") >= least).select(F.col("qid").alias("nova"), F.col("doc").alias("antiga"), "cos")


def judged(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame], texts: DataFrame) -> DataFrame:
    """``(nova, antiga, veredito, citacao, confirmado)``: the judge's answers, confirmed if their quotation is in the newer note ``(id, texto)``."""
    j = judge(pairs).join(texts.select(F.col("id").alias("nova"), "texto"), "nova", "left")
    return j.select("nova", "antiga", "veredito", "citacao", C.quoted(F.col("citacao"), F.col("texto")).alias("confirmado"))


def retention_sweep(notes: DataFrame, limit: int) -> DataFrame:
    """``(id, plano, nota)``: what is to be compacted or forgotten, the coldest first, up to ``limit``.

    ``notes``: (id, idade, acessos, parado, camada, fixada, vencida, compactada) with ages in days.
    """
    score = U.retention(F.col("idade"), F.col("acessos"), F.col("parado"))
    plan = U.retention_plan(score, F.col("camada"), F.col("fixada"), F.col("vencida"), F.col("compactada"))
    d = notes.select("id", plan.alias("plano"), F.round(score, 6).alias("nota")).where("plano <> 'manter'")
    return d.orderBy(F.desc(F.col("plano") == "expirada"), "nota", "id").limit(limit)


def undigested(sessions: DataFrame, curated: DataFrame, empty: DataFrame) -> DataFrame:
    """Sessions ``(id)`` without a curated note ``(sessao)`` that are not known to be empty ``(id)``."""
    return sessions.join(curated.select(F.col("sessao").alias("id")).distinct(), "id", "left_anti").join(empty.select("id").distinct(), "id", "left_anti")


def notes_on_changed_code(nodes: DataFrame, ranges: DataFrame, texts: DataFrame, key: str, text: str, graph: str) -> DataFrame:
    """``(key, id, citado)``: notes that cite a node whose lines changed."""
    bare = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"([^.]+(?:\(\))?)$", 1), r"\(\)$", ""))
    label = F.coalesce("label", F.lit(""))
    key_of = F.when(label.rlike(G.CODE_FILE), F.lower(label)).otherwise(bare(label))
    index = nodes.select(F.lit(graph).alias("grafo"), "id", key_of.alias("chave"))
    touched = G.touched_nodes(nodes, ranges).select("id").distinct()
    return G.cited_nodes(texts, key, text, index).join(touched, "id", "left_semi").select(key, "id", "citado")


def dead_references(texts: DataFrame, key: str, text: str, historical: Column, inventory: DataFrame, home: str) -> DataFrame:
    """``(key, caminho, ancestral, sugestoes)`` of dead paths in notes that are not historical."""
    live = texts.where(~F.coalesce(historical, F.lit(False)))
    return C.checked_paths(C.path_references(live, key, text, home), inventory, key).where("NOT existe").drop("existe")


def unreadable_sources(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """``(nota, fonte)``: notes ``(nota, fonte)`` made from sources ``(caminho, legivel)`` that could not be read, by the name without folder, ending and signs."""
    norm = lambda c: F.regexp_replace(F.lower(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")), r"[^\p{L}\p{N}]+", "-")
    bad = sources.where("NOT legivel").select(norm(F.col("caminho")).alias("k"), F.col("caminho").alias("fonte")).groupBy("k").agg(F.min("fonte").alias("fonte"))
    return notes.select("nota", norm(F.col("fonte")).alias("k")).join(bad, "k").select("nota", "fonte").distinct()


def rebuilt_index(notes: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """The index made anew from its sources: chunks of every text that has substance and is no boilerplate; ``(key, chunk_id, i, inicio, chunk)``."""
    ok = notes.where(~N.is_junk(F.col(path), F.col(text)) & (F.length(F.btrim(F.coalesce(text, F.lit("")))) > 0))
    return X.fixed_chunks(ok, key, path, text)


def session_brief(items: DataFrame, by: str, order: list[str], title: str, text: str, budget: int) -> DataFrame:
    """``(by, pos, linha)``: what a session reads first: each item whole, as its opening, or as its title, until the budget of characters is spent."""
    opening = F.substring(opening_excerpt(F.col(text)), 1, 200)
    d = items.select(by, *order, title, text, F.length(title).alias("l1"), (F.length(title) + 2 + F.length(opening)).alias("l2"), (F.length(title) + 2 + F.length(text)).alias("l3"), opening.alias("__opening"))
    d = d.where(F.col(by).isNotNull()).fillna(0, ["l1", "l2", "l3"])
    level = N.budget_levels(d, by, order, ["l1", "l2", "l3"], budget).select(by, *order, "nivel")
    j = d.join(level, [by, *order])
    line = F.when(F.col("nivel") == 3, F.concat(F.col(title), F.lit(": "), F.col(text))).when(F.col("nivel") == 2, F.concat(F.col(title), F.lit(": "), F.col("__opening"))).otherwise(F.col(title))
    return j.where("nivel > 0").select(by, *order, line.alias("linha"))


def opening_excerpt(text: Column) -> Column:
    """The first paragraph of prose: behind the head, without headings, lists, quotes, tables and code; empty if there is none."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", ""), r"(?s)```.*?```", "")
    prose = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: F.btrim(F.regexp_replace(p, r"\s+", " "))), lambda p: (p != "") & ~p.rlike(r"^(#|[-*+] |\d+\. |>|\||!\[|\[\[)"))
    return F.coalesce(F.try_element_at(prose, F.lit(1)), F.lit(""))


def evidence_notes(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes ``(id, titulo, corpo)`` and open questions ``(id, pergunta)`` of evidence bundles ``(id, json)``; what is no bundle gives none."""
    b = bundles.select("id", F.from_json("json", "title string, summary string, evidence array<struct<claim:string,source:string>>, open_questions array<string>").alias("b")).where("b.title IS NOT NULL")
    lines = F.transform(F.coalesce("b.evidence", F.array().cast("array<struct<claim:string,source:string>>")), lambda e: F.concat(F.lit("- "), F.coalesce(e["claim"], F.lit("")), F.lit(" ("), F.coalesce(e["source"], F.lit("?")), F.lit(")")))
    body = F.concat_ws("\n", F.col("b.summary"), F.nullif(F.array_join(lines, "\n"), F.lit("")))
    return b.select("id", F.col("b.title").alias("titulo"), body.alias("corpo")), b.select("id", F.explode(F.array_distinct("b.open_questions")).alias("pergunta"))


def page(records: DataFrame, scope: Column, order: str, key: str, after: tuple | None, n: int) -> DataFrame:
    """The next ``n`` records in scope, newest first, behind the cursor ``(order, key)`` of the last page; no offset, so pages do not shift."""
    d = records.where(F.coalesce(scope, F.lit(False)))
    if after is not None:
        at, k = F.lit(after[0]), F.lit(after[1])
        d = d.where((F.col(order) < at) | ((F.col(order) == at) & (F.col(key) > k)))
    return d.orderBy(F.desc(order), key).limit(n)


def merge_target(ranked: DataFrame, sizes: DataFrame, least: float = 0.88, most: int = 20_000) -> DataFrame:
    """``(qid, doc)``: the first hit of each new note at ``least`` similarity that is there and not larger than ``most`` characters."""
    j = ranked.where(F.col("cos") >= least).join(sizes.where(F.col("n") <= most).select("doc"), "doc", "left_semi")
    return j.groupBy("qid").agg(F.min_by("doc", "posicao").alias("doc"))


def merged_notes(target: DataFrame, new: DataFrame, old: DataFrame, mark: str) -> DataFrame:
    """``(id, texto)``: old notes with the new ones that go into them, in order of key, each behind a mark."""
    add = target.join(new.select(F.col("id").alias("qid"), F.col("texto").alias("t")), "qid").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qid", "t"))), lambda x: F.concat(F.lit(f"\n\n{mark}\n\n"), x["t"])), "").alias("mais"))
    return old.join(add.withColumnRenamed("doc", "id"), "id", "left").select("id", F.concat("texto", F.coalesce("mais", F.lit(""))).alias("texto"))
