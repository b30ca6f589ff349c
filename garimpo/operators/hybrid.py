"""Hybrid retrieval: substring BM25, fusion with vector lists, reranking, collapse to documents, and how well a collection finds its own texts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import fold_latin
from garimpo.operators.ranking import global_rank, index_terms, knn_blocks, rrf, top_k
from garimpo.runtime import spread

#: Distinct words of a stated query set that are broadcast in one call.
MAX_WORDS = 50_000
#: Saturation and length weight of the text index, floor of its idf.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _places(token: str, w: str) -> int:
    n, at = 0, -1
    while (at := token.find(w, at + 1)) >= 0:
        n += 1
    return n


def substring_words(q: Column) -> Column:
    """Blank-separated words of three characters or more, lower case, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(F.coalesce(q, F.lit("")))), r"\s+"), lambda w: F.length(w) >= 3))


def _places(token: str, w: str) -> int:
    n, at = 0, -1
    while (at := token.find(w, at + 1)) >= 0:
        n += 1
    return n


class _Batch:
    """Texts of a batch by their different tokens: a word holds no blank, so it lies within tokens, and each token is looked at once for every word."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.fill_null(pc.utf8_lower(texts), ""))
        tokens = pc.dictionary_encode(lists.flatten())
        self.vocabulary, self.n = tokens.dictionary, len(texts)
        rows = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))
        # one entry a (token, text) with its count, sorted by token
        pair, self.times = np.unique(tokens.indices.to_numpy().astype(np.int64) * self.n + rows, return_counts=True)
        of, self.text = pair // max(1, self.n), pair % max(1, self.n)
        self.start = np.searchsorted(of, np.arange(len(self.vocabulary) + 1))

    def places(self, w: str) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold the word, and how often; places may overlap, as in an index of trigrams."""
        n = np.zeros(self.n, np.int64)
        for t in np.flatnonzero(pc.match_substring(self.vocabulary, w).to_numpy(zero_copy_only=False)):
            z = slice(self.start[t], self.start[t + 1])
            n[self.text[z]] += self.times[z] * _places(self.vocabulary[int(t)].as_py(), w)
        hit = np.flatnonzero(n)
        return hit, n[hit]


def _frequencies(words: list[str]):  # noqa: ANN202
    """Per task: in how many texts each word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(words), np.int64)
        for b in batches:
            own = _Batch(b.column(0))
            for i, w in enumerate(words):
                df[i] += len(own.places(w)[0])
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["w", "df"])

    return run


def _best(shared, top: int):  # noqa: ANN001, ANN202
    """Per task: the ``top`` texts of every query; columns: key, text, length, allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, idf, average, asks = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = pa.int64()
        for b in batches:
            kind = b.schema.types[0]
            own, keys = _Batch(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            size, ok = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            found = []
            for w, x in zip(words, idf):
                hit, tf = own.places(w) if x else (np.empty(0, np.int64), np.empty(0))
                found.append((hit, x * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[hit] / average))))
            for q, (_, ws) in enumerate(asks):
                s, seen = np.zeros(own.n), np.zeros(own.n, bool)
                for w in ws:
                    hit, part = found[w]
                    s[hit] += part
                    seen[hit] = True
                at = np.flatnonzero(seen & ok)
                if len(at):
                    v, k = np.round(s[at], 6), keys[at]
                    if q in best:
                        v, k = np.concatenate([best[q][0], v]), np.concatenate([best[q][1], k])
                    order = np.lexsort((k, -v))[:top]
                    best[q] = v[order], k[order]
        for q, (v, k) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), q, np.int32)), pa.array(k, kind), pa.array(v)], ["q", "doc", "score"])

    return run


def substring_bm25(queries: DataFrame, docs: DataFrame, key: str, text: str, top: int, allowed: Column | None = None) -> DataFrame:
    """``(qid, doc, score, posicao)`` of queries ``(qid, texto)``: any word of three characters or more, found anywhere in the text, case apart.

    Scores as a trigram index gives them: tf is the number of places, length the number of trigrams, statistics are over all texts of
    ``docs``; only documents that satisfy ``allowed`` come out, and no candidate is cut before that filter. Ties go to the smaller key.
    The stated query set is broadcast, at most ``MAX_WORDS`` different words (checked). Texts are read twice where they lie, for the words'
    frequencies and for scores; every task keeps ``top`` texts a query, so only tasks x queries x top rows are shuffled. Keys are
    numbers or texts, without nulls.
    """
    q = queries.select("qid", substring_words(F.col("texto")).alias("ws")).where(F.size("ws") > 0)
    words = [r["term"] for r in q.select(F.explode("ws").alias("term")).distinct().orderBy("term").limit(MAX_WORDS + 1).collect()]
    if len(words) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words: run the queries in several calls")
    # no more queries than words allow: each query is its words, and equal ones are answered once
    number = {w: i for i, w in enumerate(words)}
    same = q.groupBy("ws").agg(F.count("*").alias("n"))
    asks = [(i, [number[w] for w in r["ws"]]) for i, r in enumerate(same.orderBy("ws").limit(MAX_WORDS + 1).collect())]
    if len(asks) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} queries: run them in several calls")
    size = F.greatest(F.length(text) - 2, F.lit(0)).cast("double")
    d = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("texto"), size.alias("len"), (F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))).alias("ok"))
    d = spread(d)
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    df = {r["w"]: r["df"] for r in d.select("texto").mapInArrow(_frequencies(words), "w bigint, df bigint").groupBy("w").agg(F.sum("df").alias("df")).collect()}
    idf = [max(math.log((stats["n"] - df[i] + 0.5) / (df[i] + 0.5)), IDF_FLOOR) if i in df else 0.0 for i in range(len(words))]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, idf, stats["avg"] or 1.0, asks))
    kind = d.schema["doc"].dataType.simpleString()
    found = d.mapInArrow(_best(shared, top), f"q int, doc {kind}, score double")
    ranked = top_k(found, ["q"], [F.desc("score"), F.asc("doc")], top)
    numbered = spark.createDataFrame([(i, [words[w] for w in ws]) for i, ws in asks], "q int, ws array<string>")
    named = q.join(F.broadcast(numbered), "ws").select("qid", "q")
    return named.join(ranked, "q").select("qid", "doc", "score", "posicao")


def vector_lists(queries: DataFrame, docs: DataFrame, key: str, vec: str, top: int, allowed: Column | None = None) -> DataFrame:
    """``(qid, doc, cos, posicao)``: the ``top`` most similar allowed rows of queries ``(qid, vec)``; the filter comes before the search."""
    base = docs if allowed is None else docs.where(F.coalesce(allowed, F.lit(False)))
    return knn_blocks(base.select(F.col(key).alias("id"), F.col(vec).alias("v")), queries.select(F.col("qid").alias("id"), F.col("vec").alias("v")), "id", "v", top)


def hybrid(queries: DataFrame, docs: DataFrame, key: str, text: str, vec: str, n: int = 10, k: int = 60, allowed: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """``(qid, doc, score, posicao)``: 3 n by vector and 3 n by text, fused by reciprocal rank, the vector list first at ties."""
    vet = vector_lists(queries, docs, key, vec, 3 * n, allowed).select("qid", F.lit("a").alias("lista"), "doc", "posicao")
    lex = substring_bm25(queries, docs, key, text, 3 * n, allowed).select("qid", F.lit("b").alias("lista"), "doc", "posicao")
    return rrf(vet.unionByName(lex), k, n, weights)


def term_overlap(question: Column, text: Column) -> Column:
    """A scorer without a model: the share of the question's terms that the text holds."""
    terms = index_terms(question)
    low = fold_latin(F.lower(F.coalesce(text, F.lit(""))))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: low.contains(t))) / F.size(terms)).otherwise(F.lit(0.0))


def combined(dense: DataFrame, lexical: DataFrame, texts: DataFrame, asks: DataFrame, limit: int = 10, depth: int = 20, scorer: Callable[[Column, Column], Column] | None = term_overlap, dominant: float | None = 1.5, weights: dict[str, float] | None = None) -> DataFrame:
    """``(qid, doc, posicao)``: dense (qid, doc, posicao) and lexical (qid, doc, score, posicao) lists fused; the first ``depth`` reordered by the scorer.

    The rest follows as it was fused. A first lexical hit that stands alone or scores ``dominant`` times the second goes to the top. Without a
    scorer the fusion stands. ``texts``: (doc, texto); ``asks``: (qid, texto).
    """
    fused = rrf(dense.select("qid", F.lit("a").alias("lista"), "doc", "posicao").unionByName(lexical.select("qid", F.lit("b").alias("lista"), "doc", "posicao")), 60, None, weights)
    if scorer is None:
        return fused.where(F.col("posicao") <= limit).select("qid", "doc", "posicao")
    head = fused.where(F.col("posicao") <= depth).join(texts.select("doc", F.col("texto").alias("__t")), "doc", "left").join(asks.select("qid", F.col("texto").alias("__q")), "qid")
    head = head.select("qid", "doc", "posicao", F.round(scorer(F.col("__q"), F.col("__t")), 9).alias("r"))
    out = head.unionByName(fused.where(F.col("posicao") > depth).select("qid", "doc", "posicao", F.lit(None).cast("double").alias("r")))
    first = lexical.where("posicao <= 2").groupBy("qid").agg(F.max(F.when(F.col("posicao") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("posicao") == 2, F.col("score"))).alias("s2"), F.max(F.when(F.col("posicao") == 1, F.col("doc"))).alias("fixo"))
    alone = F.col("s2").isNull() | ((F.col("s2") > 0) & (F.col("s1") / F.col("s2") >= (dominant or 0)))
    out = out.join(first, "qid", "left").withColumn("top", F.coalesce((F.col("doc") == F.col("fixo")) & alone, F.lit(False)) if dominant else F.lit(False))
    order = [F.desc("top"), F.asc(F.col("r").isNull()), F.desc("r"), F.asc("posicao")]
    return top_k(out.select("qid", "doc", "top", "r", "posicao"), ["qid"], order, limit, "final").select("qid", "doc", F.col("final").alias("posicao"))


def search_plan(scope: str = "all", graph: str | None = None, client: str | None = None, reranker: bool = True) -> str:
    """``hibrida`` where it applies: the whole, notes or external scope, no graph or client, a reranker at hand; else ``densa``."""
    return "hibrida" if scope in ("all", "notes", "external") and graph is None and client is None and reranker else "densa"


def facets(client: str | None = None, folder: str | None = None, where: dict | None = None) -> dict | None:
    """The filter of a search with its facets, joined by ``$and`` and applied inside the search, never after it."""
    parts = [x for x in (where, {"client": client} if client is not None else None, {"folder": folder} if folder is not None else None) if x]
    return None if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def candidates_wanted(want: int) -> int:
    """Chunks to ask for so that ``want`` documents remain."""
    return min(max(4 * want, 20), max(60, want))


def authority_candidates(n: int) -> int:
    return min(max(4 * n, 20), n + 300)


def collapsed(ranked: DataFrame, documents: DataFrame, similarity: str, want: int, threshold: float | None = None, weight: Column | None = None) -> DataFrame:
    """``(qid, documento, doc, sim, posicao)``: the best chunk of each document, then the best ``want`` documents.

    ``documents``: (doc, documento). Similarities are weighed, rounded to three digits and cut at ``threshold`` before the collapse.
    """
    sim = F.round(F.col(similarity) * (F.lit(1.0) if weight is None else weight), 3)
    d = ranked.join(documents, "doc").select("qid", "documento", "doc", sim.alias("sim"))
    if threshold is not None:
        d = d.where(F.col("sim") >= threshold)
    best = d.groupBy("qid", "documento").agg(F.min(F.struct((-F.col("sim")).alias("s"), "doc")).alias("m")).select("qid", "documento", "m.doc", (-F.col("m.s")).alias("sim"))
    return top_k(best, ["qid"], [F.desc("sim"), F.asc("doc")], want)


def index_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """``(qid, so_a, so_b, comuns, mesma_posicao)``: the first ``k`` of two indexes for the same queries, side by side."""
    x, y = a.where(F.col("posicao") <= k).select("qid", "doc", F.col("posicao").alias("pa")), b.where(F.col("posicao") <= k).select("qid", "doc", F.col("posicao").alias("pb"))
    g = x.join(y, ["qid", "doc"], "full").groupBy("qid")
    return g.agg(F.count_if(F.col("pb").isNull()).alias("so_a"), F.count_if(F.col("pa").isNull()).alias("so_b"), F.count_if(F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("comuns"), F.count_if(F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))).alias("mesma_posicao"))


# a collection's own sentences

#: Characters of a sentence that can stand for a question.
SENTENCE = (60, 240)


def usable_sentences(text: Column) -> Column:
    """Lines of prose of 60 to 240 characters: no head, links or code, marks of lists and headings taken off."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\A---.*?---", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\[\[[^\]]*\]\]", " "), "`[^`]*`", " ")
    lines = F.transform(F.split(body, "\n"), lambda x: F.btrim(F.regexp_replace(F.btrim(x, F.lit(" \t\r\f")), r"^[#\-*| ]+", ""), F.lit(" \t\r\f")))
    return F.filter(lines, lambda x: F.length(x).between(*SENTENCE) & ~x.startswith("http") & ~x.startswith("```"))


def own_questions(docs: DataFrame, key: str, text: str, n: int, seed: int = 0) -> DataFrame:
    """``(qid, texto)``: one own sentence of each of ``n`` texts, both drawn by hash, so the same seed draws the same ones."""
    s = docs.select(F.col(key).alias("qid"), usable_sentences(F.col(text)).alias("fs")).where(F.size("fs") > 0)
    s = s.withColumn("h", F.xxhash64(F.lit(seed), "qid")).orderBy("h", "qid").limit(n)
    return s.select("qid", F.element_at("fs", (F.pmod("h", F.size("fs")) + 1).cast("int")).alias("texto"))


def self_recall(questions: DataFrame, ranked: DataFrame, depth: int = 10) -> DataFrame:
    """One row: how many questions found their own text among the first ``depth``, the median place, and the recall."""
    hit = ranked.where((F.col("qid") == F.col("doc")) & (F.col("posicao") <= depth)).groupBy("qid").agg(F.min("posicao").alias("p"))
    j = questions.select("qid").join(hit, "qid", "left")
    return j.agg(F.count("*").alias("amostras"), F.count("p").alias("recuperadas"), F.round(F.count("p") / F.count("*"), 3).alias("recall"), F.median("p").alias("posicao_mediana"))


def regressed(before: float, now: float, samples: int) -> bool:
    """Whether recall fell by more than two standard errors of the reference."""
    return before - now > 2 * math.sqrt(max(0.0, before * (1 - before)) / samples) if samples else False


#: What asks for a past session; the first list counts anywhere, the others as whole words.
SESSION_ZH = ["之前", "上次", "上回", "上一次", "那次", "那回", "前几天", "前天", "昨天", "那天", "上周", "上星期", "上个月", "的会话", "次会话", "个会话", "会话里", "会话中", "历史会话", "当时我们", "我们当时"]
SESSION_EN = ["last time", "last session", "previous session", "earlier session", "that session", "the session where", "yesterday", "the other day", "last week", "when we", "we did", "did we", "what did we", "how did we", "back then", "earlier we", "previously"]
SESSION_PT = ["última sessão", "ultima sessao", "última sessao", "ultima sessão", "sessão anterior", "sessao anterior", "onde paramos ontem", "decisão anterior", "decisao anterior"]


def asks_for_session(q: Column) -> Column:
    """Whether a question wants to recall a past session; null is no question."""
    low = F.lower(F.coalesce(q, F.lit("")))
    padded = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}0-9]", " "), F.lit(" "))
    hit = F.lit(False)
    for m in SESSION_ZH:
        hit = hit | low.contains(m)
    for m in (*SESSION_EN, *SESSION_PT):
        hit = hit | padded.contains(f" {m} ")
    return hit


# relevance of items to a context

#: Fixed value: tokens of items and contexts.
TOKEN = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|\b\d{4,}\b|[a-zA-Z0-9_]+)"


def item_relevance(items: DataFrame, by: str, item: str, text: str, context: str) -> DataFrame:
    """``(by, item, score, reforcado)``: BM25 of each item to its group's context, where every term weighs ln 2 times its count in the context.

    A tenth of the sum, at most 1; 0.3 more where a matched term has eight bytes or more. ``reforcado`` is at least 0.3 with a match, 0.2
    more with two. Mean length is over the group's items; a group without context terms scores 0.
    """
    toks = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 1)
    d = items.select(by, item, toks(F.col(text)).alias("ts"), toks(F.col(context)).alias("ctx"))
    mean = d.groupBy(by).agg(F.avg(F.size("ts")).alias("avg"))
    ctx = d.select(by, item, "ts", F.col("ctx")).join(mean, by)
    n = F.size("ts")
    avg = F.when(F.col("avg") > 0, F.col("avg")).when(n > 0, n).otherwise(1.0)
    tf = lambda t: F.size(F.filter("ts", lambda x: x == t)).cast("double")
    qf = lambda t: F.size(F.filter("ctx", lambda x: x == t)).cast("double")
    hit = F.array_sort(F.array_intersect("ts", "ctx"))
    raw = F.aggregate(hit, F.lit(0.0), lambda s, t: s + F.lit(math.log(2)) * (tf(t) * 2.5) / (tf(t) + 1.5 * (0.25 + 0.75 * n / avg)) * qf(t))
    long = F.exists(hit, lambda t: F.octet_length(t) >= 8)
    score = F.least(F.least(raw / 10, F.lit(1.0)) + F.when(long, 0.3).otherwise(0.0), F.lit(1.0))
    boosted = F.when(F.size(hit) > 0, F.when(F.size(hit) >= 2, F.least(F.greatest(score, F.lit(0.3)) + 0.2, F.lit(1.0))).otherwise(F.greatest(score, F.lit(0.3)))).otherwise(score)
    return ctx.select(by, item, F.round(score, 9).alias("score"), F.round(boosted, 9).alias("reforcado"))


def best_window(text: Column, terms: Column, size: int = 1500) -> Column:
    """The ``size`` characters with most different terms, beginning 200 before the first of them; the beginning without any.

    Terms of three characters or more are found without case and marks.
    """
    low = fold_latin(F.lower(F.coalesce(text, F.lit(""))))
    own = F.array_distinct(F.filter(F.transform(terms, lambda t: fold_latin(F.lower(t))), lambda t: F.length(t) >= 3))
    # places of a term: lengths of what lies before each of its occurrences
    parts = lambda t: F.split(low, F.concat(F.lit("\\Q"), t, F.lit("\\E")), -1)
    places = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts(t)) - 1, F.lit(1))), lambda i: F.struct((F.aggregate(F.slice(parts(t), F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p)) + (i - 1) * F.length(t)).alias("p"), t.alias("t")))
    every = F.array_sort(F.flatten(F.transform(own, lambda t: F.when(low.contains(t), places(t)).otherwise(F.array().cast("array<struct<p:int,t:string>>")))))
    scored = F.transform(every, lambda x: F.struct((-F.size(F.array_distinct(F.transform(F.filter(every, lambda y: (y["p"] >= x["p"]) & (y["p"] < x["p"] + size)), lambda y: y["t"])))).alias("n"), x["p"].alias("p")))
    best = F.try_element_at(F.array_sort(scored), F.lit(1))["p"]
    at = F.coalesce(F.greatest(best - 200, F.lit(0)), F.lit(0))
    return F.when(F.length(text) <= size, text).otherwise(F.substring(text, at + 1, F.lit(size)))


# facts by the words of a question

def facts_by_terms(facts: DataFrame, asks: DataFrame, limit: int = 3) -> DataFrame:
    """``(qid, ks, ka, pontos, posicao)``: fact groups whose subject and attribute both match terms of an ask ``(qid, termos)``, most terms first.

    A term matches a piece of a key that equals it, or begins with the same four letters if both have four. Terms of the subject do not count
    again for the attribute. Only keys that share a beginning with a term are joined.
    """
    keys = facts.where("ks IS NOT NULL AND ka IS NOT NULL").select("ks", "ka").distinct()
    pieces = lambda c: F.filter(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1), lambda p: p != "")
    start = lambda c: F.when(F.length(c) >= 4, F.substring(c, 1, 4)).otherwise(c)
    t = asks.select("qid", F.explode(F.array_distinct(F.transform("termos", lambda x: F.btrim(F.regexp_replace(fold_latin(F.lower(x)), "[^a-z0-9.]+", "_"), F.lit("_."))))).alias("t")).where("t <> ''").withColumn("b", start(F.col("t")))
    subject = keys.select("ks").distinct().select("ks", F.explode(F.array_distinct(pieces(F.col("ks")))).alias("p")).withColumn("b", start(F.col("p")))
    attribute = keys.select("ka").distinct().select("ka", F.explode(F.array_distinct(pieces(F.regexp_replace("ka", "^setting:", "")))).alias("p")).withColumn("b", start(F.col("p")))
    same = (F.col("p") == F.col("t")) | ((F.length("t") >= 4) & (F.length("p") >= 4))
    ts = t.join(subject, "b").where(same).groupBy("qid", "ks").agg(F.collect_set("t").alias("ts"))
    ta = t.join(attribute, "b").where(same).groupBy("qid", "ka").agg(F.collect_set("t").alias("ta"))
    j = keys.join(ts, "ks").join(ta, ["qid", "ka"]).select("qid", "ks", "ka", "ts", F.array_except("ta", "ts").alias("ta")).where(F.size("ta") > 0)
    return top_k(j.select("qid", "ks", "ka", (F.size("ts") + F.size("ta")).alias("pontos")), ["qid"], [F.desc("pontos"), F.asc("ks"), F.asc("ka")], limit)


# feedback

def votes_report(votes: DataFrame) -> DataFrame:
    """``(caminho, uteis, nao, saldo, pior)`` of votes ``(qid, caminho, util)``; ``pior`` is the place among paths with more votes against than for."""
    g = votes.groupBy("caminho").agg(F.count_if(F.col("util")).alias("uteis"), F.count_if(~F.col("util")).alias("nao")).withColumn("saldo", F.col("uteis") - F.col("nao"))
    worst = global_rank(g.where("saldo < 0").select("caminho", "saldo"), [F.asc("saldo"), F.asc("caminho")], "pior").select("caminho", "pior")
    return g.join(worst, "caminho", "left")


def unhelped(votes: DataFrame) -> DataFrame:
    """``(qid)``: queries none of whose results was found useful."""
    return votes.groupBy("qid").agg(F.count_if(F.col("util")).alias("n")).where("n = 0").select("qid")


def graded(votes: DataFrame) -> DataFrame:
    """``(qid, doc, grau)``: an evaluation set from useful votes: 2, or 3 where there were several."""
    g = votes.where("util").groupBy("qid", F.col("caminho").alias("doc")).agg(F.count("*").alias("n"))
    return g.select("qid", "doc", F.when(F.col("n") > 1, 3).otherwise(2).alias("grau"))


def visible(company: Column, agent: Column, owner_company: Column, owner_agent: Column, shared: Column) -> Column:
    """Whether a record is in scope: of the same company, and of the agent or shared within it; records without a company are in none."""
    return F.coalesce((owner_company == company) & (shared | owner_agent.isNull() | (owner_agent == agent)), F.lit(False))
