"""Checks of what texts say: quotations, claims, facts, synthesis, paths; and small repairs of notes and labels."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions.text import fold_latin, grouping_key

#: Least characters of a quotation, of a block of it, and the share such blocks must cover.
QUOTE_LEAST, BLOCK_LEAST, COVERED = 12, 12, 0.95
#: Attributes a fact may have, besides ``setting:...``; those with one value; limits of subject, attribute, value and its words.
ATTRIBUTES = ["path", "config_path", "url", "endpoint", "repository", "port", "host", "command", "version", "model", "device", "runtime", "service", "owner", "schedule", "scope", "chosen"]
SINGLE = ["port", "host", "url", "version", "model", "device", "config_path", "owner", "schedule", "repository"]
FACT_LIMITS = {"sujeito": 120, "atributo": 80, "valor": 300}
FACT_WORDS = 10


def quote_form(c: Column) -> Column:
    """Text as quotations are compared: without marks, case, markdown signs and runs of blanks."""
    return F.btrim(F.regexp_replace(F.regexp_replace(fold_latin(F.lower(F.coalesce(c, F.lit("")))), r"[`*_>#\[\]|]", " "), r"\s+", " "))


@F.pandas_udf(T.DoubleType())
def _covered(text: pd.Series, quote: pd.Series) -> pd.Series:
    """Share of each quote in common blocks of 12 characters or more; null where nothing is asked."""

    def one(t: str | None, q: str | None) -> float | None:
        if t is None or not q:
            return None
        blocks = difflib.SequenceMatcher(None, t, q, autojunk=False).get_matching_blocks()
        return sum(b.size for b in blocks if b.size >= BLOCK_LEAST) / len(q)

    return pd.Series([one(t, q) for t, q in zip(text, quote)], dtype="float64")


def quoted(quote: Column, text: Column) -> Column:
    """Whether the text holds the quotation: whole, in its pieces between dots in order, or 95 % of it in blocks of 12 characters.

    Under 12 characters it proves nothing. Only quotations that are not found literally go to Python.
    """
    q, t = quote_form(quote), quote_form(text)
    pieces = F.filter(F.transform(F.split(q, r"\.\.\.|…"), lambda p: F.btrim(p)), lambda p: p != "")
    # the place behind each piece, looked for from the one before; -1 once a piece is missing
    locate = lambda at, p: F.call_function("locate", p, t, at + 1)
    step = lambda at, p: F.when(at < 0, at).when(locate(at, p) > 0, locate(at, p) - 1 + F.length(p)).otherwise(F.lit(-1))
    literal = F.aggregate(pieces, F.lit(0), step) >= 0
    enough = F.length(q) >= QUOTE_LEAST
    sewn = F.coalesce(_covered(F.when(enough & ~literal, t), F.when(enough & ~literal, q)), F.lit(0.0)) >= COVERED
    return F.coalesce(enough & (literal | sewn), F.lit(False))


def claim_form(c: Column) -> Column:
    """Text as claims are compared: also without quotes, and without points at the ends."""
    t = F.regexp_replace(F.regexp_replace(fold_latin(F.lower(F.coalesce(c, F.lit("")))), r"[*`_>#|\[\]]+", " "), "[“”‘’\"']", "")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" .,;:"))


def checked_claims(claims: DataFrame, sources: DataFrame, words: int = 4) -> DataFrame:
    """``claims`` (rid, pos, texto, fonte, citacao) with ``motivo``, null for those that stand.

    A claim needs text and quotation, a source ``(rid, fonte, conteudo)`` of its answer, a quotation of ``words`` words that is in it, and must not
    repeat a claim that stood before it. The first reason in that order is given.
    """
    j = claims.join(sources.select("rid", "fonte", claim_form(F.col("conteudo")).alias("__c")), ["rid", "fonte"], "left")
    q, t = claim_form(F.col("citacao")), claim_form(F.col("texto"))
    empty = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    why = F.when(empty(F.col("texto")) | empty(F.col("citacao")), "sem texto ou citacao").when(F.col("__c").isNull(), "fonte inexistente")
    why = why.when(F.size(F.filter(F.split(q, " "), lambda w: w != "")) < words, "citacao curta").when(~F.col("__c").contains(q), "citacao fora da fonte")
    d = j.withColumn("motivo", why).withColumn("__t", t)
    first = d.where("motivo IS NULL").groupBy("rid", "__t").agg(F.min("pos").alias("__first"))
    d = d.join(first, ["rid", "__t"], "left")
    return d.select(*claims.columns, F.when(F.col("motivo").isNull() & (F.col("pos") > F.col("__first")), "repetida").otherwise(F.col("motivo")).alias("motivo"))


def valid_facts(raw: DataFrame, notes: DataFrame) -> DataFrame:
    """``(nota, pos, sujeito, atributo, valor)``: the facts of ``raw`` that their note ``(nota, texto)`` bears out, each once, the first kept.

    Known attributes only, within the limits; the value stands literally in the text, is no description, no link and not the subject.
    """
    plain = lambda c: F.btrim(F.regexp_replace(fold_latin(F.lower(F.coalesce(c, F.lit("")))), r"[\s*`_]+", " "))
    trim = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    d = raw.select("nota", "pos", trim("sujeito").alias("sujeito"), F.lower(trim("atributo")).alias("atributo"), trim("valor").alias("valor"))
    d = d.where(F.forall(F.array("sujeito", "atributo", "valor"), lambda x: x != "")).where(" AND ".join(f"length({c}) <= {n}" for c, n in FACT_LIMITS.items()))
    d = d.where(F.col("atributo").isin(ATTRIBUTES) | (F.col("atributo").startswith("setting:") & (F.length("atributo") > len("setting:"))))
    d = d.where(F.size(F.filter(F.split("valor", r"\s+"), lambda w: w != "")) <= FACT_WORDS).where(~F.col("valor").startswith("[["))
    j = d.join(notes.select("nota", plain(F.col("texto")).alias("__t")), "nota").withColumn("__v", plain(F.col("valor")))
    j = j.where((F.col("__v") != "") & F.col("__t").contains(F.col("__v")))
    j = j.withColumn("__ks", grouping_key(F.col("sujeito"))).withColumn("__ka", grouping_key(F.col("atributo"))).where((F.col("__ks") != "") & (F.col("__ka") != "") & (F.col("__ks") != grouping_key(F.col("valor"))))
    one = j.groupBy("nota", "__ks", "__ka", "__v").agg(F.min(F.struct("pos", "sujeito", "atributo", "valor")).alias("m"))
    return one.select("nota", "m.*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def flat_objects(s: pd.Series) -> pd.Series:
    """The objects of a text that should be JSON: those of ``facts`` if it is whole, else each complete flat object with a value; as JSON texts."""

    def one(t: str | None) -> list[str]:
        t = t or ""
        try:
            whole = json.loads(t[t.index("{") : t.rindex("}") + 1])
            if isinstance(whole, dict) and isinstance(whole.get("facts"), list):
                return [json.dumps(x, ensure_ascii=False) for x in whole["facts"] if isinstance(x, dict)]
        except ValueError:
            pass
        out, at = [], None
        for i, c in enumerate(t):
            if c == "{":
                at = i
            elif c == "}" and at is not None:
                try:
                    x = json.loads(t[at : i + 1])
                    if "value" in x:
                        out.append(json.dumps(x, ensure_ascii=False))
                except ValueError:
                    pass
                at = None
        return out

    return s.map(one)


#: Names that models make up, prompts that leak into their answers.
MADE_UP = ["john doe", "jane doe", "maria oliveira", "paulo pereira", "josé da silva", "ana santos", "sarah chen", "carlos souza", "voodoo"]
LEAKS = [r"(?i)write a (structured )?note", r"(?i)you are an? ai", r"(?i)as an ai", r"(?i)summarize the following", r"(?i)extract key (facts|information)", r"(?i)no preamble", r"(?i)vault (analyst|reporter|synthesizer)"]


def synthesis_quality(out: Column, source: Column) -> Column:
    """1 less 0.3 for each fault, 0 for under 30 characters: too long for a source of over 500, each made-up name, a leaked prompt."""
    o, s = F.btrim(F.coalesce(out, F.lit("")), F.lit(" \t\r\n")), F.coalesce(source, F.lit(""))
    faults = F.when((F.length(s) > 500) & (F.length(o) / F.length(s) > 0.85), 1).otherwise(0)
    for n in MADE_UP:
        faults = faults + F.when(F.lower(o).contains(n), 1).otherwise(0)
    faults = faults + F.when(o.rlike("|".join(LEAKS)), 1).otherwise(0)
    return F.when(F.length(o) < 30, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(1.0 - 0.3 * faults, 2)))


def without_thoughts(c: Column) -> Column:
    """A model's note without its thoughts, code fence around all of it, and blank lines in excess; an unclosed thought takes the rest."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""), r"(?is)<think(?:ing)?>.*\z", "")
    c = F.regexp_replace(F.btrim(c, F.lit(" \t\r\n")), r"(?s)\A```[a-zA-Z]*\n(.*)\n```\z", "$1")
    return F.btrim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


#: Worn phrases of models, comments that say nothing.
WORN = [r"\bdelve\b", r"\btapestry\b", r"\bleverage\b", r"\bgame-changer\b", r"\btestament\b", r"\bseamlessly\b", r"\brobust\b", r"\bharnessing\b", r"\bpivotal\b", r"\bfoster\b", r"\bmoreover\b", r"\bfurthermore\b", r"\bin summary\b", r"\bit is important to note\b", r"\bbeacon\b", r"\bunlocking\b", r"\bempower\b", r"\bparadigm\b"]
IDLE = [r"// Initialize [a-zA-Z0-9_]+", r"// Function to [a-zA-Z0-9_]+", r"# Initialize [a-zA-Z0-9_]+", r"# Function to [a-zA-Z0-9_]+"]


def worn_phrases(c: Column) -> Column:
    """How many worn phrases and idle comments a text holds."""
    return sum((F.regexp_count(c, F.lit(f"(?i){p}")) for p in (*WORN, *IDLE)), F.lit(0))


def purified(c: Column) -> Column:
    """The text without them, blanks made one and empty lines two at most."""
    for p in (*WORN, *IDLE):
        c = F.regexp_replace(c, f"(?i){p}", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


# paths that texts refer to

#: What a path in backticks is, a line number behind it, what makes it a pattern, roots that are looked at, disks of other machines.
PATH_CITED, PATH_LINE, PATH_PATTERN = r"`((?:/|~/)[^`\n]+?)`", r":\d+(?::\d+)?$", r"[{}<>*$|]|\.\.\.|\s"
ROOTS, FOREIGN = ["/mnt/", "/media/", "/etc/", "/opt/", "/usr/", "/var/", "/srv/"], r"^/mnt/(?:[a-z]|host|wsl)/"


def path_references(texts: DataFrame, key: str, text: str, home: str) -> DataFrame:
    """``(key, caminho)``: distinct paths in backticks below the home or a known root; patterns and places on other machines are none."""
    c = texts.where(F.col(text).isNotNull()).select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(PATH_CITED), 1)).alias("b"))
    raw = F.btrim("b")
    p = F.regexp_replace(F.rtrim(raw, F.lit(".,;:)")), PATH_LINE, "")
    c = c.where(~raw.rlike(PATH_PATTERN)).select(key, p.alias("p")).where(~F.col("p").isin("", "/", "~/") & ~F.col("p").rlike(PATH_PATTERN))
    own = home.rstrip("/")
    full = F.when(F.col("p").startswith("~/"), F.concat(F.lit(own), F.substring("p", F.lit(2), F.length("p")))).otherwise(F.col("p"))
    rooted = F.lit(False)
    for r in (own + "/", *ROOTS):
        rooted = rooted | F.col("p").startswith(r)
    return c.where(F.col("p").startswith("~/") | (rooted & ~F.col("p").rlike(FOREIGN))).select(key, full.alias("caminho")).distinct()


def checked_paths(references: DataFrame, inventory: DataFrame, key: str, least: int = 3, most: int = 3) -> DataFrame:
    """``(key, caminho, existe, ancestral, sugestoes)`` against an inventory ``(caminho)`` of files: folders exist that hold a file.

    Of a dead path the deepest folder that is left, and up to ``most`` files of its name that share ``least`` last parts with it: longest
    common end first, then the shortest. Files are found by their last ``least`` parts, so a common name is no hot key.
    """
    up = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/")) - 1), lambda i: F.array_join(F.slice(F.split(p, "/"), F.lit(1), i), "/"))
    clean = F.rtrim("caminho", F.lit("/"))
    there = inventory.select(clean.alias("c")).union(inventory.select(F.explode(up(clean)))).where("c <> ''").distinct()
    r = references.select(key, "caminho", clean.alias("c"))
    known = r.join(there, "c", "left_semi").select(key, "caminho").withColumn("existe", F.lit(True))
    dead = r.join(there, "c", "left_anti")
    ends = lambda p: F.array_join(F.slice(F.split(p, "/"), -least, least), "/")
    above = dead.select(key, "caminho", F.explode(up(F.col("c"))).alias("a")).join(there.withColumnRenamed("c", "a"), "a").groupBy(key, "caminho").agg(F.max(F.struct(F.length("a"), F.col("a").alias("a"))).alias("m")).select(key, "caminho", F.col("m.a").alias("ancestral"))
    files = inventory.select(clean.alias("f")).where(F.size(F.split("f", "/")) >= least).withColumn("e", ends(F.col("f")))
    pairs = dead.where(F.size(F.split("c", "/")) >= least).withColumn("e", ends(F.col("c"))).join(files, "e").where("f <> c")
    x, y = F.reverse(F.split("c", "/")), F.reverse(F.split("f", "/"))
    common = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, ok: F.struct((s["n"] + F.when(s["go"] & ok, 1).otherwise(0)).alias("n"), (s["go"] & ok).alias("go")), lambda s: s["n"])
    near = pairs.withColumn("n", common).groupBy(key, "caminho").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.length("f").alias("l"), F.col("f").alias("f")))), lambda s: s["f"]), 1, most).alias("sugestoes"))
    gone = dead.select(key, "caminho").join(above, [key, "caminho"], "left").join(near, [key, "caminho"], "left")
    none = F.array().cast("array<string>")
    return known.select(key, "caminho", "existe", F.lit(None).cast("string").alias("ancestral"), none.alias("sugestoes")).unionByName(gone.select(key, "caminho", F.lit(False).alias("existe"), "ancestral", F.coalesce("sugestoes", none).alias("sugestoes")))


# notes, labels, settings

#: What marks a session's log.
SESSION_MARKS = ["session synopsis", "session summary", "session transcript"]


def looks_like_session(name: Column, content: Column) -> Column:
    n, head = F.lower(F.coalesce(name, F.lit(""))), F.substring(F.coalesce(content, F.lit("")), 1, 500)
    hit = n.startswith("session") | n.contains("session-") | n.contains("session_") | head.rlike(r"(?im)^tags:.*\bsession\b")
    for m in SESSION_MARKS:
        hit = hit | F.lower(head).contains(m)
    return hit


def indexable(c: Column) -> Column:
    """Text as it can be indexed: valid characters only, NUL as a blank."""
    return F.translate(F.make_valid_utf8(c), "\0", " ")


def chunk_size(wanted: int, window_tokens: int, chars_per_token: float = 3.0) -> int:
    """Characters of a chunk, so that it fits a model's window of tokens."""
    return max(1, min(wanted, int(window_tokens * chars_per_token)))


def first_bytes(c: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` bytes that cuts no character."""
    head = F.substring(F.encode(c, "utf-8"), 1, most)
    # a cut character leaves at most three bytes of its beginning
    cut = [F.decode(F.substring(head, F.lit(1), F.length(head) - k), "utf-8") for k in (1, 2, 3)]
    ok = lambda k: F.is_valid_utf8(F.substring(head, F.lit(1), F.length(head) - k).cast("string"))
    return F.when(F.octet_length(c) <= most, c).when(F.is_valid_utf8(head.cast("string")), F.decode(head, "utf-8")).when(ok(1), cut[0]).when(ok(2), cut[1]).otherwise(cut[2])


def clean_label(c: Column, most: int = 256) -> Column:
    """A label without control characters, cut; null is empty."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, most)


def fenced(c: Column, begin: str, end: str) -> Column:
    """Text between marks; marks of its own are made harmless."""
    for m in (begin, end):
        c = F.replace(c, F.lit(m), F.lit(m.replace("<", "&lt;").replace(">", "&gt;")))
    return F.concat(F.lit(begin + "\n"), c, F.lit("\n" + end))


def related_block(hits: DataFrame, notes: DataFrame, threshold: float) -> DataFrame:
    """``(nota, bloco)`` of hits ``(nota, caminho, titulo, sim)``: links to notes ``(caminho)`` that are there, the most similar first.

    Hits below the threshold, without a path, or with an absolute one are left out. One row a note; hits of a note are few.
    """
    ok = hits.where((F.col("sim") >= threshold) & F.col("caminho").isNotNull() & (F.col("caminho") != "") & ~F.col("caminho").rlike(r"^(/|[A-Za-z]:|\\)"))
    ok = ok.join(notes.select("caminho").distinct(), "caminho", "left_semi")
    stem = F.regexp_replace(F.element_at(F.split("caminho", "/"), -1), r"\.md$", "")
    link = F.concat(F.lit("- [["), stem, F.when(F.col("titulo").isNotNull() & (F.col("titulo") != stem), F.concat(F.lit("|"), "titulo")).otherwise(""), F.lit("]]"))
    one = ok.groupBy("nota", "caminho").agg(F.max(F.struct("sim", link.alias("l"))).alias("m"))
    return one.groupBy("nota").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m.sim")).alias("s"), "caminho", F.col("m.l").alias("l")))), lambda x: x["l"]), "\n").alias("bloco"))


#: Keys whose values are never shown, by name or ending.
SECRET_KEYS, SECRET_ENDS = ["server_token", "client_tokens", "token", "secret", "password", "api_key"], ["_token", "_secret", "_password", "_api_key", "_apikey"]


def config_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(id, chave, antes, depois)``: keys that changed between two JSON objects ``(id, json)``, null where missing; secrets as ``***``."""
    e = lambda df, n: df.select("id", F.explode(F.from_json("json", "map<string,string>")).alias("chave", n))
    j = e(before, "antes").join(e(after, "depois"), ["id", "chave"], "full").where(~F.col("antes").eqNullSafe(F.col("depois")))
    low = F.lower("chave")
    secret = low.isin(SECRET_KEYS)
    for s in SECRET_ENDS:
        secret = secret | low.endswith(s)
    mask = lambda c: F.when(secret & F.col(c).isNotNull() & ~F.col(c).isin("", "{}", "[]"), "***").otherwise(F.col(c)).alias(c)
    return j.select("id", "chave", mask("antes"), mask("depois"))


#: Classes of tokens worth keeping, in the order they are taken; limits of their number and bytes.
KEEP_URL = r"https?://[^\s<>()\[\]\"'`]+"
KEEP_CLASSES = [
    (KEEP_URL, 0), (r"\b(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+\b", 0),
    (r"\b[A-Za-z0-9_.-]+\.(?:rs|md|toml|sql|json|ya?ml|sh|py|js|ts|tsx|jsx|rb|go|c|h|cc|cpp|hpp|txt|lock|cfg|ini|env|xml|html|css|proto)\b", 0),
    (r"\bE\d{2,4}\b", 0), (r"\bHTTP\s?\d{3}\b", 0), (r"`([^`\n]{1,120})`", 1), (r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b", 0), (r"\b(?:[a-z][a-z0-9]*_[a-z0-9_]+|[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*)\b", 0),
]
KEEP_MOST, KEEP_BYTES = 48, (2, 128)


def durable_tokens(c: Column) -> Column:
    """Up to 48 tokens that a short form of the text must not lose: class after class, each once, without points around them."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), g), lambda t: F.btrim(F.btrim(t, F.lit(" \t\r\n")), F.lit(".,;:)(\"'<>`"))) for p, g in KEEP_CLASSES]))
    return F.slice(F.array_distinct(F.filter(found, lambda t: F.octet_length(t).between(*KEEP_BYTES))), 1, KEEP_MOST)


SUMMARY_BYTES = 500


def compacted(summary: Column, body: Column, footer: str) -> Column:
    """The short form of a note: its summary, else its first paragraph that is no heading, the tokens worth keeping, a footer."""
    own = F.nullif(F.btrim(F.coalesce(summary, F.lit("")), F.lit(" \t\r\n")), F.lit(""))
    paras = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: (p != "") & ~p.startswith("#"))
    text = F.coalesce(own, F.regexp_replace(F.try_element_at(paras, F.lit(1)), r"\s+", " "))
    short = F.when(F.octet_length(text) <= SUMMARY_BYTES, text).otherwise(F.concat(first_bytes(text, SUMMARY_BYTES), F.lit("…")))
    tokens = durable_tokens(body)
    kept = F.when(F.size(tokens) > 0, F.concat(F.lit("## Retained facts\n\n"), F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("- `"), t, F.lit("`\n"))), ""), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(F.concat(short, F.lit("\n\n")), F.lit("")), kept, F.lit(footer + "\n"))


def turn_pieces(df: DataFrame, key: str, text: str, target: int = 10_000, turn: str = r"(?m)^(?:\*\*)?(?:user|assistant|human|usuario|usuário|assistente)(?:\*\*)?:") -> DataFrame:
    """``(key, parte, texto)``: transcripts cut where a turn begins, near ``target`` characters; a piece of over half as much again is cut at lines.

    Pieces put together give the text, but for blank ones at the end, which are dropped. Texts are handled one by one.
    """
    import re

    begins = re.compile(turn)
    src = df.where(F.col(text).isNotNull()).select(key, text)
    kind = src.schema[key].dataType.simpleString()

    def packed(parts: list[str]) -> Iterator[str]:
        now = ""
        for p in parts:
            if now and len(now) + len(p) > target:
                yield now
                now = ""
            now += p
        if now.strip():
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, out = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                cuts = sorted({0, *(m.start() for m in begins.finditer(t)), len(t)})
                pieces = [q for p in packed([t[x:y] for x, y in zip(cuts, cuts[1:])]) for q in (packed(p.splitlines(keepends=True)) if len(p) > 1.5 * target else [p])]
                at += [i] * len(pieces)
                n += range(len(pieces))
                out += pieces
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(out, pa.string())], [key, "parte", "texto"])

    return src.mapInArrow(run, f"`{key}` {kind}, parte int, texto string")


def transcript_turns(spark, path: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """``(arquivo, linha, papel, texto, em)`` of JSON-lines transcripts of two forms, and the lines that are none.

    ``{"role", "content", "timestamp"}`` or ``{"type", "message": {"role", "content"}}``; contents are texts or lists of ``{"text"}``. Secrets are covered.
    """
    from garimpo.functions.texts import redact

    raw = spark.read.text(path).select(F.input_file_name().alias("arquivo"), F.monotonically_increasing_id().alias("linha"), "value").where("trim(value) <> ''")
    v = raw.withColumn("v", F.try_parse_json("value"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    body = lambda p: F.coalesce(F.array_join(F.filter(F.transform(F.try_variant_get("v", p, "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda x: x.isNotNull()), "\n"), F.when(F.schema_of_variant(F.try_variant_get("v", p, "variant")) == "STRING", get(p)))
    role, text = F.coalesce(get("$.message.role"), get("$.role")), F.coalesce(body("$.message.content"), body("$.content"))
    d = v.select("arquivo", "linha", F.lower(role).alias("papel"), redact(text).alias("texto"), get("$.timestamp").alias("em"), "value")
    good = F.col("papel").isin("user", "assistant") & F.coalesce(F.trim("texto") != "", F.lit(False))
    return d.where(good).drop("value"), d.where(~F.coalesce(good, F.lit(False))).select("arquivo", "linha", "value")


def handoff_summary(turns: DataFrame, by: list[str], order: str) -> DataFrame:
    """``(by, pedido, resposta, abertos, arquivos)``: the last request and answer of each conversation, its open items and the files it names."""
    last = lambda role: F.max_by(F.when(F.col("papel") == role, F.col("texto")), F.when(F.col("papel") == role, F.col(order)))
    g = turns.groupBy(*by).agg(last("user").alias("pedido"), last("assistant").alias("resposta"))
    items = F.regexp_extract_all(F.coalesce("resposta", F.lit("")), F.lit(r"(?m)^\s*- \[ \] (.+)$"), 1)
    files = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "pedido", "resposta"), F.lit(r"`([\w./-]+\.[A-Za-z0-9]{1,5})`"), 1))
    return g.withColumn("abertos", items).withColumn("arquivos", files)


def with_sidecars(files: DataFrame, ending: str = ".meta.yaml") -> DataFrame:
    """Files ``(caminho, texto)`` with what a file of their name and ``ending`` beside them says: map ``meta`` of its scalars, null without one."""
    side = files.where(F.col("caminho").endswith(ending)).select(F.substring("caminho", F.lit(1), F.length("caminho") - len(ending)).alias("base"), "texto")
    pairs = F.transform(F.filter(F.split("texto", "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:[ \t]*\S")), lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.btrim(F.regexp_extract(x, r"^[\w-]+:[ \t]*(.*)$", 1), F.lit(" \t\r\"'")).alias("v")))
    meta = side.select("base", F.map_from_entries(F.array_sort(F.filter(pairs, lambda p: p["k"] != ""))).alias("meta"))
    own = files.where(~F.col("caminho").endswith(ending)).withColumn("base", F.col("caminho"))
    return own.join(meta, "base", "left").drop("base")



# heads of notes

def front_list(c: Column, key: str) -> Column:
    """A list in the head of a note, written ``[a, "b"]``, as lines ``- a`` or as one value; quotes off, empty if there is none."""
    head = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    flow = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|\z))+)", 1)
    one = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*([^\[\s].*)$", 1)
    items = F.when(flow != "", F.regexp_extract_all(flow, F.lit(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+?)\s*(?:,|$)"""), 1)).when(block != "", F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t\r]*$"), 1)).when(one != "", F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(items, unquoted), lambda x: x != "")


def unquoted(c: Column) -> Column:
    """A scalar without the quotes around it: ``\\"`` and ``\\\\`` read in double ones, ``''`` in single ones."""
    t = F.btrim(c, F.lit(" \t\r"))
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    return F.when(t.rlike(r'^".*"$') & (F.length(t) > 1), F.regexp_replace(inner, r"\\(.)", "$1")).when(t.rlike(r"^'.*'$") & (F.length(t) > 1), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(t)


def quoted_scalar(c: Column) -> Column:
    """A scalar as it can stand in a head: in double quotes if it would read as something else."""
    plain = c.rlike(r"^[\p{L}\p{N}_./][\p{L}\p{N}_./ +()-]*$") & ~F.lower(c).isin("true", "false", "null", "yes", "no", "on", "off", "~") & ~c.rlike(r"^[-+]?[0-9.]+$") & (c == F.btrim(c))
    return F.when(plain, c).otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def repaired_head(c: Column) -> Column:
    """A note whose head's values that hold ``: `` or begin with a sign are put in quotes, items of flow lists too; lines that need none stay."""
    head = F.regexp_extract(c, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)

    def line(x: Column) -> Column:
        key, value = F.regexp_extract(x, r"^([A-Za-z_][\w-]*):[ \t]+(\S.*)$", 1), F.rtrim(F.regexp_extract(x, r"^([A-Za-z_][\w-]*):[ \t]+(\S.*)$", 2))
        bad = value.rlike(r"^[@`%&*!|>]|: |:$| #") & ~value.rlike(r"""^["'{\[]""")
        items = F.regexp_extract_all(F.regexp_extract(value, r"^\[(.*)\]$", 1), F.lit(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+?)\s*(?:,|$)"""), 1)
        broken = value.rlike(r"^\[.*\]$") & F.exists(items, lambda i: i.rlike(r"^[@`%&*!|>]|: |[\[\]{}]") & ~i.rlike(r"""^["']"""))
        mended = F.array_join(F.transform(items, lambda i: F.when(i.rlike(r"""^["']"""), i).otherwise(quoted_scalar(i))), ", ")
        return F.when((key != "") & bad, F.concat(key, F.lit(": "), quoted_scalar(value))).when((key != "") & broken, F.concat(key, F.lit(": ["), mended, F.lit("]"))).otherwise(x)

    new = F.array_join(F.transform(F.split(head, "\n"), line), "\n")
    at = F.locate("\n", c)
    return F.when(head == "", c).otherwise(F.concat(F.substring(c, F.lit(1), at), new, F.substring(c, at + 1 + F.length(head), F.length(c))))


def capture_date(name: Column) -> Column:
    """The moment a picture was taken, as its file's name tells it: ``yyyy-mm-dd`` and ``hh-mm-ss`` with any signs between; null if there is none or it is no time."""
    p = r"(?<!\d)((?:19|20)\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?([0-2]\d|3[01])(?:[-_ T.]+(?:at |às )?([01]\d|2[0-3])[-_.:h]?([0-5]\d)[-_.:m]?([0-5]\d))?(?!\d)"
    g = [F.regexp_extract(name, p, i) for i in range(1, 7)]
    day = F.concat_ws("-", *g[:3])
    time = F.when(g[3] != "", F.concat_ws(":", *g[3:])).otherwise("00:00:00")
    return F.when(name.rlike(p), F.concat_ws(" ", day, time).try_cast("timestamp_ntz"))
