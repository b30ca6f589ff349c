"""Classification of notes and files, policies, links between notes, and their upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.text import fold

#: Stems of boilerplate files.
JUNK = ["license", "licence", "copying", "notice", "readme", "changelog", "changes", "contributing", "contributors", "authors", "requirements", "install", "installation", "help", "todo", "version", "manifest", "makefile", "dockerfile", "codeowners", "gitignore", "gitattributes", "editorconfig", "pylintrc", "flake8", "mypy"]
#: Texts that open licenses.
JUNK_TEXT = ["permission is hereby granted, free of charge", "apache license", "gnu general public license", "bsd 2-clause", "bsd 3-clause", "mozilla public license", "creative commons"]


def client_slug(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """A client's name as its index key: no accents, lower case, other runs one hyphen; then the aliases."""
    slug = F.btrim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    for k, v in (aliases or {}).items():
        slug = F.when(slug == k, F.lit(v)).otherwise(slug)
    return slug


def client_from_path(path: Column, roots: list[str], aliases: dict[str, str] | None = None) -> Column:
    """The first folder below the first root that holds the path, by its alias if it has one; null if nothing lies below that folder."""
    out = F.lit(None).cast("string")
    for r in reversed(roots):
        r = r.rstrip("/") + "/"
        rest = F.split(F.substring(path, F.lit(len(r) + 1), F.length(path)), "/")
        out = F.when(path.startswith(r), F.when(F.size(rest) >= 2, rest[0])).otherwise(out)
    for k, v in (aliases or {}).items():
        out = F.when(out == k, F.lit(v)).otherwise(out)
    return out


def note_kind(path: Column) -> Column:
    """``generated`` below ``<folder>/graphs/<graph>/``, else ``note``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.when((F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(2)) == "graphs"), "generated").otherwise("note")


def note_subkind(path: Column, content: Column) -> Column:
    p, head = F.lower(path), F.substring(F.coalesce(content, F.lit("")), 1, 600)
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    talk = p.contains("transcript-") | head.contains("session-transcript") | stem.rlike(r"(?i)(^|[-_ (])transcri[cç][aã]o\)?$")
    return F.when(note_kind(path) == "generated", "generated").when(talk, "transcript").when(p.contains("chat-"), "chat").otherwise("curated")


def is_junk(path: Column, content: Column) -> Column:
    """Boilerplate by file name, or by a license text in the first 500 characters; never null."""
    stem = F.ltrim(F.lower(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)), F.lit("."))
    head = F.lower(F.substring(content, 1, 500))
    named = stem.rlike(r"^(" + "|".join(JUNK) + r")([._\-][a-z0-9]{1,12})?$")
    hit = named
    for t in JUNK_TEXT:
        hit = hit | F.coalesce(head.contains(t), F.lit(False))
    return F.coalesce(hit, F.lit(False))


def effective_policy(calls: DataFrame, policies: DataFrame) -> DataFrame:
    """``calls`` with ``acao``: the rule of the client before that of ``*``, of the tool before that of its class; else allow.

    ``calls``: (cliente, ferramenta, classe, ...); ``policies``: (cliente, chave, acao), unique by the first two.
    """
    asks = calls.select("cliente", "ferramenta", "classe").distinct()
    tries = asks.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("pc"), k.alias("pk")) for i, (c, k) in enumerate((x, y) for x in (F.coalesce("cliente", F.lit("?")), F.lit("*")) for y in (F.col("ferramenta"), F.col("classe")))])))
    p = policies.select(F.col("cliente").alias("pc"), F.col("chave").alias("pk"), "acao")
    best = tries.select("cliente", "ferramenta", "classe", "t.*").join(p, ["pc", "pk"]).groupBy("cliente", "ferramenta", "classe").agg(F.min_by("acao", "i").alias("acao"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("cliente", "ferramenta", "classe")]
    return calls.alias("a").join(best.alias("b"), on, "left").select("a.*", F.coalesce("b.acao", F.lit("allow")).alias("acao"))


def within_path(ancestor: Column, path: Column) -> Column:
    """``path`` is ``ancestor`` or below it, on whole segments; a null ancestor holds everything."""
    a = F.when(ancestor == "/", "/").otherwise(F.rtrim(ancestor, F.lit("/")))
    return ancestor.isNull() | (path == a) | F.when(a == "/", path.startswith("/")).otherwise(path.startswith(F.concat(a, F.lit("/"))))


def containing_paths(items: DataFrame, path: str, key: str) -> DataFrame:
    """``(key, prefixo)``: every ancestor of each path and the path itself, to join containment by equality."""
    parts = F.filter(F.split(F.rtrim(F.col(path), F.lit("/")), "/"), lambda x: x != "")
    pre = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return items.where(F.col(path).isNotNull()).select(key, F.explode(pre).alias("prefixo"))


def shortest_suffixes(df: DataFrame, key: str, path: str) -> DataFrame:
    """``(key, rotulo)``: the shortest suffix of whole segments that no other path shares, the full path if none is.

    Suffixes are compared by 128 hash bits, so a deep path is not written out once a segment.
    """
    parts = F.reverse(F.split(path, "/"))
    s = df.select(key, path, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    own = F.concat_ws("\0", F.slice(F.reverse(F.split(path, "/")), F.lit(1), F.col("n")))
    s = s.select(key, path, "n", F.xxhash64(own, F.lit(1)).alias("a"), F.xxhash64(own, F.lit(2)).alias("b"))
    alone = s.groupBy("a", "b").agg(F.min(path).alias("p"), F.max(path).alias("q")).where("p = q").select("a", "b")
    best = s.join(alone, ["a", "b"]).groupBy(key, path).agg(F.min("n").alias("n"))
    j = df.select(key, path).join(best, [key, path], "left")
    return j.select(key, F.coalesce(F.array_join(F.reverse(F.slice(parts, F.lit(1), F.col("n"))), "/"), path).alias("rotulo"))


def budget_levels(items: DataFrame, by: str, order: list[str], costs: list[str], budget: int) -> DataFrame:
    """``items`` with ``nivel``: the fullest level (last of ``costs`` that is affordable) in order, until the budget of each group is spent.

    0 leaves an item out. Greedy and sequential within a group; groups stream through their task sorted by Spark.
    """
    src = items.select(by, *order, *costs)
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in src.columns) + ", nivel int"
    first = 1 + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left = object(), 0
        for b in batches:
            out = []
            for own, *prices in zip(b.column(0).to_pylist(), *[c.to_pylist() for c in b.columns[first:]]):
                if own != group:
                    group, left = own, budget
                level = next((i for i in range(len(prices), 0, -1) if prices[i - 1] <= left), 0)
                left -= prices[level - 1] if level else 0
                out.append(level)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "nivel"])

    return src.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def node_search(nodes: DataFrame, terms: list[str], top: int = 20) -> DataFrame:
    """``(id, score)``: nodes by the sum of idf = ln(1 + N / df) of shared label terms, over the number of label terms.

    ``nodes``: (id, termos). Ties go to the smaller id.
    """
    t = nodes.select("id", F.explode(F.array_distinct("termos")).alias("termo"), F.size(F.array_distinct("termos")).alias("n"))
    hit = t.where(F.col("termo").isin(terms))
    df = hit.groupBy("termo").agg(F.count("*").alias("df"))
    total = nodes.agg(F.count("*").alias("total"))
    idf = df.join(F.broadcast(total)).select("termo", F.log(1 + F.col("total") / F.col("df")).alias("idf"))  # total is one row
    s = hit.join(idf, "termo").groupBy("id").agg(F.round(F.sum("idf") / F.max("n"), 6).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(top)


def latest_wins(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``; used for nodes that several extractions give."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cron_matches(ts: Column, spec: str) -> Column:
    """Whether a five-field cron line fires in the minute of ``ts``: lists, ranges, steps; either day field if both are set."""

    def field(c: Column, text: str, low: int, high: int, sunday: bool = False) -> Column:
        allowed: set[int] = set()
        for part in text.split(","):
            body, _, step = part.partition("/")
            if body == "*":
                a, b = low, high
            else:
                a, _, b = body.partition("-")
                a, b = int(a), int(b or (high if step else a))
            allowed |= set(range(int(a), int(b) + 1, int(step or 1)))
        if sunday and 7 in allowed:
            allowed.add(0)
        bad = [x for x in allowed if not low <= x <= max(high, 7 if sunday else high)]
        if bad:
            raise ValueError(f"{bad} out of range in {text}")
        return c.isin(sorted(allowed))

    spec = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *"}.get(spec, spec)
    m, h, dom, mon, dow = spec.split()
    day = field(F.dayofmonth(ts), dom, 1, 31)
    week = field(F.dayofweek(ts) - 1, dow, 0, 6, True)
    days = day | week if dom != "*" and dow != "*" else day & week
    return field(F.minute(ts), m, 0, 59) & field(F.hour(ts), h, 0, 23) & field(F.month(ts), mon, 1, 12) & days


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, parte, titulo, corpo)``: a text cut before its headings of the first two levels; what comes first has no title."""
    parts = F.split(F.col(text), r"(?md)(?=^#{1,2}[ \t]+\S)")
    e = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.filter(parts, lambda x: F.trim(x, F.lit(" \t\r\n")) != "")).alias("parte", "p"))
    title = F.regexp_extract("p", r"\A#{1,2}[ \t]+(\S[^\n]*)", 1)
    return e.select(key, "parte", F.nullif(F.trim(title), F.lit("")).alias("titulo"), F.btrim(F.regexp_replace("p", r"\A#{1,2}[ \t]+\S[^\n]*", ""), F.lit(" \t\r\n")).alias("corpo"))


def vault_health(docs: DataFrame, links: DataFrame) -> DataFrame:
    """One row: notes, empty, without path, generated, cited by none, broken links. ``links``: (alvo, citado_por, quebrado)."""
    stem = F.regexp_replace("caminho", r"\.md$", "")
    cited = docs.where("caminho IS NOT NULL").select(stem.alias("alvo")).distinct().join(links.select("alvo"), "alvo", "left_anti")
    a = docs.agg(F.count("*").alias("notas"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("vazias"), F.count_if(F.col("caminho").isNull()).alias("sem_caminho"), F.count_if(F.coalesce(note_kind(F.col("caminho")), F.lit("note")) == "generated").alias("geradas"))
    return a.join(cited.agg(F.count("*").alias("orfas"))).join(links.agg(F.count_if("quebrado").alias("links_quebrados")))  # three single rows


def chosen_handoffs(asks: DataFrame, handoffs: DataFrame) -> DataFrame:
    """``(pedido, projeto, escolhida)``: the handoff of the project that serves each ask ``(pedido, projeto, pasta)``, null if none does.

    ``handoffs``: (id, projeto, manual, criado, pasta). A handoff serves folders at or below its own, without one all of them. Manual before
    automatic, then the newest, the deepest folder, the greatest id. Containment is joined by equality on the ancestors of the asker's folder.
    """
    a = asks.select("pedido", "projeto", "pasta").withColumn("k", F.concat_ws("\0", "pedido", "projeto"))
    up = containing_paths(a, "pasta", "k").select("k", F.col("prefixo").alias("p"))
    every = a.select("k", F.lit(None).cast("string").alias("p")).unionByName(up).join(a.select("k", "pedido", "projeto"), "k")
    own = F.when(F.col("pasta").isNotNull(), F.when(F.rtrim("pasta", F.lit("/")) == "", "/").otherwise(F.rtrim("pasta", F.lit("/"))))
    h = handoffs.select("id", F.col("projeto").alias("hp"), "manual", "criado", own.alias("hf"))
    j = every.join(h, (F.col("projeto") == F.col("hp")) & F.col("p").eqNullSafe(F.col("hf")))
    depth = F.coalesce(F.size(F.filter(F.split("hf", "/"), lambda x: x != "")), F.lit(-1))
    best = j.groupBy("k").agg(F.max(F.struct("manual", "criado", depth.alias("d"), "id")).alias("m"))
    return a.join(best, "k", "left").select("pedido", "projeto", F.col("m.id").alias("escolhida"))
