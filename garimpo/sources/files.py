"""Readers and writers of the project's file forms."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions.texts import fixed_chunks


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows by ``schema`` and the lines that are no JSON of it; nothing stops at a bad line."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", schema + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.where("r.__bad IS NULL AND trim(value) <> ''").select("r.*").drop("__bad"), parsed.where("r.__bad IS NOT NULL").select("value")


def csv_markdown(spark: SparkSession, path: str, rows: int = 500) -> DataFrame:
    """``(path, linhas)``: each CSV file as a markdown table of at most ``rows`` rows; blank rows dropped, pipes escaped."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for b in batches:
            out = []
            for v in b["value"]:
                own = [[c.replace("|", "\\|").strip() for c in r] for r in csv.reader(io.StringIO(v)) if any(c.strip() for c in r)][: rows + 1]
                lines = ["| " + " | ".join(r) + " |" for r in own]
                if lines:
                    lines.insert(1, "|" + " --- |" * len(own[0]))
                out.append("\n".join(lines))
            yield pd.DataFrame({"path": b["path"], "texto": out})

    return text.mapInPandas(table, "path string, texto string")


class _Text(HTMLParser):
    """Headings, paragraphs, items and preformatted text; nothing of scripts, styles, navigation and footers."""

    skip = ("script", "style", "nav", "footer", "head")
    marks = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- ", "p": "", "pre": "", "div": "", "tr": "", "br": ""}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.skip:
            self.depth += 1
        elif tag in self.marks:
            self.out.append("\n" + self.marks[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip and self.depth:
            self.depth -= 1
        elif tag in self.marks:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(data)


def html_text_of(html: str) -> str:
    p = _Text()
    p.feed(html)
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x and x not in ("#", "##", "###", "####", "-"))


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """HTML to structured text; null stays null."""
    return s.map(html_text_of, na_action="ignore")


def inventory(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """``(path, modificado, bytes, tipo)`` of all files below a folder; glob patterns in ``excluded`` are left out, secrets too."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modificado"), F.col("length").alias("bytes"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("md", "mdx", "txt", "rst"), "document").when(ext.isin("py", "js", "ts", "go", "rs", "java", "c", "cpp", "sql", "sh"), "code").when(ext.isin("csv", "json", "yaml", "yml", "parquet"), "data").when(ext.isin("png", "jpg", "jpeg", "gif", "svg"), "image").otherwise("other")
    secret = F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^\.env|id_rsa|\.pem$|\.key$|credentials|secret")
    keep = ~secret
    for g in excluded or []:
        keep = keep & ~F.col("path").rlike(glob_pattern(g))
    return f.where(keep).withColumn("tipo", kind)


def glob_pattern(glob: str) -> str:
    """A glob of ignore files as a regular expression on whole paths: ``**`` any folders, ``*`` within one, ``/`` anchors."""
    import re

    body, i = "", 0
    g = glob.rstrip("/")
    while i < len(g):
        if g.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            body, i = body + ".*", i + 2
        elif g[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif g[i] == "?":
            body, i = body + "[^/]", i + 1
        else:
            body, i = body + re.escape(g[i]), i + 1
    return ("" if g.startswith("/") else "(?:^|/)") + body + "(?:/|$)"


def export_collection(chunks: DataFrame, path: str) -> None:
    """A neutral snapshot: ids, texts, metadata and vectors."""
    chunks.select("rid", "col", "id", "doc", "meta", "vec").write.mode("overwrite").parquet(path)


def verify_copy(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one table and not in the other, with their side; empty if the copies are equal."""
    cols = a.columns
    b = b.select(cols)
    return a.exceptAll(b).withColumn("lado", F.lit("a")).unionByName(b.exceptAll(a).withColumn("lado", F.lit("b")))


def source_map_files(spark: SparkSession, path: str) -> DataFrame:
    """``(mapa, fonte, conteudo)`` of the original sources in source maps."""
    m = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("mapa"), F.from_json("value", "sources array<string>, sourcesContent array<string>").alias("m"))
    return m.select("mapa", F.explode(F.arrays_zip("m.sources", "m.sourcesContent")).alias("z")).select("mapa", F.col("z.sources").alias("fonte"), F.col("z.sourcesContent").alias("conteudo"))


def log_tail(spark: SparkSession, path: str, level: Column | None = None, grep: str | None = None, lines: int = 100) -> DataFrame:
    """The last ``lines`` lines of a log that match."""
    d = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    if grep:
        d = d.where(F.col("value").rlike(grep))
    if level is not None:
        d = d.where(level)
    return d.orderBy(F.desc("n")).limit(lines).select("n", "value")


def ingest(df: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """Rows of an external collection: chunks with their ids and metadata as JSON text, numbers as text."""
    c = fixed_chunks(df, key, path, text)
    total = c.groupBy(key).agg(F.count("*").alias("t"))
    j = c.join(total, key)
    meta = F.to_json(F.struct(F.regexp_replace("chunk_id", "::chunk_[0-9]+$", "").alias("path"), F.lit("true").alias("is_external"), F.col("i").cast("string").alias("chunk"), F.col("t").cast("string").alias("total_chunks")))
    return j.select(F.lit("externo").alias("col"), F.col("chunk_id").alias("id"), F.col("chunk").alias("doc"), meta.alias("meta"))
