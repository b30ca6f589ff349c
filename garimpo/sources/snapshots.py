"""Snapshots of collections and graphs: written, verified, read back; files with a manifest of their hashes; graphs in the forms of other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.operators.graph import prune_dangling
from garimpo.operators.ranking import knn_blocks

COLUMNS = ["rid", "col", "id", "doc", "meta", "vec"]


def by_ids(collection: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the listed ids, chosen columns; ids that are not there give nothing, repeated ones one row."""
    return collection.join(ids.select("rid").distinct(), "rid", "left_semi").select("rid", *[c for c in columns if c != "rid"])


def peek(collection: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows in the order of storage, whole."""
    return collection.orderBy("rid").limit(n)


def backup(collection: DataFrame, folder: str) -> str:
    """The collection and, beside it, the sums that ``verified`` compares; returns the folder."""
    collection.write.mode("overwrite").parquet(f"{folder}/rows")
    sums(collection.sparkSession.read.parquet(f"{folder}/rows")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/sums")
    return folder


def sums(df: DataFrame) -> DataFrame:
    """One row: how many rows, and a sum of their hashes that does not depend on order."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    mask = F.concat(*[c.isNull().cast("int").cast("string") for c in cols])
    return df.agg(F.count("*").alias("linhas"), F.sum(F.xxhash64(mask, *cols).cast("decimal(38,0)")).alias("soma"))


def verified(spark: SparkSession, folder: str) -> bool:
    """Whether a backup holds what was written."""
    return sums(spark.read.parquet(f"{folder}/rows")).exceptAll(spark.read.parquet(f"{folder}/sums")).isEmpty()


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a backup; raises if they are not what was written."""
    if not verified(spark, folder):
        raise ValueError(f"{folder} does not hold what was written")
    return spark.read.parquet(f"{folder}/rows")


def same_answers(a: DataFrame, b: DataFrame, queries: DataFrame, key: str, vec: str, k: int = 10, tolerance: float = 1e-5) -> DataFrame:
    """``(qid, posicao, a, b)`` where the first ``k`` of two copies differ by more than ``tolerance`` in cosine; empty if they answer alike.

    Places of equal cosine may change, so cosines are compared, not keys.
    """
    x, y = (knn_blocks(d, queries, key, vec, k).select("qid", "posicao", F.col("cos").alias(n)) for d, n in ((a, "a"), (b, "b")))
    return x.join(y, ["qid", "posicao"], "full").where(~F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(caminho, bytes, marca)`` of the files below a folder, paths relative to it, SHA-256 of the contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = root.rstrip("/").split("/")[-1]
    return f.select(F.regexp_extract("path", f".*?/{name}/(.*)$", 1).alias("caminho"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("marca"))


def manifest_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``(caminho, falha)``: files that are missing, changed or not in the manifest."""
    j = expected.select("caminho", F.col("marca").alias("e")).join(found.select("caminho", F.col("marca").alias("f")), "caminho", "full")
    return j.select("caminho", F.when(F.col("f").isNull(), "falta").when(F.col("e").isNull(), "a mais").when(F.col("e") != F.col("f"), "mudou").alias("falha")).where("falha IS NOT NULL")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph in one JSON object with ``nodes`` and ``links`` or ``edges``; edges of unknown ends are left out.

    The file is one JSON text, so one task parses it; larger graphs are kept as tables.
    """
    node = "id string, label string, source_file string, source_location string, file_type string, community int"
    edge = "source string, target string, relation string, confidence string, weight string"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes array<struct<{node.replace(' ', ':').replace(',:', ', ')}>>, links array<struct<{edge.replace(' ', ':').replace(',:', ', ')}>>, edges array<struct<{edge.replace(' ', ':').replace(',:', ', ')}>>").alias("g"))
    n = d.select(F.explode("g.nodes").alias("n")).select("n.*").where("id IS NOT NULL")
    e = d.select(F.explode(F.coalesce("g.links", "g.edges")).alias("e")).select("e.*")
    return n, prune_dangling(e, n)


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, may_shrink: bool = False, least: float = 0.5) -> None:
    """Both tables, unless the new graph has less than ``least`` of the nodes of the one that is there: that is more likely a failed build."""
    spark = nodes.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/nodes/_SUCCESS")  # noqa: SLF001
    if not may_shrink and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):  # noqa: SLF001
        old, new = spark.read.parquet(f"{folder}/nodes").count(), nodes.count()
        if new < least * old:
            raise ValueError(f"the new graph has {new} nodes, the old one {old}")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")


def _xml(c):  # noqa: ANN001, ANN202
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(ordem, linha)``: GraphML, one element a line; written in the order of ``ordem``."""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<key id="relation" for="edge" attr.name="relation" attr.type="string"/>', '<graph edgedefault="directed">']
    spark = nodes.sparkSession
    top = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "a int, b long, linha string")
    n = nodes.select(F.lit(1).alias("a"), F.xxhash64("id").alias("b"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="label">'), _xml(F.coalesce("label", F.lit(""))), F.lit("</data></node>")).alias("linha"))
    e = edges.select(F.lit(2).alias("a"), F.xxhash64("source", "target", "relation").alias("b"), F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('"><data key="relation">'), _xml(F.coalesce("relation", F.lit(""))), F.lit("</data></edge>")).alias("linha"))
    return top.unionByName(n).unionByName(e).select(F.struct("a", "b", "linha").alias("ordem"), "linha")


def vault_notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(caminho, texto)``: one note a node with links to its neighbors by relation; a node's links are its degree."""
    out = edges.join(nodes.select(F.col("id").alias("target"), F.coalesce("label", "id").alias("tl")), "target").groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), F.coalesce("relation", F.lit("")), F.lit(" [["), "target", F.lit("|"), "tl", F.lit("]]")))), "\n").alias("links"))
    j = nodes.select("id", F.coalesce("label", "id").alias("l")).join(out, "id", "left")
    return j.select(F.concat("id", F.lit(".md")).alias("caminho"), F.concat(F.lit("# "), "l", F.coalesce(F.concat(F.lit("\n\n"), "links"), F.lit("")), F.lit("\n")).alias("texto"))


def report(nodes: DataFrame, edges: DataFrame, members: DataFrame, central: DataFrame) -> DataFrame:
    """``(ordem, linha)``: a graph's report in markdown: its size, its central nodes, its communities by size with their first members."""
    c = members.groupBy("community").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("id")), 1, 5), ", ").alias("ids"))
    line = lambda df, o, k, x: df.select(F.struct(F.lit(o).alias("a"), k.cast("long").alias("b"), x.alias("l")).alias("ordem"), x.alias("linha"))
    zero = F.lit(0)
    size = nodes.agg(F.countDistinct("id").alias("n")).join(edges.agg(F.count("*").alias("e")))  # two single rows
    heads = nodes.sparkSession.createDataFrame([(0, "# Grafo"), (2, "## Centrais"), (4, "## Comunidades")], "o int, t string")
    top = heads.select(F.struct(F.col("o").alias("a"), F.lit(0).cast("long").alias("b"), F.col("t").alias("l")).alias("ordem"), F.col("t").alias("linha"))
    return top.unionByName(line(size, 1, zero, F.concat("n", F.lit(" nodes, "), "e", F.lit(" edges")))).unionByName(line(central, 3, -F.col("grau"), F.concat(F.lit("- "), "id", F.lit(" ("), F.col("grau").cast("string"), F.lit(")")))).unionByName(line(c, 5, -F.col("n"), F.concat(F.lit("- "), F.col("community").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" ("), "ids", F.lit(")"))))


def call_diagram(edges: DataFrame, relation: str = "calls") -> DataFrame:
    """``(linha)``: calls as lines of a flow diagram, each once."""
    safe = lambda c: F.regexp_replace(c, r"[^\w]", "_")
    return edges.where(F.col("relation") == relation).select(F.concat(safe(F.col("source")), F.lit(" --> "), safe(F.col("target"))).alias("linha")).distinct()
