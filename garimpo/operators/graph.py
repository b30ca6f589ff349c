"""Property graphs as two tables: nodes (id, ...) and edges (source, target, relation, ...)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.runtime import checkpoint

#: Relations along which a change spreads.
IMPACT = ["calls", "indirect_call", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds"]


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return e.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)


def repair_edges(edges: DataFrame) -> DataFrame:
    """Weights that are null, no number, NaN, infinite or negative become 1."""
    w = F.col("weight").try_cast("double")
    return edges.withColumn("weight", F.when(w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf")), w).otherwise(F.lit(1.0)))


def collapse_undirected(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair and relation; of two directions the smaller (source, target) stays."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    w = Window.partitionBy(a, b, "relation").orderBy("source", "target")
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def degrees(edges: DataFrame, hidden: tuple[str, ...] = ("contains",)) -> DataFrame:
    """In and out degree of every node of an edge, without structural relations."""
    e = edges.where(~F.col("relation").isin(*hidden))
    ends = e.select(F.col("source").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("in").alias("entra"), F.sum("out").alias("sai"), (F.sum("in") + F.sum("out")).alias("grau"))


def neighbors_of(edges: DataFrame, ids: DataFrame, limit: int = 50, hidden: tuple[str, ...] = ("contains",)) -> DataFrame:
    """``(id, sentido, relation, vizinho, grau, ordem)``: neighbors by relation, degree and id, ``limit`` a side."""
    e = edges.where(~F.col("relation").isin(*hidden)).select("source", "target", "relation").distinct()
    both = e.select(F.col("source").alias("id"), F.lit("sai").alias("sentido"), "relation", F.col("target").alias("vizinho")).union(e.select("target", F.lit("entra"), "relation", "source"))
    near = both.join(ids.select("id").distinct(), "id", "left_semi")
    near = near.join(degrees(edges, hidden).select(F.col("id").alias("vizinho"), "grau"), "vizinho")
    w = Window.partitionBy("id", "sentido").orderBy("relation", F.desc("grau"), "vizinho")
    return near.withColumn("ordem", F.row_number().over(w)).where(F.col("ordem") <= limit)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, relations: list[str] | None = None, reverse: bool = False, undirected: bool = False) -> DataFrame:
    """``(seed, id, nivel)``: nodes within ``depth`` steps of each seed with their least distance.

    Breadth first: a round joins only the last frontier and drops what was visited, so work follows the edges reached.
    """
    e = edges if relations is None else edges.where(F.col("relation").isin(relations))
    e = e.select(F.col("target" if reverse else "source").alias("id"), F.col("source" if reverse else "target").alias("next")).where("id <> next")
    if undirected:
        e = e.union(e.select("next", "id"))
    e = e.distinct()
    seen = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("nivel", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(e, "id").select("seed", F.col("next").alias("id")).distinct()
        front = checkpoint(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("nivel", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def affected(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """What depends on the seeds, directly or not: reverse reach over the impact relations."""
    return reach(edges, seeds, depth, IMPACT, reverse=True)


def _paths(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(src, dst, caminho)`` breadth first over steps ``(at, next, passo)``; sources whose targets are all found drop out."""
    open_ = checkpoint(pairs)
    front = open_.select("src", F.col("src").alias("at"), F.array(F.struct(F.col("src").alias("id"), F.lit(None).cast("string").alias("relation"), F.lit("").alias("sentido"))).alias("path")).distinct()
    seen = front.select("src", "at")
    done = open_.select("src", "dst", F.lit(None).cast(front.schema["path"].dataType).alias("caminho")).limit(0)
    while True:
        hit = front.join(open_, "src").where(F.col("at") == F.col("dst")).select("src", "dst", F.col("path").alias("caminho"))
        done = checkpoint(done.unionByName(hit))
        open_ = checkpoint(open_.join(hit.select("src", "dst"), ["src", "dst"], "left_anti"))
        live = front.join(open_.select("src").distinct(), "src", "left_semi")
        nxt = live.join(e, "at").select("src", F.col("next").alias("at"), F.concat("path", F.array(F.struct(F.col("next").alias("id"), F.col("relation"), F.col("sentido")))).alias("path"))
        nxt = nxt.groupBy("src", "at").agg(F.min("path").alias("path")).join(seen, ["src", "at"], "left_anti")
        front = checkpoint(nxt)
        if front.isEmpty():
            return done
        seen = checkpoint(seen.union(front.select("src", "at")))


def shortest_paths(edges: DataFrame, pairs: DataFrame, hidden: tuple[str, ...] = ("contains",), undirected: bool = True) -> DataFrame:
    """``(src, dst, passos, caminho, sentidos, dirigido)``: one shortest path per pair ``(src, dst)``, the smallest nodes at ties.

    Along the edges first; pairs without such a path are looked for again without regard to direction. ``sentidos`` has ``>`` or ``<`` for each
    step. Paths may be of any length: a round joins the last frontier only, and a source whose targets are found goes no further. Pairs that
    are not connected, or of which an end is null, have no row.
    """
    e = edges.where(~F.col("relation").isin(*hidden)).where("source <> target").select(F.col("source").alias("at"), F.col("target").alias("next"), "relation", F.lit(">").alias("sentido"))
    e = checkpoint(e.groupBy("at", "next", "sentido").agg(F.min("relation").alias("relation")))
    want = checkpoint(pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = _paths(e, want).withColumn("dirigido", F.lit(True))
    if undirected:
        rest = checkpoint(want.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
        if not rest.isEmpty():
            both = e.unionByName(e.select(F.col("next").alias("at"), F.col("at").alias("next"), F.lit("<").alias("sentido"), "relation"))
            both = checkpoint(both.groupBy("at", "next").agg(F.max(F.struct("sentido", "relation")).alias("m")).select("at", "next", "m.relation", "m.sentido"))
            found = found.unionByName(_paths(both, rest).withColumn("dirigido", F.lit(False)))
    return found.select("src", "dst", (F.size("caminho") - 1).alias("passos"), F.col("caminho.id").alias("caminho"), F.array_join(F.col("caminho.sentido"), "").alias("sentidos"), "dirigido")


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(community, n, internas, coesao)``: internal edges over all possible ones; 1 for up to one member."""
    e = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()
    m = members.select("id", "community")
    inner = e.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("internas"))
    n = m.groupBy("community").agg(F.count("*").alias("n"))
    j = n.join(inner, "community", "left").withColumn("internas", F.coalesce("internas", F.lit(0)))
    return j.withColumn("coesao", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.round(F.col("internas") / (F.col("n") * (F.col("n") - 1) / 2), 6)))


def cross_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(de, para, arestas)``: edges between different communities."""
    m = members.select("id", "community")
    j = edges.join(m.toDF("source", "de"), "source").join(m.toDF("target", "para"), "target").where("de <> para")
    return j.groupBy("de", "para").agg(F.count("*").alias("arestas"))


def fingerprint(members: DataFrame) -> DataFrame:
    """``(community, marca)``: 16 hex digits of the SHA-256 of the sorted member ids, each ended by NUL.

    Members stream through their task in the order of their ids, so a community of any size is hashed without being held.
    """
    kind = members.schema["community"].dataType.simpleString()
    src = members.select("community", F.col("id").cast("string").alias("id")).repartition("community").sortWithinPartitions("community", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mark, open_ = None, None, False
        names = ["community", "marca"]
        for b in batches:
            done, marks = [], []
            for c, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not open_ or c != last:
                    if open_:
                        done.append(last), marks.append(mark.hexdigest()[:16])
                    last, mark, open_ = c, hashlib.sha256(), True
                mark.update(((i or "") + "\0").encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, b.schema.types[0]), pa.array(marks, pa.string())], names)
            types = b.schema.types
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([last], types[0]), pa.array([mark.hexdigest()[:16]], pa.string())], names)

    return src.mapInArrow(run, f"community {kind}, marca string")


def communities(edges: DataFrame, most: int = 500) -> DataFrame:
    """``(id, community)`` by synchronous label propagation: the most frequent label of the neighbors and of the node itself.

    Deterministic, ties to the smallest label. Rounds go on until nothing changes; labels of such votes settle or swing between two
    states, of which the smaller label is taken. Raises if neither happens in ``most`` rounds. Not the partition of a modularity
    optimiser, which Spark lacks.
    """
    e = edges.select("source", "target").where("source <> target")
    e = checkpoint(e.union(e.select("target", "source")).distinct())
    label = checkpoint(e.select(F.col("source").alias("id")).distinct().withColumn("community", F.col("id")))
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("id", "community").cast("decimal(38,0)"))).first())
    before, marks = label, [state(label)]
    for _ in range(most):
        votes = e.join(label.toDF("target", "community"), "target").select(F.col("source").alias("id"), "community").union(label)
        n = votes.groupBy("id", "community").agg(F.count("*").alias("n"))
        best = n.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m"))
        before, label = label, checkpoint(best.select("id", "m.community"))
        marks.append(state(label))
        if marks[-1] == marks[-2]:
            return label
        if len(marks) > 2 and marks[-1] == marks[-3]:
            return label.toDF("id", "a").join(before.toDF("id", "b"), "id").select("id", F.least("a", "b").alias("community"))
    raise RuntimeError(f"labels did not settle in {most} rounds")


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """``(ciclo, tamanho)``: simple directed cycles of up to ``longest`` nodes, each once, beginning at its smallest node.

    Paths grow only through nodes larger than the first, so each cycle is found by one rotation. Nodes that no cycle can
    pass are trimmed first.
    """
    e = edges.select("source", "target").where("source <> target").distinct()
    for _ in range(3):
        e = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        e = e.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
    e = checkpoint(e)
    paths = e.where("source < target").select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("path"))
    found = None
    for n in range(2, longest + 1):
        closed = paths.join(e.toDF("last", "first"), ["last", "first"]).select(F.col("path").alias("ciclo"), F.lit(n).alias("tamanho"))
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            grown = paths.join(e.toDF("last", "next"), "last").where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
            paths = grown.select("first", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"))
    return found


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, nivel)`` of a dependency graph (source before target): the longest path to each node. Raises on a cycle.

    One round a level, however many there are; a round joins only the nodes that are left.
    """
    e = checkpoint(edges.select("source", "target").distinct())
    left = checkpoint(nodes.select("id").union(e.select("source")).union(e.select("target")).where("id IS NOT NULL").distinct())
    out = left.withColumn("nivel", F.lit(0)).limit(0)
    level = 0
    while not left.isEmpty():
        e = checkpoint(e.join(left.toDF("source"), "source", "left_semi"))
        ready = checkpoint(left.join(e.select(F.col("target").alias("id")).distinct(), "id", "left_anti").withColumn("nivel", F.lit(level)))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        out = checkpoint(out.unionByName(ready)) if level % 50 == 49 else out.unionByName(ready)
        left = checkpoint(left.join(ready.select("id"), "id", "left_anti"))
        level += 1
    return out


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One statement a line for a graph store."""
    q = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = nodes.select(F.concat(F.lit("MERGE (n {id: "), q(F.col("id")), F.lit("}) SET n.label = "), q(F.col("label")), F.lit(";")).alias("linha"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), q(F.col("source")), F.lit("}), (b {id: "), q(F.col("target")), F.lit("}) MERGE (a)-[:"), F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_")), F.lit("]->(b);")).alias("linha"))
    return n.union(e)


def surprise(edges: DataFrame) -> Column:
    """Score of an edge between files: confidence 3, 2, 1; +2 other file type, +2 other top folder, +1 other community; half as much again if semantic."""
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    base = base + F.when(F.col("type_a") != F.col("type_b"), 2).otherwise(0) + F.when(F.col("top_a") != F.col("top_b"), 2).otherwise(0) + F.when(F.col("community_a") != F.col("community_b"), 1).otherwise(0)
    return base * F.when(F.col("relation") == "semantically_similar_to", 1.5).otherwise(1.0)


def backfilled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with valid weights, and with the file of their source, else of their target, where they name none."""
    n = nodes.where("source_file IS NOT NULL AND source_file <> ''").groupBy("id").agg(F.min("source_file").alias("__f"))
    j = repair_edges(edges).join(n.toDF("source", "__fa"), "source", "left").join(n.toDF("target", "__fb"), "target", "left")
    return j.withColumn("source_file", F.coalesce(F.nullif("source_file", F.lit("")), "__fa", "__fb")).select(edges.columns)
