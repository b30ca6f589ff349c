"""Graphs of code and concepts: search by name, the surroundings of a question, seeds, filters of the build, communities, citations.

Nodes: (id, label, source_file, source_location, file_type, community); edges: (source, target, relation, confidence). Columns that are
missing count as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.text import casefolded, fold_latin
from garimpo.operators.graph import IMPACT, degrees
from garimpo.operators.ranking import global_rank, top_k
from garimpo.runtime import checkpoint

#: Labels that many programs share.
BUILTINS = [
    "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object", "True", "False",
    "MagicMock", "Mock", "AsyncMock", "NonCallableMock", "NonCallableMagicMock", "PropertyMock", "patch", "sentinel",
    "Path", "Any", "Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable", "Type", "ClassVar", "Final", "Literal", "Protocol",
    "Counter", "defaultdict", "OrderedDict", "datetime", "Enum", "os", "sys", "re", "json", "io", "abc", "typing",
]
#: Keys of JSON files that say nothing.
JSON_KEYS = ["start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version", "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies"]
#: Endings of files by the family of their language.
FAMILIES = {
    "py": [".py", ".pyi"], "js": [".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".mts", ".cts"], "go": [".go"], "rs": [".rs"], "jvm": [".java", ".kt", ".scala", ".groovy"],
    "c": [".c", ".h", ".cc", ".cpp", ".hpp", ".cxx", ".hh", ".hxx", ".cu", ".cuh", ".metal", ".m", ".mm"], "rb": [".rb", ".rake"], "php": [".php"], "cs": [".cs"], "swift": [".swift"], "lua": [".lua"],
}
#: Kinds of files that are neither code nor text.
PAPERS, IMAGES = [".pdf"], [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"]
HIDDEN = ("contains",)


def name_terms(c: Column) -> Column:
    """Words of a name in order, repeats kept: camelCase split, marks folded, two characters at least."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.regexp_extract_all(F.lower(fold_latin(spaced)), F.lit("([a-z0-9]+)"), 1), lambda x: F.length(x) > 1)


def is_test_file(path: Column) -> Column:
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return F.concat(F.lit("/"), p).rlike("/tests?/") | F.element_at(F.split(p, "/"), -1).startswith("test_")


def suffix(path: Column) -> Column:
    """The file's ending with its dot, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1), r"[^.](\.[^.]+)$", 1))


def family(path: Column) -> Column:
    """The family of the file's language; null if it is none of the known ones."""
    return reduce(lambda out, kv: F.when(suffix(path).isin(kv[1]), kv[0]).otherwise(out), FAMILIES.items(), F.lit(None).cast("string"))


def search_nodes(nodes: DataFrame, edges: DataFrame, asks: DataFrame, top: int = 10, rationale: bool = False) -> DataFrame:
    """``(qid, id, score, posicao)``: nodes for every ask ``(qid, texto)``, best first; ties by degree, then id.

    Sum of ln(1 + N / df) over the ask's terms found in label or id, 1000 more for the same name, 10 more for a label that contains the
    ask, over the number of the label's terms; nodes of test files count 0.3 unless the ask speaks of tests. Rationale nodes are
    left out unless asked for. All asks are answered in one pass; only postings of their terms are shuffled.
    """
    text = lambda c: F.lower(fold_latin(F.coalesce(c, F.lit(""))))
    n = nodes.select("id", "label", "source_file", "file_type")
    terms = n.select("id", F.explode(F.array_union(name_terms(F.col("label")), name_terms(F.col("id")))).alias("t"))
    a = asks.select("qid", F.trim(text(F.col("texto"))).alias("alvo"), name_terms(F.col("texto")).alias("ts")).where("alvo <> ''")
    want = a.select("qid", F.explode("ts").alias("t"))
    hit = checkpoint(terms.join(want.select("t").distinct(), "t", "left_semi"))
    total = n.agg(F.count("*").alias("total"))  # one row
    idf = hit.groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("t", F.log(1 + F.col("total") / F.col("df")).alias("idf"))
    sums = want.join(hit.join(idf, "t"), "t").groupBy("qid", "id").agg(F.sum("idf").alias("p"))
    j = sums.join(a, "qid").join(n, "id")
    if not rationale:
        j = j.where(F.coalesce(F.col("file_type") != "rationale", F.lit(True)))
    label = text(F.col("label"))
    base = F.when(label.rlike(r"\.(py|ts|go|rs|js)$"), F.regexp_replace(label, r"\.[^.]*$", "")).otherwise(label)
    same = (label == F.col("alvo")) | (base == F.col("alvo")) | (name_terms(F.col("label")) == F.col("ts"))
    score = (F.col("p") + F.when(same, 1000.0).when(label.contains(F.col("alvo")), 10.0).otherwise(0.0)) / F.greatest(F.size(name_terms(label)), F.lit(1))
    tests = F.exists("ts", lambda t: t.startswith("test"))
    score = score * F.when(is_test_file(F.col("source_file")) & ~tests, 0.3).otherwise(1.0)
    s = j.select("qid", "id", F.round(score, 6).alias("score")).join(degrees(edges, HIDDEN).select("id", "grau"), "id", "left")
    ranked = top_k(s, ["qid"], [F.desc("score"), F.desc(F.coalesce("grau", F.lit(0))), F.asc("id")], top)
    return ranked.select("qid", "id", "score", "posicao")


def question_subgraph(nodes: DataFrame, edges: DataFrame, asks: DataFrame, depth: int = 2, seeds: int = 3, fan: int = 8) -> DataFrame:
    """``(qid, tipo, a, relation, b, nivel)``: seeds, edges and rationales around every ask ``(qid, texto)``.

    Seeds are the best nodes for the whole ask and the best one for each of its rarest terms, twice ``seeds`` at most. From each node of the
    last round the ``fan`` neighbors of highest degree are taken, either way, ties by id. Structure and rationales are not walked;
    rationales of reached nodes come along. A round joins only the last frontier.
    """
    whole = search_nodes(nodes, edges, asks, seeds).select("qid", F.lit(0).alias("o"), F.col("posicao").alias("p"), "id")
    terms = asks.select("qid", F.explode(F.array_distinct(name_terms(F.col("texto")))).alias("t"))
    per_node = nodes.select("id", F.explode(F.array_union(name_terms(F.col("label")), name_terms(F.col("id")))).alias("t"))
    df = per_node.join(terms.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("df"))
    # terms that no node has weigh nothing and come last
    rare = top_k(terms.join(df, "t", "left"), ["qid"], [F.asc_nulls_last("df"), F.asc("t")], seeds, "r").select("qid", "t", "r")
    one = rare.select(F.concat_ws("\0", F.col("qid").cast("string"), "t").alias("k"), "qid", "t", "r")
    best = search_nodes(nodes, edges, one.select(F.col("k").alias("qid"), F.col("t").alias("texto")), 1).select(F.col("qid").alias("k"), "id")
    more = one.join(best, "k").select("qid", F.lit(1).alias("o"), F.col("r").alias("p"), "id")
    seed = whole.unionByName(more).groupBy("qid", "id").agg(F.min(F.struct("o", "p")).alias("at"))
    seed = checkpoint(top_k(seed, ["qid"], [F.asc("at")], 2 * seeds).where((F.col("at.o") == 0) | (F.col("posicao") <= 2 * seeds)).select("qid", "id"))
    plain = edges.where(~F.col("relation").isin(*HIDDEN, "rationale_for")).select("source", "relation", "target")
    both = plain.select(F.col("source").alias("id"), F.col("target").alias("other"), "source", "relation", "target").union(plain.select(F.col("target").alias("id"), F.col("source").alias("other"), "source", "relation", "target"))
    both = checkpoint(both.join(degrees(edges, HIDDEN).select(F.col("id").alias("other"), "grau"), "other", "left"))
    seen, front, found = seed, seed, None
    for level in range(1, depth + 1):
        near = top_k(front.join(both, "id"), ["qid", "id"], [F.desc(F.coalesce("grau", F.lit(0))), F.asc("other"), F.asc("relation"), F.asc("source")], fan, "n")
        near = checkpoint(near.select("qid", "source", "relation", "target", "other"))
        took = near.select("qid", F.lit("aresta").alias("tipo"), F.col("source").alias("a"), "relation", F.col("target").alias("b"), F.lit(level).alias("nivel"))
        found = took if found is None else found.unionByName(took)
        front = checkpoint(near.select("qid", F.col("other").alias("id")).distinct().join(seen, ["qid", "id"], "left_anti"))
        seen = checkpoint(seen.unionByName(front))
    why = edges.where("relation = 'rationale_for'").select(F.col("target").alias("id"), F.col("source").alias("r"))
    reasons = seen.join(why, "id").select("qid", F.lit("racional").alias("tipo"), F.col("id").alias("a"), F.lit("rationale_for").alias("relation"), F.col("r").alias("b"), F.lit(None).cast("int").alias("nivel")).distinct()
    starts = seed.select("qid", F.lit("semente").alias("tipo"), F.col("id").alias("a"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("b"), F.lit(0).alias("nivel"))
    out = starts.unionByName(reasons)
    if found is not None:
        out = out.unionByName(found.groupBy("qid", "tipo", "a", "relation", "b").agg(F.min("nivel").alias("nivel")))
    return out


def _grams(c: Column, n: Column) -> Column:
    """Hashes of all runs of ``n`` characters; none in a shorter text."""
    at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.substring(c, i, n))))


def _inside(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """``(k, lo, hi)``: least and greatest id of the labels that hold each of different non-empty ``keys (k)``; ``labels``: different ones as (l, lo, hi).

    A key meets the labels that hold its rarest run of characters, of the greatest power of two that it is long enough for, so neither side
    is broadcast and no number of keys is too many.
    """
    size = F.pow(F.lit(2), F.floor(F.log2(F.length("k")))).cast("int")
    sizes = [r["n"] for r in keys.select(size.alias("n")).distinct().collect()]  # one number a doubling of the length
    if not sizes:
        return keys.join(labels.select(F.col("l").alias("k"), "lo", "hi"), "k")
    own = checkpoint(keys.select("k", F.explode(_grams(F.col("k"), size)).alias("g")))
    held = labels.select("l", "lo", "hi", F.explode(F.array_distinct(F.concat(*[_grams(F.col("l"), F.lit(n)) for n in sizes]))).alias("g"))
    held = checkpoint(held.join(own.select("g").distinct(), "g", "left_semi"))
    often = own.join(held.groupBy("g").agg(F.count("*").alias("n")), "g", "left")
    rarest = often.groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0").select("k", "m.g")
    return rarest.join(held, "g").where(F.col("l").contains(F.col("k"))).groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def resolve_seeds(nodes: DataFrame, asks: DataFrame) -> DataFrame:
    """``(qid, id, degrau)`` for ``(qid, texto)``: the id itself, else the only node of that label, of that bare name, of that file, or whose label contains it.

    ``id`` is null where no rung has exactly one node. Equality rungs join by key, each key with its least and greatest id only; asks left
    over are looked for inside labels, equal ones once.
    """
    norm = lambda c: casefolded(F.coalesce(c, F.lit("")))
    bare = lambda c: F.regexp_replace(norm(c), r"\(\)$", "")
    n = nodes.select("id", norm(F.col("label")).alias("l"), bare(F.col("label")).alias("nome"), norm(F.col("source_file")).alias("f"))
    text = F.regexp_replace("texto", r"(?<=.)[/\\]+$", "")
    q = checkpoint(asks.select("qid", text.alias("raw"), norm(text).alias("l"), bare(text).alias("nome")))
    by = lambda on, k: n.where(F.col(on) != "").groupBy(F.col(on).alias(k)).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))

    def only(hits: DataFrame, name: int) -> DataFrame:
        one = hits.groupBy("qid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi")
        return one.select("qid", F.lit(name).alias("degrau"), F.col("lo").alias("id"))

    def rung(name: int, key: Column, on: str) -> DataFrame:
        return only(q.select("qid", key.alias("k")).join(by(on, "k"), "k"), name)

    found = reduce(DataFrame.unionByName, [rung(1, F.col("raw"), "id"), rung(2, F.col("l"), "l"), rung(3, F.col("nome"), "nome"), rung(4, F.col("l"), "f")])
    found = checkpoint(found.groupBy("qid").agg(F.min(F.struct("degrau", "id")).alias("m")).select("qid", "m.degrau", "m.id"))
    left = checkpoint(q.join(found, "qid", "left_anti").where("l <> ''").select("qid", F.col("l").alias("k")))
    last = only(left.join(_inside(left.select("k").distinct(), by("l", "l")), "k"), 5)
    return asks.select("qid").join(found.unionByName(last), "qid", "left").select("qid", "id", "degrau")


def affected_by(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``(seed, id, nivel, relation)``: what depends on each seed ``(id)`` or on its members, with the first relation that leads there.

    Members, one step along ``method`` or ``contains``, start with the seed and are not reported. First visit wins.
    """
    e = edges.where(F.col("relation").isin(IMPACT)).select(F.col("target").alias("id"), F.col("source").alias("next"), "relation").distinct()
    s = seeds.select(F.col("id").alias("seed"), "id").distinct()
    member = s.join(edges.where(F.col("relation").isin("method", "contains")).select(F.col("source").alias("id"), F.col("target").alias("m")), "id").select("seed", F.col("m").alias("id"))
    front = checkpoint(s.union(member).distinct())
    seen, out = front, None
    for level in range(1, depth + 1):
        step = front.join(e, "id").groupBy("seed", F.col("next").alias("id")).agg(F.min("relation").alias("relation"))
        new = checkpoint(step.join(seen, ["seed", "id"], "left_anti").withColumn("nivel", F.lit(level)))
        if new.isEmpty():
            break
        out = new if out is None else out.unionByName(new)
        front = new.select("seed", "id")
        seen = checkpoint(seen.union(front))
    empty = s.select("seed", "id", F.lit("").alias("relation"), F.lit(0).alias("nivel")).limit(0)
    return (empty if out is None else out).select("seed", "id", "nivel", "relation")


def statistics(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """``(medida, chave, n)``: nodes, edges, communities, relations, types, and the ``top`` nodes by degree but for rationales."""
    row = lambda df, name, key, n: df.select(F.lit(name).alias("medida"), key.alias("chave"), n.cast("long").alias("n"))
    none, n = F.lit(None).cast("string"), F.col("n")
    code = nodes.where(F.coalesce(F.col("file_type") != "rationale", F.lit(True))).select("id").distinct()
    central = degrees(edges, HIDDEN).join(code, "id", "left_semi").orderBy(F.desc("grau"), "id").limit(top)
    return reduce(DataFrame.unionByName, [
        row(nodes.agg(F.countDistinct("id").alias("n")), "nos", none, n),
        row(edges.agg(F.count("*").alias("n")), "arestas", none, n),
        row(nodes.agg(F.countDistinct("community").alias("n")), "comunidades", none, n),
        row(edges.groupBy("relation").agg(F.count("*").alias("n")), "relacao", F.col("relation"), n),
        row(nodes.groupBy(F.coalesce("file_type", F.lit("")).alias("t")).agg(F.count("*").alias("n")), "tipo", F.col("t"), n),
        row(central, "central", F.col("id"), F.col("grau")),
    ])


def is_file_node(label: Column, file: Column, degree: Column) -> Column:
    """Nodes that stand for a file, methods without their class, and functions that nothing but a file holds."""
    l, f = F.coalesce(label, F.lit("")), F.coalesce(file, F.lit(""))
    own = (f != "") & (l != "") & ((l == f) | F.endswith(f, F.concat(F.lit("/"), l)))
    return own | (l.startswith(".") & l.endswith("()")) | (l.endswith("()") & (F.coalesce(degree, F.lit(0)) <= 1))


def is_concept(file: Column) -> Column:
    """Nodes of no file: none given, or a name without an ending."""
    f = F.coalesce(file, F.lit(""))
    return (f == "") | ~F.element_at(F.split(f, "/"), -1).contains(".")


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """``(id, label, grau)``: the most connected real nodes, no files, concepts, keys of JSON files or names of the language itself."""
    d = nodes.select("id", "label", "source_file").join(degrees(edges, ()).select("id", "grau"), "id")
    key = F.lower(F.coalesce("source_file", F.lit(""))).endswith(".json") & F.lower(F.trim(F.coalesce("label", F.lit("")))).isin(JSON_KEYS)
    kept = d.where(~is_file_node(F.col("label"), F.col("source_file"), F.col("grau")) & ~is_concept(F.col("source_file")) & ~key & ~F.coalesce("label", F.lit("")).isin(BUILTINS))
    return kept.orderBy(F.desc("grau"), "id").limit(top).select("id", F.coalesce("label", "id").alias("label"), "grau")


def without_phantoms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` without inferred calls between files of different languages, imports and references between known different languages,
    and imports of a node by itself. Edges of unknown ends stay."""
    n = nodes.groupBy("id").agg(F.min("source_file").alias("f"))
    j = edges.join(n.toDF("source", "__fa"), "source", "left").join(n.toDF("target", "__fb"), "target", "left")
    fa, fb = family(F.col("__fa")), family(F.col("__fb"))
    called = (F.col("relation") == "calls") & (F.coalesce("confidence", F.lit("")) == "INFERRED") & (suffix(F.col("__fa")) != "") & (suffix(F.col("__fb")) != "") & ~fa.eqNullSafe(fb)
    named = F.col("relation").isin("imports", "imports_from", "references") & F.coalesce(fa != fb, F.lit(False))
    self_ = (F.col("source") == F.col("target")) & F.col("relation").isin("imports", "imports_from", "re_exports")
    return j.where(~called & ~named & ~self_).select(edges.columns)


def surprises(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """``(source, target, relation, nota)``: edges between files, the least expected first.

    3, 2 or 1 by confidence, 2 more for another kind of file, 2 for another top folder, 1 for another community; half as much again,
    rounded down, for likeness of meaning; 1 more from a node of degree 2 or less to one of 5 or more. Inferred calls and uses between
    languages, or between code and text, get the last point only.
    """
    grau = degrees(edges, ()).select("id", "grau")
    n = nodes.select("id", "label", "source_file", "community").join(grau, "id", "left").where(~is_concept(F.col("source_file")) & ~is_file_node(F.col("label"), F.col("source_file"), F.col("grau")))
    side = lambda x: n.select(F.col("id").alias("source" if x == "a" else "target"), F.col("source_file").alias(f"f{x}"), F.col("community").alias(f"c{x}"), F.coalesce("grau", F.lit(0)).alias(f"g{x}"))
    j = edges.where(~F.col("relation").isin("imports", "imports_from", "contains", "method")).join(side("a"), "source").join(side("b"), "target").where("fa <> fb")
    code = [x for v in FAMILIES.values() for x in v]
    kind = lambda f: F.when(suffix(f).isin(code), "code").when(suffix(f).isin(PAPERS), "paper").when(suffix(f).isin(IMAGES), "image").otherwise("doc")
    ka, kb = kind(F.col("fa")), kind(F.col("fb"))
    doc = ((ka == "code") & (kb == "doc")) | ((ka == "doc") & (kb == "code"))
    conf = F.coalesce("confidence", F.lit("EXTRACTED"))
    flat = (conf == "INFERRED") & F.col("relation").isin("calls", "uses") & (F.coalesce(family(F.col("fa")) != family(F.col("fb")), F.lit(False)) | doc)
    top_of = lambda f: F.split(f, "/")[0]
    structure = F.when(ka != kb, 2).otherwise(0) + F.when(top_of(F.col("fa")) != top_of(F.col("fb")), 2).otherwise(0) + F.when(F.coalesce(F.col("ca") != F.col("cb"), F.lit(False)), 1).otherwise(0)
    score = F.when(flat, 0).otherwise(F.when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1) + structure)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score)
    score = score + F.when((F.least("ga", "gb") <= 2) & (F.greatest("ga", "gb") >= 5), 1).otherwise(0)
    return j.select("source", "target", "relation", score.cast("int").alias("nota")).orderBy(F.desc("nota"), "source", "target", "relation").limit(top)


def bridges_of_communities(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(ca, cb, source, target, relation, confidence)``: one edge for each pair of communities: ambiguous before inferred before extracted, then the smallest."""
    m = members.select("id", "community")
    j = edges.join(m.toDF("source", "ca"), "source").join(m.toDF("target", "cb"), "target").where("ca <> cb")
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    best = j.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.min(F.struct(rank.alias("k"), "source", "target", "relation", "confidence")).alias("m"))
    return best.select(F.col("x").alias("ca"), F.col("y").alias("cb"), "m.source", "m.target", "m.relation", "m.confidence")


def numbered_communities(members: DataFrame) -> DataFrame:
    """``(id, community)`` renumbered from 0: the largest first, of equal size the one with the smallest member.

    Communities do not overlap, so their smallest members order them as their sorted lists would; one row a community is ranked.
    """
    g = members.groupBy("community").agg(F.count("*").alias("n"), F.min(F.col("id").cast("string")).alias("m"))
    numbered = global_rank(g, [F.desc("n"), F.asc("m")], "novo")
    return members.join(numbered.select("community", "novo"), "community").select("id", (F.col("novo") - 1).alias("community"))


def reattached(edges: DataFrame, members: DataFrame, hubs: DataFrame) -> DataFrame:
    """``(id, community)`` of hubs that took no part: the community most of their neighbors are in, the smallest at ties, null without any."""
    both = edges.select("source", "target").union(edges.select("target", "source")).where("source <> target").distinct()
    votes = hubs.select(F.col("id").alias("source")).join(both, "source").join(members.select(F.col("id").alias("target"), "community"), "target").groupBy("source", "community").agg(F.count("*").alias("n"))
    best = votes.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m")).select(F.col("source").alias("id"), "m.community")
    return hubs.select("id").join(best, "id", "left")


def remap_to_previous(members: DataFrame, before: DataFrame) -> DataFrame:
    """``(community, final)``: numbers of new communities after the old ones they overlap most, one to one and greedily; others get the smallest free numbers.

    Overlaps are counted by Spark; the greedy choice runs in rounds, each taking every pair that is best for both its sides, which is what the
    greedy order takes. Unmatched communities come by size, then smallest member.
    """
    o = checkpoint(members.select("id", "community").join(before.select("id", F.col("community").alias("old")), "id").groupBy("community", "old").agg((-F.count("*")).alias("n")))
    taken = o.select("community", "old").limit(0)
    while not o.isEmpty():
        key = F.struct("n", "old", "community")
        mine = o.groupBy("community").agg(F.min(key).alias("m")).select("m")
        theirs = o.groupBy("old").agg(F.min(key).alias("m")).select("m")
        both = checkpoint(mine.join(theirs, "m", "left_semi").select("m.community", "m.old"))
        taken = checkpoint(taken.unionByName(both))
        o = checkpoint(o.join(both.select("community"), "community", "left_anti").join(both.select("old"), "old", "left_anti"))
    rest = members.groupBy("community").agg(F.count("*").alias("n"), F.min(F.col("id").cast("string")).alias("m")).join(taken.select("community"), "community", "left_anti")
    rest = global_rank(rest, [F.desc("n"), F.asc("m")], "k")
    # the k-th free number: every number up to that of all communities that no old one holds
    free = members.sparkSession.range(members.select("community").distinct().count() + 1).toDF("final").join(taken.select(F.col("old").cast("long").alias("final")), "final", "left_anti")
    given = rest.join(global_rank(free, [F.asc("final")], "k"), "k")
    return taken.select("community", F.col("old").cast("long").alias("final")).unionByName(given.select("community", "final"))


def community_labels(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(community, rotulo)``: the label of the member of highest degree whose label is a name, the smallest id at ties; else the most frequent file stem."""
    n = members.select("id", "community").join(nodes.select("id", "label", "source_file"), "id").join(degrees(edges, HIDDEN).select("id", "grau"), "id", "left")
    named = n.where(F.col("label").rlike(r"^[A-Za-z_][\w.]*(\(\))?$")).groupBy("community").agg(F.min(F.struct((-F.coalesce("grau", F.lit(0))).alias("g"), "id", "label")).alias("m")).select("community", F.col("m.label").alias("a"))
    stem = F.regexp_extract(F.coalesce("source_file", F.lit("")), r"([^/]+?)(?:\.[^./]*)?$", 1)
    files = n.select("community", stem.alias("s")).where("s <> ''").groupBy("community", "s").agg(F.count("*").alias("n"))
    common = files.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "s")).alias("m")).select("community", F.col("m.s").alias("b"))
    return members.select("community").distinct().join(named, "community", "left").join(common, "community", "left").select("community", F.coalesce("a", "b").alias("rotulo"))


#: Nodes and edges that betweenness takes: it needs every shortest path.
BETWEEN_NODES = 20_000


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(id, valor)``: share of shortest undirected paths through each node, normalised over all pairs; exact, or over ``sources`` scaled up.

    Breadth-first waves from all sources at once count paths, then shares flow back wave by wave. Every source meets every node it reaches,
    so graphs of over ``BETWEEN_NODES`` nodes need a stated set of sources.
    """
    e = edges.select("source", "target").where("source <> target")
    e = checkpoint(e.union(e.select("target", "source")).distinct().toDF("id", "next"))
    ids = checkpoint(e.select("id").distinct())
    n = ids.count()
    if sources is None and n > BETWEEN_NODES:
        raise ValueError(f"over {BETWEEN_NODES} nodes: give sources")
    start = ids if sources is None else sources.select("id").distinct().join(ids, "id", "left_semi")
    front = checkpoint(start.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths"), F.lit(0).alias("level")))
    k, waves = front.count(), [front]
    seen = front.select("s", "id")
    while True:
        step = waves[-1].join(e, "id").groupBy("s", F.col("next").alias("id")).agg(F.sum("paths").alias("paths"))
        nxt = checkpoint(step.join(seen, ["s", "id"], "left_anti").withColumn("level", F.lit(len(waves))))
        if nxt.isEmpty():
            break
        waves.append(nxt)
        seen = checkpoint(seen.union(nxt.select("s", "id")))
    flow, out = None, None
    for level in range(len(waves) - 1, 0, -1):
        w = waves[level].select("s", F.col("id").alias("next"), F.col("paths").alias("below"))
        own = w.withColumn("d", F.lit(0.0)) if flow is None else w.join(flow.select("s", F.col("id").alias("next"), "d"), ["s", "next"], "left").fillna(0.0, ["d"])
        up = own.join(e, "next").join(waves[level - 1].select("s", "id", "paths"), ["s", "id"]).groupBy("s", "id").agg(F.sum(F.col("paths") / F.col("below") * (1 + F.col("d"))).alias("d"))
        flow = checkpoint(up)
        part = flow.where("s <> id").groupBy("id").agg(F.sum("d").alias("d"))
        out = part if out is None else out.unionByName(part)
    pairs = (n - 1) * (n - 2) * (k / n if n else 1)
    total = ids.withColumn("d", F.lit(0.0)) if out is None else ids.join(out.groupBy("id").agg(F.sum("d").alias("d")), "id", "left").fillna(0.0, ["d"])
    return total.select("id", F.round(F.col("d") / pairs if pairs > 0 else F.lit(0.0), 6).alias("valor"))


def questions(nodes: DataFrame, edges: DataFrame, members: DataFrame, between: DataFrame, cohesion: DataFrame) -> DataFrame:
    """``(tipo, alvo, n)``: what a graph suggests to ask: ambiguous edges, three bridges to other communities, much connected nodes with two or
    more inferred edges, weakly connected nodes, large communities of low cohesion."""
    deg = degrees(edges, ()).select("id", "grau")
    n = nodes.select("id", "label", "source_file", "file_type").join(deg, "id", "left").fillna(0, ["grau"])
    real = ~is_file_node(F.col("label"), F.col("source_file"), F.col("grau")) & ~is_concept(F.col("source_file"))
    amb = edges.where("confidence = 'AMBIGUOUS'").select(F.lit("ambigua").alias("tipo"), F.concat_ws(">", "source", "target").alias("alvo"), F.lit(1).cast("long").alias("n"))
    both = edges.select("source", "target").union(edges.select("target", "source"))
    m = members.select("id", "community")
    over = both.join(m.toDF("source", "ca"), "source").join(m.toDF("target", "cb"), "target").where("ca <> cb").groupBy(F.col("source").alias("id")).agg(F.countDistinct("cb").alias("n"))
    top3 = between.where("valor > 0").join(n.where(real).select("id"), "id", "left_semi").orderBy(F.desc("valor"), "id").limit(3)
    bridge = top3.join(over, "id").select(F.lit("ponte").alias("tipo"), F.col("id").alias("alvo"), "n")
    busy = n.where(~is_file_node(F.col("label"), F.col("source_file"), F.col("grau"))).orderBy(F.desc("grau"), "id").limit(5).select("id")
    inferred = edges.where("confidence = 'INFERRED'")
    ends = inferred.select(F.col("source").alias("id")).union(inferred.select("target"))
    verify = ends.join(busy, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")).where("n >= 2").select(F.lit("verificar").alias("tipo"), F.col("id").alias("alvo"), "n")
    alone = n.where(real & (F.col("grau") <= 1) & F.coalesce(F.col("file_type") != "rationale", F.lit(True))).select(F.lit("isolado").alias("tipo"), F.col("id").alias("alvo"), F.col("grau").cast("long").alias("n"))
    loose = cohesion.where("coesao < 0.15 AND n >= 5").select(F.lit("dispersa").alias("tipo"), F.col("community").cast("string").alias("alvo"), F.col("n").cast("long").alias("n"))
    return reduce(DataFrame.unionByName, [amb, bridge, verify, alone, loose])


def import_cycles(nodes: DataFrame, edges: DataFrame, longest: int = 5, top: int = 20) -> DataFrame:
    """``(ciclo, tamanho)``: circular imports between files, the shortest first."""
    from garimpo.operators.graph import cycles

    f = nodes.where("source_file IS NOT NULL AND source_file <> ''").groupBy("id").agg(F.min("source_file").alias("f"))
    e = edges.where(F.col("relation").isin("imports", "imports_from", "re_exports")).join(f.toDF("source", "a"), "source").join(f.toDF("target", "b"), "target").where("a <> b")
    found = cycles(e.select(F.col("a").alias("source"), F.col("b").alias("target")), longest)
    return found.orderBy("tamanho", "ciclo").limit(top)


def blocking_cycles(waits: DataFrame, longest: int = 8) -> DataFrame:
    """``(membros, tamanho)``: sets of processes ``(id, bloqueado_por)`` that wait for each other, each set once."""
    from garimpo.operators.graph import cycles

    c = cycles(waits.select(F.col("id").alias("source"), F.col("bloqueado_por").alias("target")), longest)
    return c.select(F.array_sort("ciclo").alias("membros"), "tamanho").distinct()


def blockers(processes: DataFrame) -> DataFrame:
    """``(id, bloqueado_por, classe)`` of ``(id, estado, bloqueios)``: each blocker as ausente, cancelado, concluido or aberto."""
    b = processes.select("id", F.explode("bloqueios").alias("bloqueado_por"))
    s = processes.select(F.col("id").alias("bloqueado_por"), F.lower("estado").alias("e"))
    kind = F.when(F.col("e").isNull(), "ausente").when(F.col("e") == "cancelado", "cancelado").when(F.col("e") == "concluido", "concluido").otherwise("aberto")
    return b.join(s, "bloqueado_por", "left").select("id", "bloqueado_por", kind.alias("classe"))


def run_states(steps: DataFrame, deps: DataFrame, failed: DataFrame) -> DataFrame:
    """``(id, nivel, estado)``: steps by the longest way to them; those behind a failed step, at any distance, are pulado."""
    from garimpo.operators.graph import levels, reach

    lv = levels(deps, steps)
    down = reach(deps.withColumn("relation", F.lit("d")), failed, 1_000_000).where("nivel > 0").select("id").distinct().withColumn("pulado", F.lit(True))
    bad = failed.select("id").distinct().withColumn("falhou", F.lit(True))
    j = lv.join(down, "id", "left").join(bad, "id", "left")
    return j.select("id", "nivel", F.when(F.col("pulado"), "pulado").when(F.col("falhou"), "falhou").otherwise("feito").alias("estado"))


# citations of code in texts

#: What a citation in backticks is, endings of files, humps of a name.
CITED = r"`([A-Za-z_][\w.]*(?:\(\))?)`"
CODE_FILE = r"\.(py|pyi|ts|tsx|js|jsx|mjs|rs|go|java|kt|cs|c|h|cpp|hpp|rb|php|swift|sh|toml|json|yaml|yml|md)$"
HUMP = "[a-z][A-Z]"


def citation_key(c: Column) -> Column:
    """What a citation names: a function or the last part of a dotted name without its call, or a file's own name; lower case."""
    call = F.endswith(c, F.lit("()"))
    bare = F.when(call, F.substring(c, F.lit(1), F.length(c) - 2)).otherwise(c)
    return F.lower(F.when(~call & c.rlike(CODE_FILE), c).otherwise(F.element_at(F.split(bare, r"\."), -1)))


def citations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, citado, chave)``: distinct citations in backticks that can only be names of code, keys of three characters at least."""
    c = texts.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(CITED), 1))).alias("citado"))
    col = F.col("citado")
    distinct = col.endswith("()") | F.btrim(col, F.lit("_")).contains("_") | col.rlike(HUMP) | col.rlike(CODE_FILE)
    return c.where(distinct).withColumn("chave", citation_key(col)).where(F.length("chave") >= 3)


def cited_nodes(texts: DataFrame, key: str, text: str, index: DataFrame, most: int = 6) -> DataFrame:
    """``(key, grafo, citado, id)``: nodes that texts cite, in the one graph most of a text's citations lead to.

    ``index``: (grafo, id, chave). Citations with over ``most`` nodes say nothing. Among graphs of most votes the one named in the text wins, the
    longest name first; else the shortest name, then the first.
    """
    c = citations(texts, key, text)
    few = index.join(index.groupBy("chave").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("chave"), "chave", "left_semi")
    hit = checkpoint(c.join(few, "chave"))
    votes = hit.groupBy(key, "grafo").agg(F.countDistinct("citado").alias("v"))
    named = texts.select(key, F.lower(F.col(text)).alias("__t"))
    v = votes.join(named, key).withColumn("dito", F.col("__t").contains(F.lower("grafo"))).drop("__t")
    order = F.struct((-F.col("v")).alias("v"), (~F.col("dito")).alias("d"), F.when(F.col("dito"), -F.length("grafo")).otherwise(F.length("grafo")).alias("l"), F.col("grafo").alias("g"))
    win = v.groupBy(key).agg(F.min(order).alias("m")).select(key, F.col("m.g").alias("grafo"))
    return hit.join(win, [key, "grafo"]).select(key, "grafo", "citado", "id")


def touched_nodes(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(id, ini, fim)``: code nodes whose lines meet a changed range ``(source_file, ini, fim)``; a node ends where the next of its file begins.

    An interval join within a file. Spans of a file do not overlap, so ranges are matched by blocks of ``SPAN`` lines that both touch.
    """
    line = F.nullif(F.regexp_extract(F.coalesce("source_location", F.lit("")), r"^L(\d+)", 1), F.lit("")).cast("long")
    n = nodes.where("file_type = 'code'").select("id", "source_file", line.alias("a")).where("a IS NOT NULL AND source_file <> ''")
    n = n.join(ranges.select("source_file").distinct(), "source_file", "left_semi")
    n = n.withColumn("z", F.coalesce(F.lead("a").over(Window.partitionBy("source_file").orderBy("a", "id")) - 1, F.lit(10**9)))
    last = ranges.groupBy("source_file").agg(F.max("fim").alias("last"))
    n = n.join(last, "source_file").withColumn("z", F.least("z", F.greatest("last", "a"))).where("a <= z")
    blocks = lambda x, y: F.explode(F.sequence(F.floor(x / SPAN), F.floor(y / SPAN))).alias("b")
    r = ranges.select("source_file", "ini", "fim", blocks(F.col("ini"), F.col("fim")))
    j = n.select("id", "source_file", "a", "z", blocks(F.col("a"), F.col("z"))).join(r, ["source_file", "b"]).where((F.col("ini") <= F.col("z")) & (F.col("fim") >= F.col("a")))
    return j.select("id", "ini", "fim").distinct()


SPAN = 1000


def code_excerpt(nodes: DataFrame, files: DataFrame, lines: int = 30) -> DataFrame:
    """``(id, inicio, fim, trecho)``: the lines of a node's file ``(source_file, texto)`` from its place on; the first line if it has none."""
    start = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("source_location", F.lit("")), r"^L(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    j = nodes.select("id", "source_file", start.alias("inicio")).join(files, "source_file").withColumn("l", F.split("texto", "\n"))
    return j.select("id", "inicio", F.least(F.size("l"), F.col("inicio") - 1 + lines).alias("fim"), F.array_join(F.slice("l", F.col("inicio"), F.lit(lines)), "\n").alias("trecho"))


# several repositories, hyperedges, names

def make_id(*parts: Column) -> Column:
    """An id from names: compatibility form without case, other characters as one ``_``, none at the ends."""
    return F.btrim(F.regexp_replace(casefolded(F.concat_ws("_", *parts)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def tagged(df: DataFrame, tag: str, columns: list[str]) -> DataFrame:
    """Ids of a repository's graph as ``tag::id``."""
    return df.withColumns({c: F.concat(F.lit(f"{tag}::"), F.col(c)) for c in columns})


def without_tag(df: DataFrame, tag: str, columns: list[str]) -> DataFrame:
    """Rows none of whose ids belong to the repository."""
    return df.where(~reduce(lambda a, b: a | b, [F.coalesce(F.col(c).startswith(f"{tag}::"), F.lit(False)) for c in columns]))


def prune_hyperedges(hyper: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(hid, membros)``: members by the id they name, as it stands or in its normal form; unknown ones go, and edges without members."""
    m = hyper.select("hid", F.posexplode("membros").alias("p", "m"))
    plain = nodes.select("id").distinct()
    by_norm = plain.groupBy(make_id(F.col("id")).alias("k")).agg(F.min("id").alias("nid"), F.count("*").alias("n")).where("n = 1").select("k", "nid")
    j = m.withColumn("k", make_id(F.col("m"))).join(plain.select(F.col("id").alias("m"), F.lit(True).alias("known")), "m", "left").join(by_norm, "k", "left")
    r = j.select("hid", "p", F.when(F.col("known"), F.col("m")).otherwise(F.col("nid")).alias("m")).where("m IS NOT NULL").groupBy("hid", "m").agg(F.min("p").alias("p"))
    return r.groupBy("hid").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("membros"))


def resolve_names(declared: DataFrame, imports: DataFrame, uses: DataFrame) -> DataFrame:
    """``(arquivo, nome, id)``: names used in a file that one declaration answers, by the file's own, by import (alias or star), else where the name is declared once only.

    ``declared``: (arquivo, nome, id); ``imports``: (arquivo, de, nome, como), nome ``*`` for all; ``uses``: (arquivo, nome).
    """
    u = uses.select("arquivo", "nome").distinct()
    own = u.join(declared, ["arquivo", "nome"]).select("arquivo", "nome", "id", F.lit(0).alias("k"))
    d = declared.select(F.col("arquivo").alias("de"), F.col("nome").alias("orig"), "id")
    named = imports.where("nome <> '*'").select("arquivo", "de", F.col("nome").alias("orig"), F.coalesce("como", "nome").alias("nome"))
    by_name = u.join(named, ["arquivo", "nome"]).join(d, ["de", "orig"]).select("arquivo", "nome", "id", F.lit(1).alias("k"))
    star = u.join(imports.where("nome = '*'").select("arquivo", "de"), "arquivo").join(d.withColumnRenamed("orig", "nome"), ["de", "nome"]).select("arquivo", "nome", "id", F.lit(2).alias("k"))
    once = declared.groupBy("nome").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = u.join(once, "nome").select("arquivo", "nome", "id", F.lit(3).alias("k"))
    every = reduce(DataFrame.unionByName, [own, by_name, star, alone])
    rung = every.groupBy("arquivo", "nome", "k").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    best = rung.groupBy("arquivo", "nome").agg(F.min(F.struct("k", "n", "id")).alias("m"))
    return best.where("m.n = 1").select("arquivo", "nome", "m.id")


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several extractions as one graph: one node per id, ends by id or by the normal form of one, edges with valid weights
    once each, none that dangle, none between languages, in one direction."""
    from garimpo.operators.dedup import one_per_id
    from garimpo.operators.graph import prune_dangling, repair_edges

    n = checkpoint(one_per_id(nodes))
    ids = n.select("id")
    by_norm = ids.groupBy(make_id(F.col("id")).alias("k")).agg(F.min("id").alias("nid"), F.count("*").alias("n")).where("n = 1").select("k", "nid")
    e = edges
    for end in ("source", "target"):
        e = e.withColumn("__k", make_id(F.col(end))).join(ids.select(F.col("id").alias(end), F.lit(True).alias("__known")), end, "left").join(by_norm.withColumnRenamed("k", "__k"), "__k", "left")
        e = e.withColumn(end, F.when(F.col("__known"), F.col(end)).otherwise(F.coalesce("nid", end))).drop("__k", "__known", "nid")
    e = without_phantoms(n, prune_dangling(repair_edges(e), n))
    order = F.struct("source", "target", *[F.col(c) for c in e.columns if c not in ("source", "target", "relation")])
    one = e.groupBy(F.least("source", "target").alias("__a"), F.greatest("source", "target").alias("__b"), "relation").agg(F.min(order).alias("m"))
    return n, one.select("m.*", "relation").select(edges.columns)


def replaced_sources(old: DataFrame, new: DataFrame, deleted: DataFrame, column: str = "source_file") -> DataFrame:
    """``old`` with what its files gave replaced by ``new``; rows of ``deleted`` files go."""
    gone = new.select(column).union(deleted.select(column)).distinct()
    return old.join(gone, column, "left_anti").select(old.columns).unionByName(new.select(old.columns))
