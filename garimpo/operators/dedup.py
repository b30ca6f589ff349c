"""Merging of graph nodes that name one thing: guards, survivors of merges and of equal ids, repeated items, leaders of similar marks.

Nodes: (id, label, source_file, file_type, community). All rules look at these columns only, so nodes that agree in normal label, file, type
and community form one class; classes are compared, nodes are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.operators.components import components
from garimpo.operators.entities import entropy, normal_label
from garimpo.operators.resolution import label_pairs, scored_pairs
from garimpo.runtime import checkpoint

#: Least score of a merge, bonus for one community, length from which labels are long, bits per character, types tied to a file.
MERGE, BONUS, LONG, BITS = 92.0, 5.0, 12, 2.5
ANCHORED = ["rationale", "document"]
#: A trailing variant of a label, a trailing chunk number of an id.
VARIANT = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
CHUNK = r"_c\d+$"


def variant_pair(a: Column, b: Column) -> Column:
    """Short labels of one stem with different version or variant endings."""
    stem, end = (lambda c: F.regexp_extract(c, VARIANT, 1)), (lambda c: F.regexp_extract(c, VARIANT, 2))
    return (F.greatest(F.length(a), F.length(b)) < LONG) & (stem(a) != "") & (stem(a) == stem(b)) & (end(a) != end(b))


def one_slip(a: Column, b: Column) -> Column:
    """Labels of one length that differ by one letter or by two neighbors in the other order."""
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    swapped = F.when(F.length(a) > 1, F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: swap(i) == b)).otherwise(F.lit(False))
    return (F.length(a) == F.length(b)) & ((F.levenshtein(a, b) <= 1) | swapped)


def short_blocked(a: Column, b: Column, score: Column) -> Column:
    """Short labels merge only by one slip, and at 97 or more."""
    return (F.greatest(F.length(a), F.length(b)) < LONG) & ~((score >= 97.0) & one_slip(a, b))


def extends(a: Column, b: Column) -> Column:
    """One label is the other with something added."""
    return (a != b) & (F.startswith(a, b) | F.startswith(b, a))


def numbers_differ(a: Column, b: Column) -> Column:
    """The runs of digits are not the same ones, zeros in front apart."""
    runs = lambda c: F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), lambda t: F.regexp_replace(t, "^0+(?=.)", "")))
    return runs(a) != runs(b)


def merge_map(nodes: DataFrame, exact: bool = True) -> DataFrame:
    """``(id, sobrevivente)`` of nodes that are merged; of a group the id without chunk number stays, then the shortest, then the smallest.

    Code is known by its id and takes no part. Equal labels merge within one file only, and never without a file. Similar labels
    merge by Jaro-Winkler, long ones of different files by Jaro, with a bonus for one community, unless a guard speaks against it:
    variants, short labels, extensions, other numbers, types tied to a file. The result does not depend on the order of the nodes.
    ``exact`` as in ``label_pairs``.
    """
    label = F.coalesce(F.nullif("label", F.lit("")), "id")
    n = nodes.where(F.col("id").isNotNull() & F.coalesce(F.col("file_type") != "code", F.lit(True)))
    n = n.select("id", normal_label(label).alias("l"), F.coalesce("source_file", F.lit("")).alias("f"), F.coalesce("file_type", F.lit("")).alias("t"), F.col("community").cast("string").alias("c")).where("l <> ''")
    n = checkpoint(n.withColumn("k", F.concat(F.hex(F.xxhash64("l", "f", "t", "c", F.col("c").isNull())), F.hex(F.xxhash64(F.lit(5), "l", "f", "t", "c", F.col("c").isNull())))))
    says = entropy(F.col("l")) >= BITS
    k = checkpoint(n.groupBy("k").agg(F.any_value("l").alias("l"), F.any_value("f").alias("f"), F.any_value("t").alias("t"), F.any_value("c").alias("c")).withColumn("says", says))
    pairs = label_pairs(k.where("says"), "l", (MERGE - BONUS) / 100, BITS, exact)
    scored = scored_pairs(pairs, (MERGE - BONUS) / 100, either=True).select("a", "b", (F.col("jw") * 100).alias("jw"), (F.col("j") * 100).alias("j"))
    a, b = F.col("a"), F.col("b")
    kept = scored.where(~variant_pair(a, b) & ~extends(a, b) & ~numbers_differ(a, b))
    side = lambda x: k.where("says").select(F.col("l").alias(x), *[F.col(c).alias(f"{c}{x}") for c in "kftc"])
    j = kept.join(side("a"), "a").join(side("b"), "b")
    apart, longest, shortest = F.col("fa") != F.col("fb"), F.greatest(F.length("a"), F.length("b")), F.least(F.length("a"), F.length("b"))
    score = F.when(apart & (longest >= LONG), F.col("j")).otherwise(F.col("jw"))
    bonus = F.when((F.col("ca") == F.col("cb")) & (shortest >= LONG), BONUS).otherwise(0.0)
    tied = apart & (F.col("ta").isin(ANCHORED) | F.col("tb").isin(ANCHORED))
    links = j.where(~short_blocked(a, b, score) & ~tied & (score + bonus >= MERGE)).select(F.col("ka").alias("src"), F.col("kb").alias("dst"))
    # equal labels of one file, whatever their type and community
    first = k.where("f <> ''").groupBy("l", "f").agg(F.min("k").alias("dst"), F.count("*").alias("n")).where("n > 1")
    same = k.join(first, ["l", "f"]).select(F.col("k").alias("src"), "dst").where("src <> dst")
    group = components(links.unionByName(same))
    # equal labels without a file prove nothing: of such a class only its first node takes part
    rank = F.struct(F.col("id").rlike(CHUNK).alias("s"), F.length("id").alias("n"), F.col("id").alias("id"))
    first_of = n.where("f = ''").groupBy("k").agg(F.min(rank).alias("m")).select("k", F.col("m.id").alias("id"))
    own = n.where("f <> ''").select("id", "k").unionByName(first_of.select("id", "k"))
    merged = own.join(group.toDF("k", "g"), "k", "left").select("id", F.coalesce("g", "k").alias("g"))
    best = merged.groupBy("g").agg(F.min(rank).alias("m"), F.countDistinct("id").alias("n")).where("n > 1")
    return merged.join(best, "g").select("id", F.col("m.id").alias("sobrevivente")).distinct()


def defines_id(id_: Column, file: Column) -> Column:
    """Whether the id begins with the slug of the file's path without ending, or of any end of that path."""
    parts = F.split(F.regexp_replace(F.replace(F.coalesce(file, F.lit("")), F.lit("\\"), F.lit("/")), r"\.[^./]+$", ""), "/")
    segs = F.filter(F.transform(parts, lambda p: F.btrim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", "_"), F.lit("_"))), lambda p: p != "")
    ends = lambda i: F.array_join(F.slice(segs, i, F.size(segs)), "_")
    hit = F.exists(F.sequence(F.lit(1), F.size(segs)), lambda i: (id_ == ends(i)) | F.startswith(id_, F.concat(ends(i), F.lit("_"))))
    return F.when(F.size(segs) > 0, hit).otherwise(F.lit(False))


def one_per_id(nodes: DataFrame, private: tuple[str, ...] = ("_origin",)) -> DataFrame:
    """One node per id: that of the file its id is made of, then of the shortest label, then by label and file.

    Its null attributes are filled from nodes of the same id and the same file, best first, but for ``private`` ones; a node without
    a file is not filled. Grouped by (id, file) before by id, so an id that a third of all rows bear is spread.
    """
    attrs = [c for c in nodes.columns if c not in ("id", "source_file")]
    label, file = F.coalesce("label", F.lit("")), F.coalesce("source_file", F.lit(""))
    rank = F.struct((~defines_id(F.col("id"), F.col("source_file"))).alias("r"), F.length(label).alias("n"), label.alias("l"), file.alias("f"), F.xxhash64(*attrs).alias("h"))
    d = nodes.where(F.col("id").isNotNull()).withColumn("__r", rank).withColumn("__f", file)
    own = [F.min_by(F.struct(F.col(c)), "__r").getField(c).alias(c) if c in private else F.coalesce(F.min_by(F.struct(F.col(c)), "__r").getField(c), F.min_by(c, F.when((F.col("__f") != "") & F.col(c).isNotNull(), F.col("__r")))).alias(c) for c in attrs]
    per = d.groupBy("id", "__f").agg(F.min("__r").alias("__r"), F.min_by(F.struct("source_file"), "__r").getField("source_file").alias("source_file"), *own)
    best = per.groupBy("id").agg(F.min_by(F.struct("source_file", *attrs), "__r").alias("n"))
    return best.select("id", "n.*").select(nodes.columns)


def by_label(nodes: DataFrame) -> DataFrame:
    """``(id, sobrevivente)`` by normal label alone: the id without chunk number stays, then the shortest, then the smallest."""
    n = nodes.select("id", normal_label(F.col("label")).alias("l")).where("l <> '' AND id IS NOT NULL")
    rank = F.struct(F.col("id").rlike(CHUNK), F.length("id"), F.col("id").alias("id"))
    best = n.groupBy("l").agg(F.min(rank).alias("m"))
    return n.join(best, "l").select("id", F.col("m.id").alias("sobrevivente")).distinct()


def first_items(df: DataFrame, by: list[str], at: str, item: Column) -> DataFrame:
    """``df`` without repeated items of a group: equal items by the first 16 digits of their MD5; the smallest ``at`` stays."""
    h = F.substring(F.md5(item), 1, 16)
    first = df.groupBy(*by, h.alias("__h")).agg(F.min(at).alias(at))
    return df.withColumn("__h", h).join(first, [*by, "__h", at], "left_semi").drop("__h")


def mark_leaders(df: DataFrame, by: list[str], at: str, mark: str, bits: int = 3) -> DataFrame:
    """``df`` with ``lider``: whether no leader before the row has a mark within ``bits`` bits; the first row of a group is one.

    Greedy in the order of ``at``, so rows of a group stream through one task; only the leaders' marks are held, compared at once.
    """
    src = df.repartition(*by).sortWithinPartitions(*by, at)
    keys, place = [df.columns.index(c) for c in by], df.columns.index(mark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", lider boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, n = object(), np.empty(16, np.uint64), 0
        for b in batches:
            out = []
            for *key, m in zip(*[b.column(k).to_pylist() for k in keys], b.column(place).to_pylist()):
                if key != last:
                    last, n = key, 0
                if m is None:
                    out.append(None)
                    continue
                x = np.uint64(m & 0xFFFFFFFFFFFFFFFF)
                new = n == 0 or int(np.bitwise_count(held[:n] ^ x).min()) > bits
                if new:
                    if n == len(held):
                        held = np.concatenate([held, np.empty_like(held)])
                    held[n] = x
                    n += 1
                out.append(new)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "lider"])

    return src.mapInArrow(run, schema)
