"""Conversations: what reads of files are still worth, what later turns repeat, and the shorter conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import compact as K
from garimpo.runtime import checkpoint

#: Lines of a read without a limit; lines and characters a repeated span has at least.
WHOLE, LEAST_LINES, LEAST_CHARS = 2000, 3, 40


def read_states(ops: DataFrame, frozen: int = 0) -> DataFrame:
    """``(conv, idx, estado)`` of reads: ``stale`` if the file is edited later, ``superseded`` if a later read covers the range, else ``fresh``.

    ``ops``: (conv, idx, op, arquivo, inicio, limite) with op ``read`` or ``edit``; a read without start and limit is of the whole file. Reads before
    ``frozen`` stay fresh. Operations on a file stream backwards; only the ranges that no later one covers are held.
    """
    src = ops.where("arquivo IS NOT NULL AND op IN ('read', 'edit')").select("conv", "arquivo", "idx", "op", "inicio", "limite").repartition("conv", "arquivo").sortWithinPartitions("conv", "arquivo", F.desc("idx"))
    kind = src.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, edited, ranges = None, False, []
        for b in batches:
            convs, places, states = [], [], []
            for c, f, i, op, a, n in zip(*[x.to_pylist() for x in b.columns]):
                if (c, f) != last:
                    last, edited, ranges = (c, f), False, []
                if op == "edit":
                    edited = True
                    continue
                lo, hi = (0, float("inf")) if a is None and n is None else (a or 0, (a or 0) + (n or WHOLE))
                covered = any(x <= lo and hi <= y for x, y in ranges)
                if not covered:
                    ranges = [(x, y) for x, y in ranges if not (lo <= x and y <= hi)] + [(lo, hi)]
                convs.append(c), places.append(i)
                states.append("fresh" if i < frozen else "stale" if edited else "superseded" if covered else "fresh")
            yield pa.RecordBatch.from_arrays([pa.array(convs, b.schema.types[0]), pa.array(places, pa.int64()), pa.array(states, pa.string())], ["conv", "idx", "estado"])

    return src.withColumn("idx", F.col("idx").cast("long")).mapInArrow(run, f"conv {kind}, idx bigint, estado string")


def repeated_spans(turns: DataFrame, protected: tuple[str, ...] = ("user",)) -> DataFrame:
    """``(conv, turno, ini, fim, de_turno, de_linha)``: spans of lines of a turn that stood, in this order, in an earlier one.

    ``turns``: (conv, turno, papel, texto). Line numbers in front of lines do not count. Three lines and 40 characters at least; turns of protected roles are
    not shortened but may be referred to. Every three lines are looked up by their hash at their first place in the conversation, and
    places that go on together are one span; no pair of turns is compared.
    """
    lines = turns.where("texto IS NOT NULL").select("conv", "turno", "papel", F.posexplode(F.split("texto", "\n")).alias("linha", "l"))
    bare = lines.withColumn("b", F.regexp_replace("l", r"^\s*\d+[\t:|→]\s?", ""))
    w = Window.partitionBy("conv", "turno").orderBy("linha")
    three = bare.withColumn("x", F.lead("b", 1).over(w)).withColumn("y", F.lead("b", 2).over(w)).where("y IS NOT NULL")
    h = checkpoint(three.select("conv", "turno", "papel", "linha", F.xxhash64("b", "x", "y").alias("h0"), F.xxhash64(F.lit(7), "y", "b", "x").alias("h1")))
    first = h.groupBy("conv", "h0", "h1").agg(F.min(F.struct("turno", "linha")).alias("f"))
    hit = h.where(~F.col("papel").isin(*protected)).join(first, ["conv", "h0", "h1"]).where(F.col("f.turno") < F.col("turno"))
    hit = hit.select("conv", "turno", "linha", F.col("f.turno").alias("de_turno"), F.col("f.linha").alias("de"))
    o = Window.partitionBy("conv", "turno").orderBy("linha")
    new = F.coalesce((F.col("linha") != F.lag("linha").over(o) + 1) | (F.col("de_turno") != F.lag("de_turno").over(o)) | (F.col("de") != F.lag("de").over(o) + 1), F.lit(True))
    runs = hit.withColumn("r", F.sum(new.cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("conv", "turno", "r").agg(F.min("linha").alias("ini"), (F.max("linha") + LEAST_LINES - 1).alias("fim"), F.min("de_turno").alias("de_turno"), F.min("de").alias("de_linha"))
    # spans that meet: a later one begins behind the one before
    spans = spans.withColumn("ini2", F.greatest("ini", F.coalesce(F.lag("fim").over(Window.partitionBy("conv", "turno").orderBy("ini")) + 1, F.col("ini"))))
    spans = spans.withColumn("de_linha", F.col("de_linha") + F.col("ini2") - F.col("ini")).withColumn("ini", F.col("ini2")).where(F.col("fim") - F.col("ini") + 1 >= LEAST_LINES)
    size = bare.select("conv", "turno", "linha", F.length("b").alias("n"))
    j = spans.join(size, ["conv", "turno"]).where(F.col("linha").between(F.col("ini"), F.col("fim")))
    return j.groupBy("conv", "turno", "ini", "fim", "de_turno", "de_linha").agg((F.sum("n") + F.count("*")).alias("c")).where(F.col("c") >= LEAST_CHARS).drop("c")


def without_repeats(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """``turns`` with each repeated span as one line that says where it stood."""
    lines = turns.select("conv", "turno", F.posexplode(F.split("texto", "\n")).alias("linha", "l"))
    j = lines.join(spans, ["conv", "turno"], "left")
    inside = F.col("linha").between(F.col("ini"), F.col("fim"))
    mark = F.concat(F.lit("[... "), (F.col("fim") - F.col("ini") + 1).cast("string"), F.lit(" lines as in turn "), F.col("de_turno").cast("string"), F.lit(", line "), (F.col("de_linha") + 1).cast("string"), F.lit("]"))
    one = j.groupBy("conv", "turno", "linha", "l").agg(F.max(F.when(inside, F.struct("ini", mark.alias("m")))).alias("s"))
    kept = one.where(F.col("s").isNull() | (F.col("linha") == F.col("s.ini"))).select("conv", "turno", "linha", F.coalesce("s.m", "l").alias("l"))
    text = kept.groupBy("conv", "turno").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linha", "l"))), lambda x: x["l"]), "\n").alias("texto"))
    return turns.drop("texto").join(text, ["conv", "turno"], "left")


def shorter(turns: DataFrame, ops: DataFrame, frozen: int = 0) -> DataFrame:
    """``(conv, turno, papel, texto, antes, depois)``: a conversation with spent reads as marks, results in short form, and repeats referred to.

    ``turns``: (conv, turno, papel, texto); the turn of a read is its ``idx``. Turns of the user stay as they are; equal texts are shortened once.
    """
    state = read_states(ops, frozen).select("conv", F.col("idx").alias("turno"), "estado").groupBy("conv", "turno").agg(F.max("estado").alias("estado"))
    j = turns.join(state, ["conv", "turno"], "left")
    spent = F.col("estado").isin("stale", "superseded")
    j = checkpoint(j.withColumn("antes", K.tokens_of(F.col("texto"))).withColumn("texto", F.when(spent, F.concat(F.lit("[read: "), F.col("estado"), F.lit("]"))).otherwise(F.col("texto"))).drop("estado"))
    tool = j.where(~F.col("papel").isin("user") & F.col("texto").isNotNull()).select(F.sha2("texto", 256).alias("h"), "texto").dropDuplicates(["h"])
    short = checkpoint(K.routed(tool, "h", "texto").select("h", F.col("texto").alias("curto")))
    j = j.withColumn("h", F.when(~F.col("papel").isin("user"), F.sha2("texto", 256))).join(short, "h", "left").withColumn("texto", F.coalesce("curto", "texto")).drop("h", "curto")
    j = checkpoint(j)
    out = without_repeats(j, repeated_spans(j))
    return out.select("conv", "turno", "papel", "texto", "antes", K.tokens_of(F.col("texto")).alias("depois"))
