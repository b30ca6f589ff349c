"""Mixing sources to target weights.

Method: a low-discrepancy schedule. Slot i takes the point frac(i / golden ratio), mapped through the cumulative weights
to a source, so any run of slots holds each source in its share. The r-th slot of a source takes the r-th block of equal
token count of that source's texts in shuffled order; when the texts are used up they begin again, at most as often as
the source may be repeated.

Ranks and running sums are taken in two steps, sums of chunks first, so no source is ever sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.text import outer_trim
from garimpo.llm.tokens import encode_table
from garimpo.runtime import checkpoint

BLOCK = 512
SEED = 20_250_901
CHUNK = 65_536
#: Most sources that the schedule takes; their weights are read on the driver.
MAX_SOURCES = 10_000
#: Fixed value: 2**64 divided by the golden ratio.
GOLDEN = 11_400_714_819_323_198_485


@dataclass
class Plan:
    """What each source gives: shares are of the sources that have tokens and a positive weight."""

    source: list[str]
    target: list[float]
    share: list[float]
    tokens: list[int]
    repeats: list[int]
    total: int


def source_key(c: Column) -> Column:
    """The source a spelling names: without outer blanks, in lower case."""
    return F.lower(outer_trim(c))


def sized_texts(docs: DataFrame, weights: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str | None = None) -> DataFrame:
    """``(chave, fonte, n_tokens)``: each different text of a listed source once, with its tokens.

    Of documents of one text, the smallest key of a listed source stands for all, so that a text is not used more often
    by being stored more often. Rows of null or unlisted source and texts without tokens are no candidates.
    """
    listed = weights.select(source_key(F.col("source")).alias("fonte")).distinct()
    d = docs.select(F.col(key).alias("chave"), source_key(F.col(source)).alias("fonte"), F.col(text).alias("texto")).where(F.col("fonte").isNotNull() & (F.octet_length("texto") > 0))
    d = d.join(listed, "fonte", "left_semi").withColumn("__a", F.xxhash64("texto")).withColumn("__b", F.xxhash64(F.lit(3), "texto"))
    sized = encode_table(d, "chave", "texto", ids=False, path=vocabulary, carry=["fonte", "__a", "__b"])
    return sized.groupBy("__a", "__b").agg(F.min(F.struct("chave", "fonte", "n_tokens")).alias("d")).select("d.*")


def plan_of(sized: DataFrame, weights: DataFrame, total: int | None = None) -> Plan:
    """The sources' shares and the total: as many tokens as the scarcest source allows, or at most ``total``."""
    w = (
        weights.select(source_key(F.col("source")).alias("fonte"), F.col("peso").cast("double").alias("peso"), F.col("max_rep").cast("int").alias("rep"))
        .where(F.col("fonte").isNotNull())
        .groupBy("fonte")
        .agg(F.sum(F.when(F.col("peso") > 0, F.col("peso")).otherwise(0.0)).alias("peso"), F.max("rep").alias("rep"))
    )
    sums = sized.groupBy("fonte").agg(F.sum("n_tokens").alias("tokens"))
    got = w.join(sums, "fonte", "left").orderBy("fonte").limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    can = [r.peso if (r.tokens or 0) > 0 and (r.rep or 0) > 0 else 0.0 for r in got]
    all_of = sum(can)
    share = [x / all_of if all_of else 0.0 for x in can]
    most = min((int(r.tokens) * r.rep / s for r, s in zip(got, share) if s), default=0)
    weight = sum(r.peso for r in got)
    return Plan([r.fonte for r in got], [r.peso / weight if weight else 0.0 for r in got], share, [int(r.tokens or 0) for r in got], [max(0, r.rep or 0) for r in got], int(min(most, total) if total is not None else most))


def _sources_of(slots: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The source of each slot."""
    x = (slots.astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(np.searchsorted(edges, x, side="right"), len(edges) - 1)


def schedule(df: DataFrame, plan: Plan, slots: int) -> DataFrame:
    """``(posicao, __s, __r)``: the source number of each slot and the rank of the slot within its source."""
    spark = df.sparkSession
    edges = np.cumsum(plan.share)
    last = max(i for i, s in enumerate(plan.share) if s)
    edges[last:] = 2.0
    chunks = spark.range(math.ceil(slots / CHUNK)).withColumnRenamed("id", "c")

    def span(c: int) -> np.ndarray:
        return np.arange(c * CHUNK, min(slots, (c + 1) * CHUNK), dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                n = np.bincount(_sources_of(span(c), edges), minlength=len(edges))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["c", "s", "n"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first = {x["s"]: x["before"] for x in base}
                i = span(c)
                s = _sources_of(i, edges).astype(np.int32)
                order = np.argsort(s, kind="stable")
                runs = np.searchsorted(s[order], np.arange(len(edges)))
                r = np.empty(len(i), np.int64)
                r[order] = np.arange(len(i)) - runs[s[order]] + np.array([first.get(k, 0) for k in range(len(edges))])[s[order]]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), pa.array(r)], ["posicao", "__s", "__r"])

    before = F.sum("n").over(Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    bases = chunks.mapInArrow(count, "c long, s int, n long").withColumn("before", F.coalesce(before, F.lit(0))).groupBy("c").agg(F.collect_list(F.struct("s", "before")).alias("base"))
    return bases.mapInArrow(rank, "posicao long, __s int, __r long")


def _numbered(sized: DataFrame, plan: Plan) -> DataFrame:
    """``sized`` with the source's number, tokens and repeats; at most ``MAX_SOURCES`` rows are broadcast."""
    rows = [(f, i, t, r if s else 0) for i, (f, t, r, s) in enumerate(zip(plan.source, plan.tokens, plan.repeats, plan.share))]
    of = sized.sparkSession.createDataFrame(rows, "fonte string, __s int, __size long, __reps int")
    return sized.join(F.broadcast(of), "fonte")


def placed(sized: DataFrame, plan: Plan, block: int, seed: int) -> DataFrame:
    """``(chave, fonte, __s, n_tokens, uso, __start, __r)``: each possible use of each text and the block it begins in."""
    n = sized.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / 4096)))
    d = _numbered(sized, plan).where(F.col("__reps") > 0).withColumn("__h", F.xxhash64(F.lit(seed), "chave"))
    d = d.withColumn("__b", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = d.groupBy("__s", "__b").agg(F.sum("n_tokens").alias("__n"))
    w = Window.partitionBy("__s", "__b").orderBy("__h", "chave").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__in", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__n").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    d = d.join(sums, ["__s", "__b"]).withColumn("uso", F.explode(F.sequence(F.lit(0), F.col("__reps") - 1)))
    start = F.col("uso") * F.col("__size") + F.col("__base") + F.col("__in")
    return d.withColumn("__start", start).withColumn("__r", F.floor(F.col("__start") / block)).select("chave", "fonte", "__s", "n_tokens", "uso", "__start", "__r")


def mix(docs: DataFrame, weights: DataFrame, block: int = BLOCK, total: int | None = None, seed: int = SEED, vocabulary: str | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The mixture and the shares it reaches.

    Mixture: ``(posicao, ordem, doc_id, fonte, uso, n_tokens)``, one row per use of a text; read by posicao, then ordem.
    Shares: ``(fonte, peso, alvo, alcancado, tokens, textos, usos)``; alvo is the weight among the sources that have
    texts, alcancado the share of the mixture's tokens. A source without texts comes out with share 0. The total is what
    the scarcest source allows at its cap; shares are exact but for one block and one text of each source. Empty tables
    give an empty mixture.
    """
    sized = checkpoint(sized_texts(docs, weights, vocabulary=vocabulary, **columns))
    plan = plan_of(sized, weights, total)
    slots = math.ceil(plan.total / block)
    spark = docs.sparkSession
    if slots:
        uses = placed(sized, plan, block, seed).join(schedule(docs, plan, slots), ["__s", "__r"])
        out = uses.select("posicao", F.col("__start").alias("ordem"), F.col("chave").alias("doc_id"), "fonte", "uso", "n_tokens")
    else:
        out = spark.createDataFrame([], f"posicao long, ordem long, doc_id {sized.schema['chave'].dataType.simpleString()}, fonte string, uso int, n_tokens long")
    made = out.groupBy("fonte").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("textos"), (F.max("uso") + 1).alias("usos"))
    targets = spark.createDataFrame([(s, float(t), float(a)) for s, t, a in zip(plan.source, plan.target, plan.share)], "fonte string, peso double, alvo double")
    shares = targets.join(made, "fonte", "left").select("fonte", "peso", "alvo", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("textos", F.lit(0)).alias("textos"), F.coalesce("usos", F.lit(0)).alias("usos"))
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per listed source
    return out, shares.withColumn("alcancado", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)))
