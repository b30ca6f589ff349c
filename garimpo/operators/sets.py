"""Differences, incremental sync, upserts and deletes between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], same: Column | None = None, value: str | None = None) -> DataFrame:
    """``keys, estado``: nova, removida, mudada or igual, by one grouping of both sides instead of three joins.

    Values are compared null-safely by hash; repeated rows of a key count by their greatest value.
    """
    v = F.xxhash64(F.col(value).isNull(), F.col(value)) if value else F.lit(0).cast("long")
    both = old.select(*keys, v.alias("__a"), F.lit(None).cast("long").alias("__b")).unionByName(new.select(*keys, F.lit(None).cast("long").alias("__a"), v.alias("__b")))
    g = both.groupBy(*keys).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    state = F.when(F.col("__a").isNull(), "nova").when(F.col("__b").isNull(), "removida").when(F.col("__a") != F.col("__b"), "mudada").otherwise("igual")
    return g.select(*keys, state.alias("estado"))


def undirected_edges(e: DataFrame) -> DataFrame:
    """Edges by (smaller end, larger end, relation), each once."""
    return e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relation").distinct()


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], mode: str = "upsert") -> DataFrame:
    """Rows of ``base`` under ``delta``, whose null cells keep the old value.

    ``add`` ignores keys that exist, ``update`` keys that do not. Keys are unique in either table; keys compare null-safely.
    """
    if mode not in ("upsert", "add", "update"):
        raise ValueError(mode)
    cols = [c for c in base.columns if c not in keys]
    extra = [c for c in delta.columns if c not in base.columns]
    if extra:
        raise ValueError(f"columns {extra} are not in the base")
    side = lambda d, p: d.select(*keys, F.struct(*[F.col(c) if c in d.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in cols], F.lit(p).alias("__from")).alias(f"__{p}"))
    a, b = side(base, "a"), side(delta, "b")
    none = lambda x, other: x.withColumn(other[0], F.lit(None).cast(other[1]))
    g = none(a, ("__b", b.schema["__b"].dataType)).unionByName(none(b, ("__a", a.schema["__a"].dataType))).groupBy(*keys).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    old, new = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    keep = {"upsert": old | new, "add": old | new, "update": old}[mode]
    pick = lambda c: F.when(old & new & F.lit(mode == "add"), F.col(f"__a.{c}")).otherwise(F.coalesce(F.col(f"__b.{c}"), F.col(f"__a.{c}"))).alias(c)
    return g.where(keep).select(*keys, *[pick(c) for c in cols])


def delete(base: DataFrame, keys: DataFrame, on: list[str], where: Column | None = None) -> DataFrame:
    """``base`` without the rows whose key is listed and, if given, that satisfy ``where``."""
    listed = keys.select(*on).distinct()
    if where is None:
        return base.join(listed, on, "left_anti")
    hit = F.coalesce(where, F.lit(False))
    return base.where(~hit).unionByName(base.where(hit).join(listed, on, "left_anti"))


def sync_plan(indexed: DataFrame, seen: DataFrame, key: str, stamp: str) -> DataFrame:
    """``key, acao``: index what is new or newer, remove what is gone, leave the rest."""
    d = diff(indexed, seen, [key], value=stamp)
    return d.select(key, F.when(F.col("estado").isin("nova", "mudada"), "indexar").when(F.col("estado") == "removida", "remover").otherwise("manter").alias("acao"))
