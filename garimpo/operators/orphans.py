"""References to records that do not exist, per table and period.

Method: parents and children go into one long, tagged form ``(parent table, key, is parent, child table,
period, count)``. Children are summed per key and period before the shuffle; one grouping per (parent table,
key) then keeps the keys without a parent tag. No join, so no side has to fit in memory, and a key that a third
of all rows refers to is one row per task, table and period by the time it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Children:
    """Rows that refer to a parent. ``key`` must be null where a row holds no reference."""

    df: DataFrame
    table: str
    parent: str
    key: Column
    arrived: Column
    period_format: str = "yyyy-MM"


@dataclass(frozen=True)
class Parents:
    """Rows that can be referred to; rows of null ``key`` are no parents."""

    df: DataFrame
    table: str
    key: Column
    alive: Column = field(default_factory=lambda: F.lit(True))


def orphan_references(parents: list[Parents], children: list[Children]) -> DataFrame:
    """``(tabela, ref, periodo, linhas)``: each orphan key with its number of referring rows per child table and period.

    Keys are compared as text, exactly. A parent counts whenever it arrives. Null keys are no reference; rows
    without an arrival time come out with a null period. Repeated parents and children do no harm: parents are
    tags, children are counted. Other columns of the inputs are not looked at, whatever their names.
    """
    long = [
        p.df.where(p.alive).select(F.lit(p.table).alias("__parent"), p.key.cast("string").alias("__key"), F.lit(1).alias("__is"), F.lit(None).cast("string").alias("__table"), F.lit(None).cast("string").alias("__period"), F.lit(0).cast("long").alias("__n"))
        for p in parents
    ]
    long += [
        c.df.select(F.lit(c.parent).alias("__parent"), c.key.cast("string").alias("__key"), F.lit(0).alias("__is"), F.lit(c.table).alias("__table"), F.date_format(c.arrived, c.period_format).alias("__period"), F.lit(1).cast("long").alias("__n"))
        for c in children
    ]
    tagged = reduce(DataFrame.unionByName, long).where(F.col("__key").isNotNull())
    summed = tagged.groupBy("__parent", "__key", "__table", "__period").agg(F.max("__is").alias("__is"), F.sum("__n").alias("__n"))
    # at most (child tables x periods) entries a key
    keys = summed.groupBy("__parent", "__key").agg(
        F.max("__is").alias("__is"),
        F.collect_list(F.when(F.col("__is") == 0, F.struct("__table", "__period", "__n"))).alias("__refs"),
    )
    return (
        keys.where(F.col("__is") == 0)
        .select("__key", F.explode("__refs").alias("r"))
        .select(F.col("r.__table").alias("tabela"), F.col("__key").alias("ref"), F.col("r.__period").alias("periodo"), F.col("r.__n").alias("linhas"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``(tabela, periodo, refs, linhas)``: distinct orphan keys and their rows per table and period."""
    return orphans.groupBy("tabela", "periodo").agg(F.count("*").alias("refs"), F.sum("linhas").alias("linhas"))
