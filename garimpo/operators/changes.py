"""Applying a feed of inserts, updates and deletes.

Method: repeated deliveries are dropped by change identifier, window ranking over the log sequence keeps the
latest change of each key, and the survivors are merged into the base, without the deleted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.text import outer_trim


def change_kind(op: Column) -> Column:
    """``u`` or ``d`` from an operation spelled with other case or outer blanks; anything else is null."""
    k = F.lower(outer_trim(op))
    return F.when(k.isin("u", "d"), k)


def latest_changes(changes: DataFrame, keys: list[str], seq: str = "seq", op: str = "op", arrived: str | None = None, salts: int = 16) -> DataFrame:
    """``keys, seq, op[, arrived]``: the last change of each key, with the first arrival of that change.

    Rows without seq, op or any but null keys in all of ``keys`` change nothing; a null in some of the keys is a
    key value like another. Deliveries of one seq for one key count once, whatever their spelling; if they
    contradict each other, the delete holds. Order of arrival, lateness and repetition have no influence.
    A key with a third of all rows is first ranked within ``salts`` random shares, so no task sorts it whole.
    """
    at = [arrived] if arrived else []
    c = changes.select(*[F.col(k) for k in keys], F.col(seq).cast("long").alias(seq), change_kind(F.col(op)).alias(op), *at)
    c = c.where(F.col(seq).isNotNull() & F.col(op).isNotNull() & F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
    # deduplicate by identifier; partial aggregation drops repeats before the shuffle
    c = c.groupBy(*keys, seq, op).agg(*[F.min(a).alias(a) for a in at]) if at else c.select(*keys, seq, op).distinct()
    order = [F.col(seq).desc(), F.col(op).asc(), *[F.col(a).asc_nulls_last() for a in at]]
    c = c.withColumn("__salt", F.pmod(F.xxhash64(seq), F.lit(salts)))
    for by in ([*keys, "__salt"], keys):
        c = c.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") == 1).drop("__rank")
    return c.drop("__salt")


def apply_changes(changes: DataFrame, keys: list[str], base: DataFrame | None = None, seq: str = "seq", op: str = "op") -> DataFrame:
    """Distinct ``keys`` that exist after all changes; with ``base``, its untouched keys exist too.

    A write makes a key exist whether or not it did before, a delete of an unknown key changes nothing.
    An empty feed gives the base, an empty base what the feed alone builds.
    """
    last = latest_changes(changes, keys, seq, op)
    if base is None:
        return last.where(F.col(op) == "u").select(*keys)
    tagged = last.select(*keys, F.col(op).alias("__op")).unionByName(base.select(*keys, F.lit("b").alias("__op")))
    merged = tagged.groupBy(*keys).agg(F.max(F.when(F.col("__op") == "d", 1).otherwise(0)).alias("__dead"))
    return merged.where(F.col("__dead") == 0).select(*keys)


def rebuild(changes: DataFrame, keys: list[str], base: DataFrame, seq: str = "seq", op: str = "op") -> DataFrame:
    """``base`` after all changes, with its other columns and ``situacao``: mantida, alterada or nova.

    The feed carries no values, so a changed row keeps those of the base and a new row has nulls in them. Rows of deleted
    keys go. Keys are compared null-safely; a key that the base holds several times stays as often. A base column
    named like ``seq`` or ``op`` is the base's.
    """
    last = latest_changes(changes, keys, seq, op).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(op).alias("__op"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    j = base.withColumn("__mine", F.lit(1)).join(last, on, "full").where(F.coalesce(F.col("__op") != "d", F.lit(True)))
    state = F.when(F.col("__mine").isNull(), "nova").when(F.col("__op").isNull(), "mantida").otherwise("alterada")
    key = {k: F.when(F.col("__mine").isNull(), F.col(f"__k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)}
    return j.select(*[key.get(c, F.col(f"`{c}`")) for c in base.columns], state.alias("situacao"))
