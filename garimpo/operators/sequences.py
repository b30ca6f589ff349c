"""Window-style computations: versions, runs, change points, outliers, limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, by: list[str], order: list[Column], keep: int, ordinal: str = "ordem") -> DataFrame:
    """The newest ``keep`` rows of each group with their ordinal, 1 the newest."""
    return df.withColumn(ordinal, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(ordinal) <= keep)


def changed_only(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before; the first row of a group always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("__prev", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return d.where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__prev"))).drop("__prev", "__n")


def runs(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Consecutive equal values folded: ``by, value, corrida, tamanho``."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    d = d.withColumn("corrida", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, value, "corrida").agg(F.count("*").alias("tamanho"))


def change_points(df: DataFrame, by: list[str], order: list[Column], value: str, half: int = 5, gap: bool = True) -> DataFrame:
    """Rows where the mean of ``half`` values from here on is over 2 sigma from that of the ``half`` before, with both means.

    Row i of n counts for half <= i < n - half, from 0. With ``gap`` a row counts only if it is over ``half`` rows behind the last one
    that counted. Null and NaN values are left out before rows are numbered; a group of equal values has no change.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(whole))
    d = d.withColumn("antes", F.avg(value).over(w.rowsBetween(-half, -1))).withColumn("depois", F.avg(value).over(w.rowsBetween(0, half - 1)))
    d = d.withColumn("__sd", F.stddev_samp(value).over(whole))
    ok = (F.col("__i") > half) & (F.col("__i") <= F.col("__n") - half) & (F.col("__sd") > 0)
    hit = d.where(ok & (F.abs(F.col("depois") - F.col("antes")) > 2 * F.col("__sd"))).drop("__n", "__sd")
    return (spaced(hit, by, "__i", half) if gap else hit).drop("__i")


def spaced(df: DataFrame, by: list[str], at: str, gap: int) -> DataFrame:
    """Rows of each group over ``gap`` behind the last row that was kept; the first row stays.

    Greedy, so sequential within a group; rows stream through their task in order and only the last place is held.
    """
    out = df.repartition(*by).sortWithinPartitions(*by, at)
    keys = [df.columns.index(c) for c in by]
    place = df.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = object(), None
        for b in batches:
            keep = []
            for *key, i in zip(*[b.column(k).to_pylist() for k in keys], b.column(place).to_pylist()):
                if key != last or kept is None or i - kept > gap:
                    last, kept = key, i
                    keep.append(True)
                else:
                    keep.append(False)
            yield b.filter(pa.array(keep, pa.bool_()))

    return out.mapInArrow(run, df.schema)


def outliers(df: DataFrame, by: list[str], value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows over ``sigmas`` sample deviations from their group's mean; the statistics are aggregated before they are joined."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__sd"))
    return df.join(s, by).where((F.col("__sd") > 0) & (F.abs(F.col(value) - F.col("__m")) > sigmas * F.col("__sd"))).drop("__m", "__sd")


def ends_before_next(df: DataFrame, by: list[str], start: str, end: str = "fim") -> DataFrame:
    """The end of each span: one before the next start, null for the last."""
    return df.withColumn(end, F.lead(start).over(Window.partitionBy(*by).orderBy(start)) - 1)


def monotone_share(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Share of steps up and of steps down along the order."""
    d = df.withColumn("__p", F.lag(value).over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__p").isNotNull() & F.col(value).isNotNull())
    return d.groupBy(*by).agg(F.round(F.avg((F.col(value) >= F.col("__p")).cast("double")), 4).alias("sobe"), F.round(F.avg((F.col(value) <= F.col("__p")).cast("double")), 4).alias("desce"))


def context_of(df: DataFrame, by: list[str], order: list[Column], selected: Column, around: int = 3) -> DataFrame:
    """Selected rows and those up to ``around`` rows from one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-around, around)
    return df.withColumn("__sel", F.max(selected.cast("int")).over(w)).where(F.col("__sel") == 1).drop("__sel")


def rate_limited(calls: DataFrame, by: list[str], at: str, order: str, most: int, seconds: float) -> DataFrame:
    """``calls`` with ``espera``: 0 if the call fits (and counts), else the seconds until one would.

    At most ``most`` accepted calls within ``seconds``; refused calls do not count, so this is a state machine and no range
    frame. Rows stream through their task sorted by key and time; the state is the accepted calls of one key.
    """
    keys = len(by)
    cols = [*by, at, order]
    src = calls.select(*cols).where(F.col(at).isNotNull())
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in cols) + ", espera double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window = object(), deque()
        for b in batches:
            wait = []
            for *key, now in zip(*[c.to_pylist() for c in b.columns[: keys + 1]]):
                if key != last:
                    last, window = key, deque()
                while window and now - window[0] >= seconds:
                    window.popleft()
                if len(window) >= most:
                    wait.append(round(seconds - (now - window[0]), 3))
                else:
                    window.append(now)
                    wait.append(0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(wait, pa.float64())], [*b.schema.names, "espera"])

    return src.repartition(*by).sortWithinPartitions(*by, at, order).mapInArrow(run, schema)
