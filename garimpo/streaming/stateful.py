"""Structured Streaming forms of the stateful parts: counters, windows, limits, alerts, deduplicated versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from garimpo.runtime import checkpoint


def access_counts(opens: DataFrame, key: str = "caminho", at: str = "em") -> DataFrame:
    """Running total and last access per key; run in update or complete mode."""
    return opens.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("total"), F.max(at).alias("ultimo"))


def windowed(events: DataFrame, ts: str, by: str, value: str, size: str, late: str) -> DataFrame:
    """Counts and sums per event-time window; rows later than ``late`` are dropped and closed windows are appended once."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("soma"))
    return g.select(F.col("w.start").alias("inicio"), by, "n", "soma")


def first_deliveries(rows: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key once within the watermark: repeated deliveries are dropped, state is bounded."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def limiter(calls: DataFrame, key: str, at: str, most: int, seconds: float) -> DataFrame:
    """``(key, at, espera)``: a sliding limit that counts accepted calls only; state is at most ``most`` times a key.

    Calls of one micro-batch are taken in the order of time.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        wait = []
        for now in rows[at]:
            while window and now - window[0] >= seconds:
                window.pop(0)
            if len(window) >= most:
                wait.append(round(seconds - (now - window[0]), 3))
            else:
                window.append(float(now))
                wait.append(0.0)
        state.update((window,))
        yield pd.DataFrame({key: [k[0]] * len(rows), at: rows[at].astype(float), "espera": wait})

    return calls.groupBy(key).applyInPandasWithState(run, f"{key} string, {at} double, espera double", "window array<double>", "append", GroupStateTimeout.NoTimeout)


def alerts(checks: DataFrame, hold: float) -> DataFrame:
    """``(chave, em, evento)`` from ``(chave, em, ativo)``: aberto once a condition held ``hold`` seconds, resolvido when it ends.

    A condition that ends before that leaves no event. State per key: since when, whether it fired.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, fired = state.get if state.exists else (None, False)
        out = []
        for em, on in pd.concat(list(batches)).sort_values("em", kind="stable")[["em", "ativo"]].itertuples(index=False):
            if on:
                since = em if since is None else since
                if not fired and em - since >= hold:
                    fired = True
                    out.append((k[0], em, "aberto"))
            else:
                if fired:
                    out.append((k[0], em, "resolvido"))
                since, fired = None, False
        state.update((None if since is None else float(since), bool(fired)))
        yield pd.DataFrame(out, columns=["chave", "em", "evento"])

    return checks.groupBy("chave").applyInPandasWithState(run, "chave string, em double, evento string", "since double, fired boolean", "append", GroupStateTimeout.NoTimeout)


#: Buckets of a merged table: a batch rewrites only those it has changes for.
BUCKETS = 64


def merge_changes(feed: DataFrame, target: str, key: str, seq: str, op: str | None = None, buckets: int = BUCKETS):  # noqa: ANN201
    """A ``foreachBatch`` sink that keeps the latest change of each key in a table of ``buckets`` folders; ``current`` reads it.

    Only buckets with changes are read and replaced. A batch that runs again gives the same, as the greatest ``seq`` decides. Deletes
    (``op`` d) stay as marks, so that an older change that comes late does not bring a row back. The number of buckets is fixed by the
    first batch.
    """

    def sink(batch: DataFrame, epoch: int) -> None:  # noqa: ARG001
        spark = batch.sparkSession
        rows = checkpoint(batch.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        own = rows
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)  # noqa: SLF001
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):  # noqa: SLF001
            old = spark.read.schema(rows.schema).parquet(target).where(F.col("__bucket").isin(touched))
            own = own.unionByName(old)
        rest = [c for c in rows.columns if c not in (key, "__bucket")]
        latest = own.groupBy(key, "__bucket").agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*", "__bucket").select(rows.columns)
        checkpoint(latest).repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(target)

    return feed.writeStream.foreachBatch(sink)


def current(spark: SparkSession, target: str, op: str | None = None) -> DataFrame:
    """Rows of a merged table that are not deleted."""
    t = spark.read.parquet(target)
    return (t if op is None else t.where(F.coalesce(F.lower(F.trim(op)) != "d", F.lit(True)))).drop("__bucket")


def changed_versions(versions: DataFrame, key: str, at: str, content: str) -> DataFrame:
    """``(key, at, marca)`` of versions whose content differs from the last one of their key; state per key: the last mark.

    Versions of one micro-batch are taken in the order of time; equal contents one after the other give one version.
    """
    src = versions.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(at).cast("double").alias(at), F.sha2(F.coalesce(content, F.lit("")), 256).alias("marca"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        new = rows[rows["marca"] != rows["marca"].shift(1, fill_value=last if last is not None else "")]
        state.update((str(rows["marca"].iloc[-1]),))
        yield pd.DataFrame({key: k[0], at: new[at].astype(float), "marca": new["marca"]})

    return src.groupBy(key).applyInPandasWithState(run, f"{key} string, {at} double, marca string", "marca string", "append", GroupStateTimeout.NoTimeout)


def refreshed(cache: DataFrame, log: DataFrame, read_to: int, whole: DataFrame, key: str, seq: str = "seq", op: str = "op") -> tuple[DataFrame, int, bool]:
    """``(rows, read to, reloaded)``: a reader's copy brought up to date from the change log.

    Keys changed since ``read_to`` are taken anew from ``whole``, deleted ones go. Where the log no longer reaches back to what was read, all of
    ``whole`` is loaded. The reader's place and the log's ends are three numbers.
    """
    ends = log.agg(F.min(seq).alias("a"), F.max(seq).alias("z")).first()
    if ends["z"] is None or ends["z"] <= read_to:
        return cache, read_to, False
    if ends["a"] > read_to + 1:
        return whole, int(ends["z"]), True
    moved = log.where(F.col(seq) > read_to).groupBy(key).agg(F.max_by(F.lower(F.trim(op)), seq).alias("__op"))
    live = whole.join(moved.where("__op <> 'd'").select(key), key, "left_semi").select(cache.columns)
    return cache.join(moved.select(key), key, "left_anti").select(cache.columns).unionByName(live), int(ends["z"]), False
