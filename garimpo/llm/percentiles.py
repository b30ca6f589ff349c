"""Percentiles of large numeric columns from sketches that can be combined.

Method: a randomized compactor hierarchy. Values wait in level 0; a level over its capacity is sorted and every second
value, from a random first or second one on, goes up a level, where it stands for twice as many. Sketches merge level by
level. Each compaction moves the rank of any value by at most its weight, up or down with equal chance, so the sum of
squared weights of all compactions gives a rank-error bound (Hoeffding) that each sketch carries with it.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.runtime import checkpoint

K = 1024
#: Chance that a percentile is off by more than the stated bound.
DELTA = 0.01
_HEAD = struct.Struct("<qdddi")
_FLUSH = 400_000


class Sketch:
    """Levels of values; a value of level h stands for 2**h values."""

    __slots__ = ("k", "n", "var", "low", "high", "levels")

    def __init__(self, k: int = K) -> None:
        self.k, self.n, self.var, self.low, self.high = k, 0, 0.0, math.inf, -math.inf
        self.levels: list[np.ndarray] = [np.empty(0)]

    def add(self, values: np.ndarray) -> Sketch:
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._compact()
        return self

    def merge(self, other: Sketch) -> Sketch:
        self.n, self.var = self.n + other.n, self.var + other.var
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for h, x in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
            self.levels[h] = np.concatenate([self.levels[h], x])
        self._compact()
        return self

    def _capacity(self, h: int) -> int:
        return max(8, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - h)))

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            x = self.levels[h]
            if len(x) > self._capacity(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                x = np.sort(x)
                even = len(x) & ~1
                # a reproducible coin: the same values in the same state fall the same way
                coin = zlib.crc32(x[:even].tobytes(), self.n & 0xFFFFFFFF) & 1
                self.levels[h] = x[even:]
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], x[coin:even:2]])
                self.var += 4.0**h
                h = 0  # a new level makes the lower ones smaller
            else:
                h += 1

    def quantiles(self, qs: list[float]) -> list[float | None]:
        if not self.n:
            return [None] * len(qs)
        x = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(v), 2.0**h) for h, v in enumerate(self.levels)])
        order = np.argsort(x, kind="stable")
        x, ranks = x[order], np.cumsum(w[order])
        return [self.low if q <= 0 else self.high if q >= 1 else float(x[min(len(x) - 1, int(np.searchsorted(ranks, q * ranks[-1])))]) for q in qs]

    def rank_error(self, delta: float = DELTA) -> float:
        """Share of all values by which a rank may be off, but for a chance of ``delta``; 0 while nothing was compacted."""
        return min(1.0, math.sqrt(2 * math.log(2 / delta) * self.var) / self.n) if self.n else 0.0

    def to_bytes(self) -> bytes:
        sizes = struct.pack(f"<{len(self.levels)}i", *map(len, self.levels))
        return _HEAD.pack(self.n, self.var, self.low, self.high, len(self.levels)) + sizes + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, b: bytes, k: int = K) -> Sketch:
        s = cls(k)
        s.n, s.var, s.low, s.high, m = _HEAD.unpack_from(b)
        sizes, at = struct.unpack_from(f"<{m}i", b, _HEAD.size), _HEAD.size + 4 * m
        values = np.frombuffer(b, np.float64, offset=at)
        s.levels = [x.copy() for x in np.split(values, np.cumsum(sizes)[:-1])]
        return s


def distinct_values(df: DataFrame, table: str, group: str, value: str, epoch: str) -> DataFrame:
    """``(tabela, grupo, dia, valor)``: one row per different row of ``df`` whose value is a number of at least 0.

    Rows repeated in every column count once; they are told apart by 128 hash bits over all columns and their nulls,
    so only these are shuffled. Null, NaN, infinite and negative values are left out. A null group is a group; a null,
    NaN or unreadable time is a null day.
    """
    v = F.col(value).cast("double")
    mask = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    t = F.col(epoch)
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))).select(
        F.lit(table).alias("tabela"),
        F.col(group).alias("grupo"),
        F.when(~F.isnan(t) & (F.abs(t) < 1e11), F.to_date(F.timestamp_seconds(F.floor(t)))).alias("dia"),
        v.alias("valor"),
        F.xxhash64(mask, *[F.col(f"`{c}`") for c in df.columns]).alias("__a"),
        F.xxhash64(F.lit(7), mask, *[F.col(f"`{c}`") for c in reversed(df.columns)]).alias("__b"),
    )
    return rows.distinct().drop("__a", "__b")


_SCHEMA = "tabela string, grupo string, dia date, n bigint, esboco binary"


def _batch(keys: list[tuple], sketches: list[Sketch]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.date32()))]
    return pa.RecordBatch.from_arrays([*cols, pa.array([s.n for s in sketches], pa.int64()), pa.array([s.to_bytes() for s in sketches], pa.binary())], ["tabela", "grupo", "dia", "n", "esboco"])


def sketch(values: DataFrame, k: int = K) -> DataFrame:
    """``(tabela, grupo, dia, n, esboco)``: one sketch per group and day and task; groups are reduced before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).group_by(["tabela", "grupo", "dia"]).aggregate([("valor", "list")])
            keys = list(zip(*[t.column(c).to_pylist() for c in ("tabela", "grupo", "dia")]))
            lists = t.column("valor_list").combine_chunks()
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            ends = ends - ends[0]
            held.clear()
            return _batch(keys, [Sketch(k).add(np.array(flat[a:b])) for a, b in zip(ends, ends[1:])])

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= _FLUSH:
                yield flush()
        if held:
            yield flush()

    return values.select("tabela", "grupo", "dia", "valor").mapInArrow(run, _SCHEMA)


def merge(sketches: DataFrame, by_day: bool, k: int = K) -> DataFrame:
    """Sketches of one group (and day) merged into one; without ``by_day`` the day comes out null.

    Sketches stream through their task sorted by group and are merged one by one, so the group is never held.
    """
    by = ["tabela", "grupo", *(["dia"] if by_day else [])]
    src = sketches if by_day else sketches.withColumn("dia", F.lit(None).cast("date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, Sketch(k)
        keys, done = [], []
        for b in batches:
            for *this, _, raw in zip(*[c.to_pylist() for c in b.columns]):
                if key != this:
                    if key is not None:
                        keys.append(tuple(key))
                        done.append(own)
                    key, own = this, Sketch.from_bytes(raw, k)
                else:
                    own.merge(Sketch.from_bytes(raw, k))
            if done:
                yield _batch(keys, done)
                keys, done = [], []
        if key is not None:
            yield _batch([tuple(key)], [own])

    return src.select("tabela", "grupo", "dia", "n", "esboco").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, _SCHEMA)


def percentiles(merged: DataFrame, qs: dict[str, float], k: int = K) -> DataFrame:
    """``(tabela, grupo, dia, n, <name of each quantile>, erro)``; ``erro`` bounds the rank error as a share of ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [Sketch.from_bytes(x, k) for x in b.column(4).to_pylist()]
            got = [s.quantiles(list(qs.values())) for s in own]
            cols = [pa.array([g[i] for g in got], pa.float64()) for i in range(len(qs))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols, pa.array([s.rank_error() for s in own], pa.float64())], [*b.schema.names[:4], *qs, "erro"])

    return merged.mapInArrow(run, "tabela string, grupo string, dia date, n bigint, " + ", ".join(f"{q} double" for q in qs) + ", erro double")


def day_sketches(tables: list[tuple[DataFrame, str, str, str, str]], k: int = K) -> DataFrame:
    """Merged sketches per group and day of ``(df, table, group, value, epoch seconds)``."""
    values = [distinct_values(*t) for t in tables]
    long = values[0]
    for v in values[1:]:
        long = long.unionByName(v)
    return merge(sketch(long, k), True, k)




#: Most groups whose percentiles are broadcast to be checked; beyond it the join shuffles.
SMALL = 100_000


def checked(tables: list[tuple[DataFrame, str, str, str, str]], qs: dict[str, float], k: int = K) -> DataFrame:
    """``(tabela, grupo, n, dentro)``: whether every percentile's exact rank lies within its stated bound.

    Exact ranks are counted over all values, pre-aggregated per task; the sketches are those of ``day_sketches``, merged over days.
    """
    got = checkpoint(percentiles(merge(day_sketches(tables, k), False, k), qs, k).drop("dia").withColumnsRenamed({"tabela": "__t", "grupo": "__g", "n": "__n"}))
    values = [distinct_values(*t) for t in tables]
    long = values[0]
    for v in values[1:]:
        long = long.unionByName(v)
    of = F.broadcast(got) if got.limit(SMALL + 1).count() <= SMALL else got
    j = long.select("tabela", "grupo", "valor").join(of, (F.col("tabela") == F.col("__t")) & F.col("grupo").eqNullSafe(F.col("__g")))
    counts = j.groupBy("tabela", "grupo", "erro", *qs).agg(F.count("*").alias("n"), *[F.count_if(F.col("valor") < F.col(q)).alias(f"below_{q}") for q in qs], *[F.count_if(F.col("valor") <= F.col(q)).alias(f"upto_{q}") for q in qs])
    slack = F.col("erro") + 1 / F.col("n")
    ok = F.lit(True)
    for q, x in qs.items():
        ok = ok & (F.col(f"below_{q}") / F.col("n") - x <= slack) & (x - F.col(f"upto_{q}") / F.col("n") <= slack)
    return counts.select("tabela", "grupo", "n", ok.alias("dentro"))
