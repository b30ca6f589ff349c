"""Entity resolution of labels: MinHash candidates, verified by Jaro-Winkler, joined to groups with one survivor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.operators.components import components
from garimpo.operators.entities import char_shingles, entropy, jaro_batch, normal_label
from garimpo.runtime import checkpoint

#: The hash family that signatures must share to be comparable with stored ones: 128 permutations, coefficients drawn from
#: seed 1 below a Mersenne prime. Bands and rows balance false and missed candidates at a Jaccard similarity of 0.7.
PERMUTATIONS = 128
PRIME = (1 << 61) - 1
BANDS, ROWS = 14, 9
#: Labels of a band that are paired within it; of a larger one all are compared exactly.
HOT = 200
#: Columns that letters are counted in, labels of a tile that is compared at once, least labels of a block and most blocks.
TOKENS, TILE, BLOCK, BLOCKS = 256, 1024, 2048, 64
#: Labels whose connections a task holds at once.
HELD = 500_000


@lru_cache(maxsize=4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(1)
    return draw.randint(1, PRIME, n, dtype=np.uint64), draw.randint(0, PRIME, n, dtype=np.uint64)


def min_hashes(sets: list[list[str]], n: int = PERMUTATIONS) -> np.ndarray:
    """Signatures of sets of texts: minima of (a h + b mod 2^64 mod prime) over 32-bit SHA-1 prefixes; an empty set has all ones."""
    words = sorted({w for s in sets for w in s})
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint64)
    if not words:
        return out
    h = np.array([int.from_bytes(hashlib.sha1(w.encode("utf-8", "surrogatepass")).digest()[:4], "little") for w in words], np.uint64)
    a, b = _family(n)
    hashed = ((h[:, None] * a + b) % np.uint64(PRIME)) & np.uint64(0xFFFFFFFF)
    at = {w: i for i, w in enumerate(words)}
    for i, s in enumerate(sets):
        if s:
            out[i] = hashed[[at[w] for w in s]].min(axis=0)
    return out


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, len(whole), 500):
            b = whole.slice(i, 500)
            sig = min_hashes(b.column(1).to_pylist())
            labels, keys = [], []
            for label, s in zip(b.column(0).to_pylist(), sig):
                for k in range(BANDS):
                    labels.append(label)
                    keys.append(hashlib.blake2b(bytes([k]) + s[k * ROWS : (k + 1) * ROWS].tobytes(), digest_size=8).digest())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(np.frombuffer(b"".join(keys), np.int64))], ["rotulo", "banda"])


def _tokens(labels: list[str]) -> np.ndarray:
    """``(labels, TOKENS)``: how many of a label's letters, each with its number among equal ones, fall in a column; the product of two
    rows is the number of common letters, or more where columns are shared."""
    out = np.zeros((len(labels), TOKENS), np.float32)
    for row, label in enumerate(labels):
        seen: dict[str, int] = {}
        for c in label:
            seen[c] = k = seen.get(c, 0) + 1
            out[row, (ord(c) * 31 + k * 97) % TOKENS] += 1
    return out


class Forest:
    """Which labels are known to be connected. Over ``HELD`` labels it begins anew, so that pairs may be given that were not needed, but none is lost."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.root = np.empty(0, np.int64)

    def numbers(self, labels: list[str]) -> np.ndarray:
        """Numbers of the labels; those given before hold until the next call of ``fit``."""
        n = np.fromiter((self.number.setdefault(x, len(self.number)) for x in labels), np.int64, len(labels))
        self.root = np.r_[self.root, np.arange(len(self.root), len(self.number))]
        return n

    def fit(self, more: int) -> None:
        if len(self.number) + more > HELD:
            self.__init__()

    def join(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Connects ``p`` with ``q``, one after another; the places of those that were not connected."""
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while v in up:
                up[v] = v = up.get(up[v], up[v])
            return v

        new = []
        for k, (x, y) in enumerate(zip(self.root[p].tolist(), self.root[q].tolist())):
            x, y = top(x), top(y)
            if x != y:
                up[y] = x
                new.append(k)
        if up:
            to = np.arange(len(self.root))
            to[list(up)] = [top(v) for v in list(up)]
            self.root = to[self.root]
        return np.array(new, np.int64)


def close_pairs(x: list[str], y: list[str] | None, threshold: float, forest: Forest | None = None) -> Iterator[tuple[list[str], list[str]]]:
    """All pairs of ``x`` with ``y``, or within ``x``, whose Jaro-Winkler similarity reaches the threshold, in parts.

    m common letters allow a Jaro similarity of (m/|a| + m/|b| + 1)/3 at most. Pairs are dropped by this bound as if four letters were
    common at the beginning, then with those that are, and the rest is compared exactly. With a ``forest`` only pairs come out that
    connect what is not connected yet; they connect the same labels as all pairs do.
    """
    def side(labels: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        labels = sorted(labels, key=len)
        first = np.frombuffer("".join(t[:4].ljust(4, "\0") for t in labels).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, 4)
        return labels, 1 / np.fromiter(map(len, labels), np.float32, len(labels)), _tokens(labels), first

    # a bonus is given over 0.7 only
    least = min(threshold, max(0.7, (threshold - 0.4) / 0.6)) - 1e-5
    a, ia, ta, fa = side(x)
    b, ib, tb, fb = (a, ia, ta, fa) if y is None else side(y)
    if forest is not None:
        forest.fit(len(a) + len(b))
        na, nb = forest.numbers(a), forest.numbers(b)
    for i in range(0, len(a), TILE):
        for j in range(i if y is None else 0, len(b), TILE):
            u, v = ia[i : i + TILE], ib[j : j + TILE]
            if (2 + min(1, u.max() / v.min(), v.max() / u.min())) / 3 < least:  # all lengths differ too much; u, v are their inverses
                continue
            bound = (ta[i : i + TILE] @ tb[j : j + TILE].T) * (u[:, None] + v)
            ok = bound >= 3 * least - 1
            r, c = np.nonzero(np.triu(ok, 1) if y is None and i == j else ok)
            top = (bound[r, c].astype(np.float64) + 1) / 3
            r, c = r + i, c + j
            same = (fa[r] == fb[c]) & (fa[r] != 0)
            top = np.where(top > 0.7 - 1e-5, top + 0.1 * np.cumprod(same, axis=1).sum(axis=1) * (1 - top), top)
            r, c = r[top >= threshold - 1e-5], c[top >= threshold - 1e-5]
            wide = max(len(a[min(i + TILE, len(a)) - 1]), len(b[min(j + TILE, len(b)) - 1]))
            step = max(1, min(8192, 2_000_000 // max(16, wide)))
            while len(r):
                if forest is not None:
                    apart = forest.root[na[r]] != forest.root[nb[c]]
                    r, c = r[apart], c[apart]
                    if not len(r):
                        break
                p, q = [a[k] for k in r[:step]], [b[k] for k in c[:step]]
                s, n = jaro_batch(p, q)
                keep = np.flatnonzero(np.where(s > 0.7, s + 0.1 * n * (1 - s), s) >= threshold)
                if forest is not None:
                    keep = keep[forest.join(na[r[keep]], nb[c[keep]])]
                yield [min(p[k], q[k]) for k in keep], [max(p[k], q[k]) for k in keep]
                r, c = r[step:], c[step:]


def _cells(threshold: float, spanning: bool):  # noqa: ANN202
    """Streams rows (cell, left, rotulo) sorted by cell: the similar pairs of each; a cell without right labels is paired within.

    With ``spanning`` a task leaves out pairs that its pairs before connect already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, ([], [])
        forest = Forest() if spanning else None

        def pairs() -> Iterator[pa.RecordBatch]:
            for x, y in close_pairs(held[0], held[1] if open_[1] else None, threshold, forest):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string())], ["a", "b"])

        for b in batches:
            for *cell, left, label in zip(*[c.to_pylist() for c in b.columns]):
                if cell != open_:
                    if open_ is not None:
                        yield from pairs()
                    open_, held = cell, ([], [])
                held[0 if left else 1].append(label)
        if open_ is not None:
            yield from pairs()

    return run


def _close(labels: DataFrame, threshold: float, spanning: bool = False) -> DataFrame:
    """``(a, b)``: all pairs of different ``labels (rotulo)``, written already, whose similarity reaches the threshold, or as many as connect them.

    Labels go to blocks and each pair of blocks is one cell, so a label is sent once a block, ``BLOCKS`` times at most, and nothing else is written.
    """
    n = max(4, min(BLOCKS, -(-labels.count() // BLOCK)))
    h, o = F.pmod(F.xxhash64("rotulo"), F.lit(n)), F.col("o")
    each = labels.select("rotulo", h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    rows = each.select((F.least("h", o) * n + F.greatest("h", o)).alias("cell"), (F.col("h") != o).alias("two"), (F.col("h") <= o).alias("left"), "rotulo")
    tasks = min(n * (n + 1) // 2, 4 * labels.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_cells(threshold, spanning), "a string, b string")


def _met(bands: DataFrame) -> DataFrame:
    # never broadcast: a label has many bands, which Spark's estimate of the size does not know
    x, y = bands.select(F.col("rotulo").alias("a"), "banda"), bands.select(F.col("rotulo").alias("b"), "banda")
    return x.join(y.hint("merge"), "banda").where("a < b").select("a", "b").distinct()


def label_pairs(labels: DataFrame, column: str, threshold: float = 0.92, least_bits: float = 2.5, exact: bool = False, spanning: bool = False) -> DataFrame:
    """``(a, b)``: different normal forms that may be similar.

    Labels are normalised and deduplicated first, so equal labels never meet; those under ``least_bits`` of entropy per character say too
    little to be merged and take no part. Null labels are left out. By default candidates share a band of their MinHash signatures, which
    is the engine's own rule and finds pairs of similar trigrams only; labels of a band over ``HOT`` labels are all compared
    exactly instead, so no band is expanded whole. With ``exact`` all labels are, and no pair of the threshold is lost;
    with ``spanning`` besides, only pairs are given that connect the same labels, in each task fewer than labels.
    """
    # cut here, or the test of each label would be made for each row
    n = checkpoint(labels.select(normal_label(F.col(column)).alias("rotulo")).where("rotulo <> ''").distinct())
    n = checkpoint(n.where(entropy(F.col("rotulo")) >= least_bits))
    if exact:
        return _close(n, threshold, spanning)
    bands = checkpoint(n.select("rotulo", char_shingles(F.col("rotulo")).alias("s")).mapInArrow(_band_keys, "rotulo string, banda bigint"))
    size = bands.groupBy("banda").agg(F.count("*").alias("n"))
    cold = bands.join(size.where(F.col("n").between(2, HOT)).select("banda"), "banda", "left_semi")
    hot = bands.join(size.where(F.col("n") > HOT).select("banda"), "banda", "left_semi").select("rotulo").distinct()
    return _met(cold).unionByName(_close(checkpoint(hot), threshold)).distinct()


def similar_labels(labels: DataFrame, column: str, threshold: float = 0.92, least_bits: float = 2.5, exact: bool = False) -> DataFrame:
    """``(a, b, sim)``: the pairs of ``label_pairs`` at least as similar as the threshold."""
    return scored_pairs(label_pairs(labels, column, threshold, least_bits, exact), threshold).select("a", "b", F.col("jw").alias("sim"))


def scored_pairs(pairs: DataFrame, least: float, either: bool = False) -> DataFrame:
    """``(a, b, jw, j)``: Jaro-Winkler and Jaro similarity of different pairs; those of at least ``least`` by Jaro-Winkler, or by ``either``.

    Comparing takes longer than reading, so pairs are made different first and go to all cores whatever their size in bytes.
    """
    cores = pairs.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.slice(at, 4096)
                j, p = jaro_batch(b.column(0).to_pylist(), b.column(1).to_pylist())
                w = np.where(j > 0.7, j + 0.1 * p * (1 - j), j)
                keep = pa.array((np.maximum(w, j) if either else w) >= least)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*b.columns, pa.array(w), pa.array(j))], ["a", "b", "jw", "j"])

    return checkpoint(pairs.select("a", "b")).repartition(2 * cores, "a").mapInArrow(run, "a string, b string, jw double, j double")


def resolve(nodes: DataFrame, key: str, label: str, threshold: float = 0.92, exact: bool = False) -> DataFrame:
    """``(key, sobrevivente)``: each node whose label is equal or similar to others', and the one that stays.

    Similar labels are joined transitively. Of a group the shortest key stays, then the smallest. A node that stays names itself.
    """
    n = checkpoint(nodes.select(F.col(key).alias("k"), normal_label(F.col(label)).alias("rotulo")).where("k IS NOT NULL AND rotulo <> ''").distinct())
    # pairs grow with the square of the labels, those that connect them do not; exact pairs are compared already
    sim = label_pairs(n, "rotulo", threshold, exact=True, spanning=True) if exact else similar_labels(n, "rotulo", threshold)
    group = components(sim.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    g = n.join(group.withColumnRenamed("node", "rotulo"), "rotulo", "left").select("k", F.coalesce("component", "rotulo").alias("g"))
    best = g.groupBy("g").agg(F.min(F.struct(F.length(F.col("k").cast("string")).alias("n"), F.col("k").alias("k"))).alias("m"), F.count("*").alias("c")).where("c > 1")
    return g.join(best, "g").select(F.col("k").alias(key), F.col("m.k").alias("sobrevivente"))


def remap_edges(edges: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """Edges between survivors: ends replaced, self-loops made by merging and null ends dropped, repeats once."""
    s = survivors.select(F.col(key).alias("__k"), F.col("sobrevivente").alias("__s"))
    for end in ("source", "target"):
        edges = edges.join(s, F.col(end) == F.col("__k"), "left").withColumn(f"__was_{end}", F.col(end)).withColumn(end, F.coalesce("__s", end)).drop("__k", "__s")
    kept = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull() & ((F.col("source") != F.col("target")) | (F.col("__was_source") == F.col("__was_target"))))
    return kept.drop("__was_source", "__was_target").distinct()
