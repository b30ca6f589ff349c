"""The most similar vectors for every vector.

Method: additive quantisation. A vector is approximated by a sum of one entry from each of several full-dimensional
codebooks, trained on residuals and chosen by beam search; the norm of the sum is stored beside the codes. The
first two books also name the cell a vector lies in. Every vector goes with its full precision to its own cell as a query,
and with its codes of a few bytes to the cells nearest to it as a candidate. Queries score candidates by table
lookups; the best are compared exactly. Without a limit on exact comparisons, the candidates go with full precision too, and a query
is compared exactly with all that reach its cell; cells are larger then, and the cells a candidate goes to grow with their number.

Books are fitted on a bounded sample of each collection (``FIT`` vectors); every vector is indexed and every
vector is a query. Equal vectors form one class and are indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.runtime import checkpoint

#: Vectors of a collection that the books are fitted on, at most (in expectation of a hash sample).
FIT = 16_384
#: Books after the two of the cell, entries of each, beams of the encoding.
BOOKS, ENTRIES, BEAMS = 8, 64, 4
#: Vectors a cell should hold, cells a vector is a candidate in, first books' entries looked into for them at least.
CELL, PROBES, FIRST = 256, 10, 10
#: The same two where all candidates of a cell are compared exactly; at least so many cells, and as many as the root of their number.
WIDE_CELL, LEAST_PROBES = 4096, 8
#: Candidates of a query that are compared exactly.
RERANK = 32
#: Queries of one cell that one task takes at a time; a larger cell is cut into blocks of queries.
BLOCK = 8192
#: Bytes of books, and of the vectors they are fitted on, in one pass over the vectors; more collections take more passes.
MODEL_BYTES, SAMPLE_BYTES = 48 << 20, 256 << 20
#: Most collections; one row of each is read on the driver.
MAX_COLLECTIONS = 100_000
#: Distances that are held at once when cells are looked for.
HELD = 4_000_000
#: Most rows of keys that are broadcast; beyond it the join shuffles.
SMALL = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Centers of ``x``; as many as there are rows if these are fewer."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        a = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


@dataclass
class Books:
    """Codebooks of one collection; the first two are those of the cell."""

    books: list[np.ndarray]
    #: Cosine between a vector and its approximation that nearly all vectors of the sample reach.
    worst: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, depth: int = BOOKS, seed: int = 1) -> Books:
        rng = np.random.default_rng(seed)
        side = max(1, round(cells**0.5))
        rest, books = x.astype(np.float32), []
        for k in [side, side, *[ENTRIES] * depth]:
            c = kmeans(rest, k, rng)
            rest = rest - c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)]
            books.append(c.astype(np.float32))
        own = cls(books)
        _, codes, norm = own.encode(x)
        own.worst = float(np.quantile((own.decode(codes) * x).sum(1) / np.maximum(norm, 1e-9), 0.01))
        return own

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[codes[:, m]] for m, b in enumerate(self.books))

    def step(self, most: int) -> int:
        """Vectors to look for the cells of at a time: fewer, the more cells there are, so that the distances to them stay bounded."""
        first = max(FIRST, LEAST_PROBES, len(self.books[0])) if len(self.books) == 2 else FIRST
        return max(1, min(most, HELD // (first * len(self.books[1]))))

    def cells_of(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the cells nearest to each vector, the nearest first; -1 where there are fewer."""
        a, b = self.books[:2]
        first = min(max(FIRST, probes), len(a))
        da = (a * a).sum(1) - 2 * x @ a.T
        top = np.argpartition(da, first - 1, axis=1)[:, :first]
        db = (b * b).sum(1) - 2 * x @ b.T
        d = np.take_along_axis(da, top, 1)[:, :, None] + db[:, None, :] + 2 * (a @ b.T)[top]
        d = d.reshape(len(x), -1)
        p = min(probes, d.shape[1])
        best = np.argpartition(d, p - 1, axis=1)[:, :p]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
        cell = np.take_along_axis(top, best // len(b), 1) * len(b) + best % len(b)
        return np.pad(cell, ((0, 0), (0, probes - p)), constant_values=-1)

    def encode(self, x: np.ndarray, beams: int = BEAMS, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes (n, books) and norms of the approximations. Beam search over the books after the cell."""
        cells = self.cells_of(x, probes)
        n, side = len(x), len(self.books[1])
        head = np.stack([cells[:, 0] // side, cells[:, 0] % side], axis=1)
        rest = (x - self.books[0][head[:, 0]] - self.books[1][head[:, 1]])[:, None, :]
        codes = head[:, None, :]
        for book in self.books[2:]:
            w = rest.shape[1]
            d = ((rest * rest).sum(2))[:, :, None] + (book * book).sum(1) - 2 * (rest.reshape(n * w, -1) @ book.T).reshape(n, w, -1)
            d = d.reshape(n, -1)
            k = min(beams, d.shape[1])
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            beam, entry = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, beam[:, :, None], 1) - book[entry]
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), entry[:, :, None]], axis=2)
        win = np.argmin((rest * rest).sum(2), axis=1)
        codes = codes[np.arange(n), win].astype(np.uint16)
        return cells, codes, np.linalg.norm(self.decode(codes), axis=1).astype(np.float32)

    def score(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines (candidates, queries): sums of table entries over the stored norm."""
        out = np.zeros((len(codes), len(queries)), np.float32)
        for m, b in enumerate(self.books):
            out += (b @ queries.T)[codes[:, m]]
        return out / np.maximum(norms, 1e-9)[:, None]


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(df: DataFrame, col: str, key: str, vec: str) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """``(col, r, vec)`` of the usable vectors, and (collection, length, usable count or less) of each collection.

    Usable: as long as most vectors of the collection (the longer of equally frequent lengths), without nulls, NaN or
    infinities, not all zero. Rows of null collection or key are in no collection.
    """
    size = F.size(vec)
    src = df.select(F.col(col).alias("col"), F.col(key).cast("long").alias("r"), F.col(vec).cast("array<float>").alias("vec")).where(F.col("col").isNotNull() & F.col("r").isNotNull() & (F.size("vec") > 0))
    lengths = src.groupBy("col", F.size("vec").alias("len")).agg(F.count("*").alias("n"))
    usual = lengths.groupBy("col").agg(F.max(F.struct("n", "len")).alias("m")).select("col", "m.len", "m.n")
    cols = [(r["col"], r["len"], r["n"]) for r in usual.orderBy("col").limit(MAX_COLLECTIONS + 1).collect()]
    if len(cols) > MAX_COLLECTIONS:
        raise ValueError(f"more than {MAX_COLLECTIONS} collections: run them in several calls")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sizes = src.sparkSession.createDataFrame(cols or [("", 0, 0)], "col string, len int, n long").select("col", "len")
    return src.join(_small(sizes), "col").where((F.size("vec") == F.col("len")) & fine).select("col", "r", "vec"), cols


def _index(books: list[Books], probes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rep = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for c in np.unique(ids):
                at = np.flatnonzero(ids == c)
                step = books[c].step(2000)
                for i in range(0, len(at), step):
                    part = at[i : i + step]
                    x = _unit(np.asarray(batch.column(2).take(pa.array(part)).flatten()), len(part))
                    cells, codes, norms = books[c].encode(x, probes=probes)
                    hit = np.argwhere(cells >= 0)
                    g = np.r_[cells[:, 0], cells[hit[:, 0], hit[:, 1]]] | (int(c) << 40)
                    n, who = len(part), np.r_[np.arange(len(part)), hit[:, 0]]
                    query = np.arange(len(who)) < n
                    code = [b.tobytes() for b in codes]
                    full = [b.tobytes() for b in x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g), pa.array(query), pa.array(rep[part][who]), pa.array([None] * n + [code[w] for w in who[n:]], pa.binary()), pa.array(norms[who]), pa.array(full + [None] * (len(who) - n), pa.binary())],
                        ["g", "query", "r", "code", "norm", "unit"],
                    )

    return run


def _index_whole(books: list[Books], probes: int | None):  # noqa: ANN202
    """``(g, query, r, vec)``: every vector as a query in its own cell, as a candidate in the cells nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for c in np.unique(ids):
                at = np.flatnonzero(ids == c)
                step = books[c].step(1000)
                for i in range(0, len(at), step):
                    part = pa.array(at[i : i + step])
                    vec = batch.column(2).take(part)
                    x = _unit(np.asarray(vec.flatten()), len(part))
                    cells = books[c].cells_of(x, grown(books[c]) if probes is None else probes)
                    hit = np.argwhere(cells >= 0)
                    g = np.r_[cells[:, 0], cells[hit[:, 0], hit[:, 1]]].astype(np.int64) | (int(c) << 40)
                    who = pa.array(np.r_[np.arange(len(part)), hit[:, 0]])
                    full = pa.array([v.tobytes() for v in np.asarray(vec.flatten()).astype(np.float32).reshape(len(part), -1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.arange(len(g)) < len(part)), batch.column(1).take(part).take(who), full.take(who)], ["g", "query", "r", "vec"])

    return run


def grown(b: Books) -> int:
    """Cells a vector is a candidate in, growing with the cells of its collection."""
    return max(LEAST_PROBES, len(b.books[0]))


def _search_whole(best: int):  # noqa: ANN202
    """Streams rows sorted by cell, queries before candidates: the ``best`` candidates of each query with their cosine.

    The queries of a block are held, candidates pass by a batch at a time.
    """

    def merge(q: dict, x: np.ndarray, cr: np.ndarray) -> None:
        u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        step = max(1, min(512, 4_000_000 // len(cr)))
        for i in range(0, len(q["r"]), step):
            z = slice(i, i + step)
            s = q["u"][z] @ u.T
            s[q["r"][z, None] == cr[None, :]] = -9
            k = min(best, len(cr))
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(cr) else np.tile(np.arange(k), (len(s), 1))
            cos = np.einsum("qd,qkd->qk", q["x"][z], x[top])
            cos[np.take_along_axis(s, top, 1) == -9] = -9
            cos, who = np.concatenate([q["cos"][z], cos], axis=1), np.concatenate([q["who"][z], cr[top]], axis=1)
            keep = np.argpartition(-cos, best - 1, axis=1)[:, :best]
            q["cos"][z], q["who"][z] = np.take_along_axis(cos, keep, 1), np.take_along_axis(who, keep, 1)

    def found(q: dict) -> pa.RecordBatch:
        a, b, cos = np.repeat(q["r"], best), q["who"].reshape(-1), q["cos"].reshape(-1)
        ok = cos > -9
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(cos[ok])], ["a", "b", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, q = None, [], None
        for batch in batches:
            g, salt, query, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = np.flatnonzero((g[1:] != g[:-1]) | (salt[1:] != salt[:-1]) | (query[1:] != query[:-1])) + 1
            for a, z in zip(map(int, np.r_[0, cut]), map(int, np.r_[cut, len(g)])):
                if (here := (int(g[a]), int(salt[a]))) != cell:
                    if q is not None:
                        yield found(q)
                    cell, held, q = here, [], None
                x = np.frombuffer(b"".join(batch.column(4).slice(a, z - a).to_pylist()), np.float32).reshape(z - a, -1).astype(np.float64)
                if query[a]:
                    held.append((r[a:z].copy(), x / np.linalg.norm(x, axis=1, keepdims=True)))
                    continue
                if held:
                    qr, qx = (np.concatenate(v) for v in zip(*held))
                    q, held = {"r": qr, "x": qx, "u": qx.astype(np.float32), "cos": np.full((len(qr), best), -9.0), "who": np.zeros((len(qr), best), np.int64)}, []
                if q is not None:
                    merge(q, x, r[a:z])
        if q is not None:
            yield found(q)

    return run


def _search(books: list[Books], least: float | None, rerank: int):  # noqa: ANN202
    """Streams rows sorted by cell, candidates before queries: the best candidates of each query."""

    def best(b: Books, q: np.ndarray, qr: np.ndarray, codes: np.ndarray, norms: np.ndarray, cr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = b.score(q, codes, norms)
        s[cr[:, None] == qr[None, :]] = -9
        k = min(rerank, len(cr) - 1)
        if k < 1:
            return qr[:0], cr[:0]
        floor = -2.0 if least is None else least * b.worst - 0.1
        if least is not None:
            c, i = np.nonzero(s >= floor)
            v = s[c, i]
            order = np.lexsort((-v, i))
            c, i = c[order], i[order]
            start = np.searchsorted(i, np.arange(len(qr)))
            keep = np.arange(len(i)) - start[i] < rerank
            return qr[i[keep]], cr[c[keep]]
        top = np.argpartition(-s, k - 1, axis=0)[:k]
        return np.tile(qr, k), cr[top.reshape(-1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None
        for batch in batches:
            g, salt, query, r, norm = (np.asarray(batch.column(i)) if i != 2 else batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
            cut = np.flatnonzero((g[1:] != g[:-1]) | (salt[1:] != salt[:-1]) | (query[1:] != query[:-1])) + 1
            qs, cs = [], []
            for a, z in zip(np.r_[0, cut], np.r_[cut, len(g)]):
                a, z = int(a), int(z)
                here = (int(g[a]), int(salt[a]))
                if here != cell:
                    cell, held, ready = here, [], None
                b = books[here[0] >> 40]
                if not query[a]:
                    codes = np.frombuffer(b"".join(batch.column(4).slice(a, z - a).to_pylist()), np.uint16).reshape(z - a, -1)
                    held.append((codes, norm[a:z], r[a:z]))
                    continue
                if held:
                    ready, held = tuple(np.concatenate(x) for x in zip(*held)), []
                if ready is None:
                    continue
                x = np.frombuffer(b"".join(batch.column(6).slice(a, z - a).to_pylist()), np.float32).reshape(z - a, -1)
                step = max(1, min(256, 4_000_000 // len(ready[2])))
                for i in range(0, z - a, step):
                    found = best(b, x[i : i + step], r[a + i : a + min(i + step, z - a)], *ready)
                    qs.append(found[0]), cs.append(found[1])
            if qs:
                q, c = np.concatenate(qs), np.concatenate(cs)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(q, c)), pa.array(np.maximum(q, c))], ["a", "b"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        # both vectors of a pair are of one length, lengths differ between collections
        x, y = (np.asarray(b.column(i).flatten()).astype(np.float64) for i in (2, 3))
        starts = np.asarray(b.column(2).offsets)[:-1].astype(np.int64)
        starts = starts - starts[0]
        dot, xx, yy = (np.add.reduceat(v, starts) for v in (x * y, x * x, y * y))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dot / np.maximum(np.sqrt(xx) * np.sqrt(yy), 1e-300))], ["a", "b", "cos"])


def _blocks(rows: DataFrame, *values: str) -> DataFrame:
    """``rows`` with a number of the block; a cell of very many queries is cut into blocks, all its candidates go to each."""
    large = _small(checkpoint(rows.where("query").groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")))
    cut = rows.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    salts = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return cut.select("g", F.explode(salts).alias("salt"), "query", "r", *values)


def _compared(reps: DataFrame, books: list[Books], best: int, probes: int | None) -> DataFrame:
    """Pairs (a, b, cos): the ``best`` of all candidates of each query's cell; ``reps``: (c, r, vec)."""
    rows = reps.select("c", "r", "vec").mapInArrow(_index_whole(books, probes), "g bigint, query boolean, r bigint, vec binary")
    cut = _blocks(rows, "vec").repartition("g", "salt").sortWithinPartitions("g", "salt", F.desc("query"))
    return cut.mapInArrow(_search_whole(best), "a bigint, b bigint, cos double").groupBy("a", "b").agg(F.max("cos").alias("cos"))


def _candidates(reps: DataFrame, books: list[Books], least: float | None, rerank: int, probes: int) -> DataFrame:
    """Pairs (a, b) worth an exact comparison; ``reps``: (c, r, vec)."""
    rows = checkpoint(reps.select("c", "r", "vec").mapInArrow(_index(books, probes), "g bigint, query boolean, r bigint, code binary, norm float, unit binary"))
    cut = _blocks(rows, "code", "norm", "unit")
    return cut.repartition("g", "salt").sortWithinPartitions("g", "salt", "query").mapInArrow(_search(books, least, rerank), "a bigint, b bigint").distinct()


def neighbors(df: DataFrame, col: str, key: str, vec: str, k: int = 5, least: float | None = None, rerank: int | None = RERANK, cell: int = CELL, probes: int | None = PROBES, depth: int = BOOKS) -> DataFrame:
    """``(r, vizinho, cos, ordem)``: up to ``k`` most similar vectors of the same collection, for every usable vector.

    Ties go to the smaller key. With ``least`` only neighbors of at least that cosine come out, which spares the
    comparison of others. Equal vectors are each other's neighbors at cosine 1. Keys are unique over all collections.
    ``depth`` books after those of the cell, ``probes`` cells and ``rerank`` exact comparisons trade work for recall: without
    a threshold, finer codes and fewer comparisons are the cheaper way. With ``rerank`` None every candidate in a query's cell is compared
    exactly and codes are not used; only then ``probes`` may be None, to grow with the cells. Approximate: recall is measured in the tests. Empty tables, and collections of one vector, give no rows.
    """
    if probes is None and rerank is not None:
        raise ValueError("probes must be given with rerank")
    depth = 0 if rerank is None else depth
    rows, cols = usable(df, col, key, vec)
    spark = df.sparkSession
    hashed = rows.select("col", "r", F.xxhash64("vec").alias("h0"), F.xxhash64(F.lit(3), "vec").alias("h1"))
    classes = hashed.groupBy("col", "h0", "h1").agg(F.min("r").alias("rep"), F.count("*").alias("copies"))
    several = checkpoint(hashed.join(classes.where("copies > 1"), ["col", "h0", "h1"]).select("rep", "r").distinct())
    reps = rows.join(_small(several.where("r <> rep").select("r")), "r", "left_anti")
    at, passes = 0, []
    while at < len(cols):
        batch, cost, sample = [], 0, 0
        while at < len(cols) and (not batch or (cost < MODEL_BYTES and sample < SAMPLE_BYTES)):
            side = max(1, round((cols[at][2] / cell) ** 0.5))
            cost += 4 * cols[at][1] * (2 * side + depth * ENTRIES)
            sample += 4 * cols[at][1] * min(FIT, cols[at][2])
            batch.append(cols[at])
            at += 1
        named = spark.createDataFrame([(c, i, min(1.0, FIT / n)) for i, (c, _, n) in enumerate(batch)], "col string, c int, share double")
        own = reps.join(F.broadcast(named), "col")
        drawn = own.where(F.pmod(F.xxhash64(F.lit(11), "r"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("c", "vec").toPandas()
        books = []
        for i, (_, d, n) in enumerate(batch):
            x = drawn.vec[drawn.c == i]
            x = _unit(np.concatenate(x.to_list()), len(x)) if len(x) else np.ones((1, d), np.float32) / d**0.5
            books.append(Books.fit(x, max(1, round(n / cell)), depth))
        passes.append(checkpoint(_compared(own, books, 2 * k, probes) if rerank is None else _candidates(own, books, least, rerank, probes)))
    pairs = passes[0] if passes else spark.createDataFrame([], "a bigint, b bigint" + ", cos double" * (rerank is None))
    for p in passes[1:]:
        pairs = pairs.union(p)
    if rerank is None:
        exact = pairs
    else:
        need = checkpoint(pairs.select(F.col("a").alias("r")).union(pairs.select("b")).distinct())
        got = rows.join(_small(need), "r", "left_semi").select("r", "vec")
        both = pairs.join(got.select(F.col("r").alias("a"), F.col("vec").alias("x")), "a").join(got.select(F.col("r").alias("b"), F.col("vec").alias("y")), "b")
        exact = both.select("a", "b", "x", "y").mapInArrow(_exact, "a bigint, b bigint, cos double")
    if least is not None:
        exact = exact.where(F.col("cos") >= least)
    exact = checkpoint(exact)
    near = exact.union(exact.select("b", "a", "cos")).toDF("rep", "other", "cos")
    order = Window.partitionBy("rep").orderBy(F.desc("cos"), "other")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    if several.isEmpty():
        return near.withColumn("ordem", F.row_number().over(order)).select(F.col("rep").alias("r"), F.col("other").alias("vizinho"), "cos", "ordem")
    # copies: the first k + 1 rows of each class stand for it in lists; salted, so a class is never sorted whole
    first = several.withColumn("s", F.pmod(F.xxhash64("r"), F.lit(32)))
    for by in (["rep", "s"], ["rep"]):
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("r"))).where(F.col("n") <= k + 1)
    first = checkpoint(first.select("rep", "r"))
    stands = near.join(first.select(F.col("rep").alias("other"), F.col("r").alias("copy")), "other", "left")
    lists = stands.select("rep", F.coalesce("copy", "other").alias("v"), "cos").union(first.select("rep", "r", F.lit(1.0)))
    lists = lists.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cos"), "v"))).where(F.col("n") <= k + 1)
    lists = lists.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "v", "cos"))).alias("l"))
    every = lists.join(several, "rep", "left").select(F.coalesce("r", "rep").alias("r"), "l")
    every = every.select("r", F.slice(F.filter("l", lambda x: x["v"] != F.col("r")), 1, k).alias("l"))
    return every.select("r", F.posexplode("l").alias("p", "x")).select("r", F.col("x.v").alias("vizinho"), F.col("x.cos").alias("cos"), (F.col("p") + 1).alias("ordem"))
