"""Splitting oversized texts at natural boundaries.

Method: lexical-cohesion segmentation. Between the sentences of a text, the words of a sliding block before and after
each gap are compared; valleys of that similarity mark topic boundaries. Each piece ends at the deepest valley of its size
window and the next one repeats the overlap before it. Sentences, lines, blanks serve in this order where the window
has nothing better; only a stretch without any blank is cut by force.

One text is one unit of work: texts are cut independently, in Arrow batches, in time linear in their length; texts
under the limit stay in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3072, 200
NATURAL, FORCED = "natural", "forcado"
_BLANK = " \t\r\n"
_GAP = re.compile(r"[.!?…。！？:;]+[\"'”’»)\]]*[ \t\r\n]+|[\r\n]+[ \t\r\n]*|\Z")
_WORD = re.compile(r"\w+")


def cohesion_gaps(text: str, block: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Positions after each sentence or line, and the depth of the similarity valley there (0 to 2).

    Similarity of a gap: cosine of the word counts of the ``block`` sentences before and after it, kept up by
    adding and removing one sentence a step. Depth: how far similarity rises to the nearest peaks on both sides.
    """
    ends = [m.end() for m in _GAP.finditer(text)]
    ends = [e for i, e in enumerate(ends) if e and (i == 0 or e > ends[i - 1])]
    starts = [0, *ends[:-1]]
    bags = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip(starts, ends)]
    n = len(ends)
    sims = np.ones(n)
    left: Counter = Counter()
    right: Counter = Counter()
    ll = rr = lr = 0
    for b in bags[:block]:
        right.update(b)
    rr = sum(v * v for v in right.values())
    for i in range(n - 1):
        for w, c in bags[i].items():  # sentence i moves from right to left
            x, y = left[w], right[w]
            ll += (x + c) ** 2 - x * x
            rr += (y - c) ** 2 - y * y
            lr += (x + c) * (y - c) - x * y
            left[w], right[w] = x + c, y - c
        if i - block >= 0:
            for w, c in bags[i - block].items():
                x, y = left[w], right[w]
                ll += (x - c) ** 2 - x * x
                lr += (x - c) * y - x * y
                left[w] = x - c
        if i + block < n:
            for w, c in bags[i + block].items():
                x, y = left[w], right[w]
                rr += (y + c) ** 2 - y * y
                lr += x * (y + c) - x * y
                right[w] = y + c
        sims[i] = lr / (ll * rr) ** 0.5 if ll > 0 and rr > 0 else 0.0
    up_left, up_right = sims.copy(), sims.copy()
    for i in range(1, n):  # the nearest peak: climb while similarity rises
        if sims[i - 1] >= sims[i]:
            up_left[i] = up_left[i - 1]
    for i in range(n - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            up_right[i] = up_right[i + 1]
    return np.array(ends, dtype=np.int64), (up_left - sims) + (up_right - sims)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: float = 0.5) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each piece in code points; the last piece is natural.

    Pieces hold at most ``limit`` characters and cover the text in order. The next piece starts ``overlap`` before
    the end of the last one, later only if the next natural boundary is else out of reach. A cut is forced exactly
    where a stretch longer than ``limit`` holds no blank. The deepest valley is sought in the part of the window
    beyond ``least`` of the limit, so pieces do not become needlessly many.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, NATURAL)]
    gaps, depth = cohesion_gaps(text)
    blank = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = np.isin(blank, [ord(c) for c in _BLANK])
    edge = np.flatnonzero(blank[1:] | blank[:-1]) + 1  # beside a blank, before or after it
    out: list[tuple[int, int, str]] = []
    start = done = 0
    while True:
        if n - start <= limit:
            out.append((start, n, NATURAL))
            return out
        low, high = done, start + limit
        a, b = np.searchsorted(gaps, [max(low + 1, start + int(limit * least)), high + 1])
        b = min(b, np.searchsorted(gaps, n))
        if a >= b:
            a = np.searchsorted(gaps, low + 1)
        if a < b:
            best = int(gaps[a:b][np.flatnonzero(depth[a:b] == depth[a:b].max())[-1]])
            kind = NATURAL
        else:
            a, b = np.searchsorted(edge, [low + 1, high + 1])
            if a < b:
                best, kind = int(edge[b - 1]), NATURAL
            elif b < len(edge) and edge[b] - done <= limit or n - done <= limit:
                far = int(edge[b]) if b < len(edge) else n
                start = max(start, far - limit)  # less overlap, so that the boundary comes within reach
                if far == n:
                    continue
                best, kind = far, NATURAL
            else:
                best, kind = high, FORCED
        out.append((start, best, kind))
        start, done = max(best - overlap, start + 1), best


def split_texts(df: DataFrame, key: str, name: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, parte_id, parte, inicio, fim, repete, corte, texto)``: the pieces of each row.

    ``parte_id`` is ``<name>::parte_<n>``, or ``<name>`` itself for a text in one piece (the key stands in for a null
    name). ``inicio`` and ``fim`` are code points, ``repete`` how many characters the piece repeats. ``corte`` tells how
    the piece ends. Null and empty texts have one piece of null or empty text. Repeated rows give repeated pieces;
    other columns, whatever their names, are not carried.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    base = df.select(F.col(key).alias("chave"), F.coalesce(F.col(name).cast("string"), F.col(key).cast("string")).alias("nome"), F.col(text).alias("texto"))
    size = F.length("texto")
    whole = base.where(size.isNull() | (size <= limit)).select(
        "chave", F.col("nome").alias("parte_id"), F.lit(0).alias("parte"), F.lit(0).alias("inicio"), F.coalesce(F.length("texto"), F.lit(0)).alias("fim"), F.lit(0).alias("repete"), F.lit(NATURAL).alias("corte"), "texto"
    )
    kind = base.schema["chave"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "parte_id", "parte", "inicio", "fim", "repete", "corte", "texto")}
            for r, (who, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                seen = 0
                for i, (a, b, how) in enumerate(cuts(t, limit, overlap)):
                    for k, v in (("row", r), ("parte_id", f"{who}::parte_{i}"), ("parte", i), ("inicio", a), ("fim", b), ("repete", max(0, seen - a)), ("corte", how), ("texto", t[a:b])):
                        out[k].append(v)
                    seen = b
            rows = pa.array(out.pop("row"), pa.int64())
            cols = [batch.column(0).take(rows)] + [pa.array(v, pa.int32() if k in ("parte", "inicio", "fim", "repete") else pa.string()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays(cols, ["chave", *out])

    long = base.where(size > limit).mapInArrow(run, f"chave {kind}, parte_id string, parte int, inicio int, fim int, repete int, corte string, texto string")
    return whole.unionByName(long)


def oversized(pieces: DataFrame) -> DataFrame:
    """``(chave, corte)`` of the texts that came out in several pieces: forced if any cut was."""
    several = pieces.where((F.col("parte") > 0) | (F.col("corte") == FORCED))
    return several.groupBy("chave").agg(F.when(F.max(F.col("corte") == FORCED), FORCED).otherwise(NATURAL).alias("corte"))


def rejoined(pieces: DataFrame) -> DataFrame:
    """``(chave, texto)``: each text put together again from its pieces, without what they repeat; null stays null.

    What is gathered for a row is its own text, once.
    """
    fresh = F.struct("parte", F.substring("texto", F.col("repete") + 1, F.length("texto")).alias("t"))
    g = pieces.groupBy("chave", F.regexp_replace("parte_id", "::parte_[0-9]+$", "").alias("nome")).agg(F.sort_array(F.collect_list(fresh)).alias("p"), F.count_if(F.col("texto").isNull()).alias("vazias"))
    return g.select("chave", F.when(F.col("vazias") == 0, F.array_join(F.col("p.t"), "")).alias("texto"))
