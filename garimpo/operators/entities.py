"""Scores of labels for entity resolution: normal form, entropy, shingles, SimHash, Jaro-Winkler."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions.text import casefolded


def normal_label(c: Column) -> Column:
    """Compatibility form without case, runs other than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(casefolded(c), r"[^\p{L}\p{N}]+", " "))


def char_shingles(c: Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` characters without spaces; a shorter label itself."""
    t = F.replace(c, F.lit(" "))
    return F.when(F.length(t) <= k, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (k - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(k)))))


def entropy(c: Column) -> Column:
    """Shannon bits per character; 0 for empty labels."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    return F.when(n > 0, -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, x: s + (F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n))).otherwise(F.lit(0.0))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used, mine = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    swaps = sum(x != y for x, y in zip(mine, other)) // 2
    k = len(mine)
    return (k / n + k / m + (k - swaps) / k) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    s = jaro(a, b)
    if s <= 0.7:
        return s
    p = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        p += 1
    return s + 0.1 * p * (1 - s)


def jaro_batch(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Jaro similarities of pairs of labels, and how many of the first four letters are the same. All pairs advance together, a letter of
    ``a`` a round: each takes the first equal letter of ``b`` within reach that is still free."""
    n = len(a)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    wide_a, wide_b = max(4, int(la.max(initial=0))), max(4, int(lb.max(initial=0)))
    grid = lambda x, w: np.frombuffer("".join(t.ljust(w, "\0") for t in x).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, w)
    x, y = grid(a, wide_a), grid(b, wide_b)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    at = np.arange(wide_b)
    free = at[None, :] < lb[:, None]
    mine = np.zeros((n, wide_a), bool)
    rows = np.arange(n)
    for i in range(wide_a):
        ok = free & (y == x[:, i : i + 1]) & (np.abs(at[None, :] - i) <= reach[:, None]) & (i < la)[:, None]
        j = ok.argmax(axis=1)
        hit = ok[rows, j]
        mine[:, i] = hit
        free[rows[hit], j[hit]] = False
    used = (at[None, :] < lb[:, None]) & ~free
    m = mine.sum(axis=1)
    seq = np.zeros((2, n, max(wide_a, wide_b)), np.uint32)
    for k, (chars, mask) in enumerate(((x, mine), (y, used))):
        r, c = np.nonzero(mask)
        seq[k, r, (np.cumsum(mask, axis=1) - 1)[r, c]] = chars[r, c]
    swaps = (seq[0] != seq[1]).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    same = (x[:, :4] == y[:, :4]) & (x[:, :4] != 0)
    return s, np.cumprod(same, axis=1).sum(axis=1)


def _similarity(winkler: bool):  # noqa: ANN202
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        at = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        size = (a.str.len().fillna(0) + b.str.len().fillna(0)).to_numpy()
        at = at[np.argsort(size[at], kind="stable")]  # labels of like length together, so that little is padded
        i = 0
        while i < len(at):
            step = max(1, min(4096, 2_000_000 // max(16, int(size[at[min(len(at), i + 4096) - 1]]) ** 2)))
            part = at[i : i + step]
            s, p = jaro_batch(a.iloc[part].to_list(), b.iloc[part].to_list())
            out[part] = np.where(s > 0.7, s + 0.1 * p * (1 - s), s) if winkler else s
            i += step
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return F.pandas_udf(run, T.DoubleType())


#: Similarity of two labels, with and without the bonus for a common beginning; null if either is null.
jaro_winkler, jaro_similarity = _similarity(True), _similarity(False)


def simhash_of(text: str) -> int:
    """64 bits, each the strict majority over the MD5 prefixes of all runs of 4 characters of the lower-cased text."""
    text = text.lower()
    votes = np.zeros(64, np.int64)
    grams = [text[i : i + 4] for i in range(max(1, len(text) - 3))]
    raw = np.frombuffer(b"".join(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:8] for g in grams), dtype=np.uint8).reshape(-1, 8)
    votes = np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(grams)).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def simhash(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else simhash_of(x) for x in s], dtype="Int64")


def exact_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, primeiro)``: rows whose text stood in a row of smaller key, and that key."""
    h = df.where(F.col(text).isNotNull()).select(key, F.md5(text).alias("h"))
    first = h.groupBy("h").agg(F.min(key).alias("primeiro"), F.count("*").alias("n")).where("n > 1")
    return h.join(first, "h").where(F.col(key) != F.col("primeiro")).select(key, "primeiro")
