"""Column functions on text: keys, folding, blanks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters trimmed as outer blanks.
BLANKS = " \t\r\n"


def outer_trim(c: Column, chars: str = BLANKS) -> Column:
    """``c`` without any of ``chars`` at both ends; null stays null."""
    return F.btrim(c, F.lit(chars))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


@F.pandas_udf(T.StringType())
def _key_udf(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        t = "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)).lower()
        return re.sub(r"[^a-z0-9.]+", "_", t).strip("_.")

    return s.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)), na_action="ignore")


def grouping_key(c: Column) -> Column:
    """Accent- and case-free key: NFKD without combining marks, lower case, other runs made ``_``, trimmed of ``_.``.

    ASCII values never leave the JVM; the Arrow function gets null for them. Null stays null, a value
    of nothing but separators becomes the empty text.
    """
    plain = F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9.]+", "_"), F.lit("_."))
    return F.coalesce(_key_udf(F.when(~is_ascii(c), c)), plain)


def fold(c: Column) -> Column:
    """Text without combining marks after compatibility decomposition; ASCII stays in the JVM."""
    return F.coalesce(_fold_udf(F.when(~is_ascii(c), c)), c)


def _latin() -> tuple[str, str]:
    """Precomposed Latin letters and what they fold to; combining marks, which fold to nothing, come last."""
    pairs = []
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(i):
            pairs.append((chr(i), base))
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


_FROM, _TO = _latin()


def fold_latin(c: Column) -> Column:
    """Latin letters without their marks, by one table in the JVM; other scripts stay as they are."""
    return F.translate(c, _FROM, _TO)


@F.pandas_udf(T.StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def casefolded(c: Column) -> Column:
    """Compatibility-composed text without case; ASCII stays in the JVM."""
    return F.coalesce(_nfkc_udf(F.when(~is_ascii(c), c)), F.lower(c))
