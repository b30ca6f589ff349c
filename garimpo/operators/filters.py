"""Predicates over free JSON metadata, texts and paths, compiled to columns that Catalyst can push and fold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


class JsonField:
    """One key of a JSON text with its type: numbers, texts and booleans are never equal to each other."""

    def __init__(self, meta: Column, key: str) -> None:
        path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        self.value = F.try_variant_get(F.try_parse_json(meta), path, "variant")
        self.kind = F.schema_of_variant(self.value)

    def equals(self, v: Any) -> Column:
        if isinstance(v, bool):
            same = (self.kind == "BOOLEAN") & (F.try_variant_get(self.value, "$", "boolean") == F.lit(v))
        elif isinstance(v, (int, float)):
            same = self.number() == F.lit(float(v))
        elif isinstance(v, str):
            same = (self.kind == "STRING") & (F.try_variant_get(self.value, "$", "string") == F.lit(v))
        else:
            same = F.lit(False)
        return F.coalesce(same, F.lit(False))

    def number(self) -> Column:
        numeric = self.kind.isin(*_NUMERIC) | self.kind.startswith("DECIMAL")
        return F.when(numeric, F.try_variant_get(self.value, "$", "double"))


def _bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compile_where(where: dict | None, field: Callable[[str], JsonField]) -> Column:
    """The filter language ``{key: value}``, ``{key: {$op: value}}``, ``{$and|$or: [...]}`` as one column, never null.

    ``$ne`` and ``$nin`` hold where the key is missing; ``$gt $gte $lt $lte`` hold between numbers only. Exactly one
    key and one operator a level, else ValueError.
    """
    if where is None or where == {}:
        return F.lit(True)
    if len(where) != 1:
        raise ValueError("one key a level; join several with $and")
    (key, cond), = where.items()
    if key in ("$and", "$or"):
        if not isinstance(cond, list) or not cond:
            raise ValueError(f"{key} needs a list that is not empty")
        return reduce(and_ if key == "$and" else or_, [compile_where(w, field) for w in cond])
    f = field(key)
    if not isinstance(cond, dict):
        return f.equals(cond)
    if len(cond) != 1:
        raise ValueError("one operator a key")
    (op, v), = cond.items()
    if op == "$eq":
        return f.equals(v)
    if op == "$ne":
        return ~f.equals(v)
    if op in ("$in", "$nin"):
        any_of = reduce(or_, [f.equals(x) for x in v], F.lit(False))
        return any_of if op == "$in" else ~any_of
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return F.lit(False)
        n, w = f.number(), F.lit(float(v))
        return _bool({"$gt": n > w, "$gte": n >= w, "$lt": n < w, "$lte": n <= w}[op])
    raise ValueError(f"unknown operator {op}")


def where_json(where: dict | None, meta: Column) -> Column:
    return compile_where(where, lambda k: JsonField(meta, k))


def where_document(where: dict | None, doc: Column) -> Column:
    """``$contains``, ``$not_contains``, ``$and``, ``$or``: case-sensitive; a null text contains nothing."""
    if where is None or where == {}:
        return F.lit(True)
    (key, v), = where.items()
    if key in ("$and", "$or"):
        return reduce(and_ if key == "$and" else or_, [where_document(w, doc) for w in v])
    if key == "$contains":
        return _bool(doc.contains(F.lit(v)))
    if key == "$not_contains":
        return ~_bool(doc.contains(F.lit(v)))
    raise ValueError(f"unknown operator {key}")


def scope(name: str) -> dict | None:
    """The filter of a search scope; generated notes are left out of ``notes+external``, rows without a kind are not."""
    return {"all": None, "external": {"is_external": "true"}, "notes": {"kind": "note"}, "generated": {"kind": "generated"}, "notes+external": {"kind": {"$ne": "generated"}}}[name]


def date_facet(path: Column, front: Column | None = None, modified: Column | None = None) -> Column:
    """The date of a note as text: in its file name, else its head, else its modification."""
    named = F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(named, *[c for c in (front, F.date_format(modified, "yyyy-MM-dd") if modified is not None else None) if c is not None])


def without_substance(text: Column, pages: Column | None = None) -> Column:
    """Under 200 characters in all, or under 40 a page."""
    n = F.coalesce(F.length(F.trim(text)), F.lit(0))
    return (n < 200) if pages is None else (n < 200) | (n < 40 * pages)
