"""Reading JSON through variant columns: one parse, typed access, and null told apart from missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(v: Column, path: str) -> Column:
    """The value at ``path`` as a variant; SQL null where it is missing."""
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str) -> Column:
    """The value at ``path`` as text; SQL null where it is missing or JSON null."""
    return F.try_variant_get(v, path, "string")


def is_present(v: Column, path: str) -> Column:
    return part(v, path).isNotNull()


def is_json_null(v: Column) -> Column:
    return F.coalesce(F.is_variant_null(v), F.lit(False))


def is_object(v: Column, path: str = "$") -> Column:
    """Whether there is an object at ``path``; asking for one field of it spares reading the rest."""
    return F.try_variant_get(v, path, "struct<_:variant>").isNotNull()


def is_filled_object(v: Column) -> Column:
    return F.coalesce(F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0, F.lit(False))


def json_text(v: Column) -> Column:
    return F.to_json(v)


def not_object(v: Column, path: str) -> Column:
    """Present, not null, and no object. The usual case, an object, is settled by the first test."""
    found = part(v, path)
    return ~is_object(v, path) & found.isNotNull() & ~is_json_null(found)


def null_or_not_object(v: Column, path: str) -> Column:
    """Present, but null or no object."""
    return ~is_object(v, path) & part(v, path).isNotNull()
