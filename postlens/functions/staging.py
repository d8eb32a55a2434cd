"""Computing an expensive value once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator.

    The optimizer copies a projected expression into every filter that uses it, which would parse the same
    JSON many times per row. It does not do so across a generator, so what is pinned is computed once.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))
