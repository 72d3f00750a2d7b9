"""Helper columns that never clash with a caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as no table has a column of that name, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
