"""Ordered aggregates over whole groups as folds, without a list for each group.

Rows are dealt and sorted by ranges of (group, order), whatever the sizes of groups. Within a range, runs of a
group's values are joined to one text each; these runs, a small fraction of the rows, are brought to their group's
task in order and folded there one after the other."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

#: Values that are joined to a run before groups are brought together.
RUN = 4096


def _runs(rows: DataFrame, group: list[str], order: list[str], value: str, sep: str) -> DataFrame:
    """(group, _first, _run): a group's values in order, joined in runs; ``_first`` is the order of a run's first value."""
    sorted_rows = rows.select(*group, *order, F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_run")).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order, "_run")
    place = StructType([rows.schema[c] for c in order])
    schema = StructType([*(rows.schema[c] for c in group), StructField("_first", place), StructField("_run", StringType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in b.to_pylist())
        for key, own in groupby(each, key=lambda r: tuple(r[c] for c in group)):
            while held := list(islice(own, RUN)):
                first = {c: held[0][c] for c in order}
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, first, sep.join(r["_run"] for r in held)), out, strict=True)], schema=out)

    return sorted_rows.mapInArrow(run, schema)


def _folded(rows: DataFrame, group: list[str], order: list[str], value: str, sep: str, name: str, fold: Callable[[Iterator[str]], str]) -> DataFrame:
    schema = StructType([*(rows.schema[c] for c in group), StructField(name, StringType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in b.to_pylist())
        for key, own in groupby(each, key=lambda r: tuple(r[c] for c in group)):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, fold(r["_run"] for r in own)), out, strict=True)], schema=out)

    return _runs(rows, group, order, value, sep).repartition(*group).sortWithinPartitions(*group, "_first").mapInArrow(run, schema)


def ordered_digest(rows: DataFrame, group: list[str], order: list[str], value: str, name: str = "digest") -> DataFrame:
    """One row per group: the SHA-256 of all its values, one behind the other in ``order``. Null values are empty, rows of
    equal order are taken by value, null group keys are a group. A group's task holds one run at a time."""

    def fold(runs: Iterator[str]) -> str:
        h = hashlib.sha256()
        for r in runs:
            h.update(r.encode())
        return h.hexdigest()

    return _folded(rows, group, order, value, "", name, fold)


def ordered_join(rows: DataFrame, group: list[str], order: list[str], value: str, sep: str = ",", name: str = "members") -> DataFrame:
    """One row per group: all its values in ``order``, joined by ``sep``. The row is as long as the group's values together,
    and that is all that is held."""
    return _folded(rows, group, order, value, sep, name, sep.join)
