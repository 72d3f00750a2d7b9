"""Structured Streaming counterparts: dedup across batches, late data. Keyed state is in ``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.dedup_index import DedupIndex


def dedup_stream(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Drops rows whose keys were seen before; with an event time, state older than ``delay`` is forgotten."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, group: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """An extension: counts and sums by tumbling window; rows later than ``delay`` are dropped."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), group).agg(F.count(F.lit(1)).alias("n"))


def dedup_batches(stream: DataFrame, index: DedupIndex, kept_path: str) -> DataStreamWriter:
    """A writer that sends each batch through all dedup layers, fuzzy ones too, against what the layers of ``index`` remember of
    earlier batches, and writes the survivors to a folder of the batch, which replaces them if the batch is run again."""

    def each(batch: DataFrame, number: int) -> None:
        index.add(batch, number).write.mode("overwrite").parquet(f"{kept_path}/batch={number}")

    return stream.writeStream.foreachBatch(each)
