"""Token ids as ORC files: run-length encoded id lists, row indexes and Bloom filters on the document id.

Documents are dealt by ranges of their id, so each file covers its own range and the stripes in it
ascend: stripes are read in parallel, and an id lookup skips files, stripes and row groups by their
minima, maxima and Bloom filters. Each row stores its token count, its file's number and its start
in that file; global starts follow from one total per file."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import id_and_text
from .tokenizing import AT_ONCE, chunk_tokenizer, with_end
from .words import slices

def _schema(kind: str) -> str:
    return f"doc_id {kind}, file_no int, file_start long, n_tokens long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, row_index_stride: int = 1000, bloom_fpp: float = 0.01, compression: str = "zstd") -> None:
    """Writes each whole text's ids and ``end_id`` to ORC files under ``path``, ascending by document id.

    Null or empty text: only the end id. Null ids come first. Rows of equal id are ordered by a hash
    of their text, and a hot id is dealt over several files by it. An empty table writes no rows.
    Other columns are not read."""
    h = F.xxhash64("text")
    rows = id_and_text(docs, id_col, text_col).repartitionByRange(F.col("doc_id"), h).sortWithinPartitions(F.col("doc_id"), h)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, file_no, start = chunk_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j in slices(batch.column("text"), AT_ONCE, batch.num_rows):
                ids, at = with_end(*tokenizer.encode(batch.column("text").slice(i, j - i)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.full(j - i, file_no, np.int32)), pa.array(start + at[:-1]), pa.array(np.diff(at)), lists], ["doc_id", "file_no", "file_start", "n_tokens", "ids"])
                start += int(at[-1])

    options = {"orc.stripe.size": stripe_bytes, "orc.create.index": True, "orc.row.index.stride": row_index_stride, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": bloom_fpp, "compression": compression}
    rows.mapInArrow(encode, _schema(rows.schema["doc_id"].dataType.simpleString())).write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents, by metadata pruning."""
    return read_token_orc(spark, path).filter(F.col("doc_id").isin(doc_ids))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """The number of ids in all files before each: one row per file, from two small columns."""
    totals = read_token_orc(spark, path).groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: its global start, token count and the crc32 of its little-endian ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy().astype(np.int64) * 4
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = np.diff(at) // 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file_no"), b.column("file_start"), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "file_no", "file_start", "n_tokens", "ids_crc32"])

    rows = read_token_orc(spark, path).select("doc_id", "file_no", "file_start", "ids")
    rows = rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, file_no int, file_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(file_starts(spark, path)), "file_no").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
