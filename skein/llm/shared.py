"""Shared folders, checkpoints and Arrow plumbing for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch between the JVM and Python, so that long texts can't fill a worker.
BATCH_ROWS, BATCH_BYTES = 2000, "32m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; from here on Arrow batches of the session are kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def make_room() -> None:
    """Gives back memory that this process no longer needs. A worker serves one operator after the
    other: at its start an operator drops the tokenizers that an earlier one kept."""
    if tokenizing := sys.modules.get("skein.llm.tokenizing"):
        tokenizing.forget()
    if words := sys.modules.get("skein.llm.words"):
        words.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def roomy(fn: Callable) -> Callable:
    """``fn`` over a task's batches, with memory given back before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        yield from fn(batches)
        make_room()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint
    folder. Where neither is set, a local session gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: its lineage ends there."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what :func:`materialise` wrote, once nothing will read it again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as no table has a column of that name."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so extra or clashing ones never matter."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def arrow_schema(ddl: str) -> pa.Schema:
    """A schema as Arrow has it."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A task's rows one by one."""
    for b in batches:
        yield from b.to_pylist()


def chunks_of(rows: Iterable[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``most``."""
    rows = iter(rows)
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
