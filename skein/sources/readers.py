"""Readers and writers: JSON documents with defaults, source trees, key-value snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.state import empty_manifest, update_manifest


def json_or_default(texts: DataFrame, column: str, schema: str, default: Column) -> DataFrame:
    """Parses a column of JSON; what doesn't parse becomes ``default``, and ``is_corrupt`` says so."""
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = texts.withColumn("_p", parsed)
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    names = [f.name for f in full.fields[:-1]]
    good = F.struct(*[F.col(f"_p.{n}").alias(n) for n in names])
    return rows.withColumn("parsed", F.when(bad, default).otherwise(good)).withColumn("is_corrupt", bad).drop("_p")


def source_files(spark: SparkSession, root: str, suffixes: list[str], skip_dirs: list[str]) -> DataFrame:
    """path, length, mtime, content of the files under ``root`` by suffix, without those below skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}").load(root)
    skip = F.lit(False)
    for d in skip_dirs:
        skip = skip | F.contains("path", F.lit(f"/{d}/"))
    return files.filter(~skip).select("path", "length", F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("content"))


def fingerprint(content: Column, length: Column, mtime: Column) -> Column:
    """sha256 of the first 4096 bytes, the length and the time of change."""
    return F.sha2(F.concat(F.substring(content.cast("binary"), 1, 4096), length.cast("string").cast("binary"), mtime.cast("string").cast("binary")), 256)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The union of both, where a key of ``new`` replaces that of ``old``; ``new`` has one row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_kv(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes a key-value snapshot as a new version beside the old ones (readers take the last)."""
    rows.write.mode("append").partitionBy("version").parquet(path)


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == last)


def step_manifest(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Brings a manifest kept under ``path`` up to the files, as a new version beside the old ones, and gives its changes.
    Versions stay, so a run that dies leaves the last whole one: the modules, which are written last, tell which it is."""
    try:
        number = spark.read.parquet(f"{path}/modules").agg(F.max("version")).first()[0]
    except AnalysisException:  # nothing has been written yet
        number = None
    old = empty_manifest(spark) if number is None else tuple(spark.read.parquet(f"{path}/{part}").filter(F.col("version") == number).drop("version") for part in ("modules", "sources"))
    made = dict(zip(("modules", "sources", "changes"), update_manifest(*old, files), strict=True))
    version = 0 if number is None else number + 1
    for part in ("changes", "sources", "modules"):
        made[part].write.mode("overwrite").parquet(f"{path}/{part}/version={version}")
    return spark.read.parquet(f"{path}/changes/version={version}")
