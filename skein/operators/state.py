"""Change detection, caches with expiry, and checks of state moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import TRANSITIONS
from ..functions.scalars import infer_group
from .folds import ordered_digest


def snapshot_diff(old: DataFrame, new: DataFrame, path: str, fingerprint: str, module: Column) -> DataFrame:
    """Per module: needs_create (no old file), needs_delete (no file left), needs_update (a file changed or went) or unchanged.

    A new file in a known module alone doesn't change its state."""
    both = old.select(path, F.col(fingerprint).alias("was")).join(new.select(path, F.col(fingerprint).alias("now")), path, "full_outer")
    known, left = F.max(F.col("was").isNotNull().cast("int")) == 1, F.max((F.col("was").isNotNull() & F.col("now").isNotNull()).cast("int")) == 1
    changed = F.max(F.coalesce(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("now")), F.lit(False)).cast("int")) == 1
    status = F.when(~known, "needs_create").when(~left, "needs_delete").when(changed, "needs_update").otherwise("unchanged")
    return both.withColumn("module", module).groupBy("module").agg(status.alias("status"), F.count(F.lit(1)).alias("n_files"))


def change_log(old: DataFrame, new: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """One row per changed file: file_missing, file_changed or needs_create."""
    both = old.select(path, F.col(fingerprint).alias("was")).join(new.select(path, F.col(fingerprint).alias("now")), path, "full_outer")
    change = F.when(F.col("now").isNull(), "file_missing").when(F.col("was").isNull(), "needs_create").when(F.col("was") != F.col("now"), "file_changed")
    return both.select(path, change.alias("change")).filter("change is not null")


MODULES, SOURCES = "module string, hash string, mtime long, doc_status string", "module string, pos int, path string"


def empty_manifest(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A manifest that knows no modules: its modules and its modules' source paths."""
    return spark.createDataFrame([], MODULES), spark.createDataFrame([], SOURCES)


def update_manifest(modules: DataFrame, sources: DataFrame, files: DataFrame, module_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(modules, sources, changes) after a look at the files (path, fingerprint, mtime): the manifest with its statuses carried on.

    A module whose files are all gone needs_delete and keeps the rest of its row. One whose digest (of its files'
    fingerprints in the stored order) differs, or that lost a file, needs_update, with the new digest and the latest time; others
    keep their status (none: up_to_date). Files that no module lists are grouped by their inferred module (``module_of``, a column
    over ``path``), in the order of paths; if it is not known it is added as needs_create. Changes are file_missing, needs_delete,
    file_changed and needs_create. A module's files are rows, never a list."""
    module_of = infer_group(F.col("path")) if module_of is None else module_of
    found = sources.join(files.select("path", "fingerprint", F.col("mtime").alias("seen")), "path", "left")
    there = found.filter("fingerprint is not null")
    digest = ordered_digest(there, ["module"], ["pos"], "fingerprint", "now")
    counts = found.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.count("fingerprint").alias("k"), F.max("seen").alias("seen"))
    m = modules.join(counts, "module", "left").join(digest, "module", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0)), "now": F.coalesce("now", F.lit(""))})
    gone, differs = (F.col("n") > 0) & (F.col("k") == 0), ~F.col("now").eqNullSafe(F.coalesce("hash", F.lit("")))
    read = ~gone & differs & (F.col("k") > 0)
    status = F.when(gone, "needs_delete").when(differs | (F.col("k") < F.col("n")), "needs_update").otherwise(F.coalesce("doc_status", F.lit("up_to_date")))
    kept = m.select("module", F.when(read, F.col("now")).otherwise(F.col("hash")).alias("hash"), F.when(read, F.col("seen")).otherwise(F.col("mtime")).alias("mtime"), status.alias("doc_status"))

    new = files.join(sources.select("path").distinct(), "path", "left_anti").withColumn("module", module_of)
    order = F.row_number().over(Window.partitionBy("module").orderBy("path"))
    new = new.withColumn("pos", (order - 1).cast("int"))
    grown = new.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.max("mtime").alias("mtime"), *(F.max(F.when(F.col("pos") == i, F.col("path"))).alias(f"p{i}") for i in range(3)))
    fresh = new.join(modules.select("module"), "module", "left_anti")
    added = ordered_digest(fresh, ["module"], ["path"], "fingerprint", "hash").join(grown, "module").select("module", "hash", "mtime", F.lit("needs_create").alias("doc_status"))

    one = lambda rows, kind, detail: rows.select("module", F.lit(kind).alias("type"), detail.alias("detail"))
    short = lambda c: F.concat(F.substring(F.coalesce(c, F.lit("")), 1, 12), F.lit("..."))
    names = F.concat(F.concat_ws(", ", "p0", "p1", "p2"), F.when(F.col("n") > 3, "...").otherwise(""))
    changes = one(found.filter("fingerprint is null"), "file_missing", F.concat(F.lit("Source file no longer exists: "), "path"))
    for more in (
        one(m.filter(gone), "needs_delete", F.lit("All source files removed")), one(m.filter(read), "file_changed", F.concat(F.lit("Hash changed: "), short(F.col("hash")), F.lit(" → "), short(F.col("now")))),
        one(grown, "needs_create", F.concat(F.lit("New module detected ("), F.col("n").cast("string"), F.lit(" file(s)): "), names)),
    ):
        changes = changes.unionByName(more)
    # A module that is to be deleted keeps its paths; others keep those that exist.
    lost = m.filter(gone).select("module")
    left = there.select("module", "pos", "path").unionByName(found.join(lost, "module", "left_semi").select("module", "pos", "path"))
    left = left.withColumn("pos", (F.row_number().over(Window.partitionBy("module").orderBy("pos")) - 1).cast("int"))
    return kept.unionByName(added), left.unionByName(fresh.select("module", "pos", "path")), changes


def fresh_else_stale(keys: DataFrame, cache: DataFrame, fetched: DataFrame, key: str, value: str, expires: str, now: Column) -> DataFrame:
    """Each key's fresh cached value, else the fetched one, else the stale one, and which it was."""
    c = cache.groupBy(key).agg(F.max_by(F.struct(value, expires), F.col(expires)).alias("c"))
    f = fetched.groupBy(key).agg(F.max(value).alias("f"))
    fresh = F.when(F.col(f"c.{expires}") > now, F.col(f"c.{value}"))
    j = keys.join(c, key, "left").join(f, key, "left")
    return j.select(key, F.coalesce(fresh, F.col("f"), F.col(f"c.{value}")).alias(value), F.when(fresh.isNotNull(), "fresh").when(F.col("f").isNotNull(), "fetched").when(F.col(f"c.{value}").isNotNull(), "stale").otherwise("error").alias("origin"))


def cache_stats(cache: DataFrame, expires: str, data: str, now: Column) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.count_if(F.col(expires) <= now), F.lit(0)).alias("expired"), F.coalesce(F.sum(F.length(data)), F.lit(0)).alias("bytes"))


def check_transitions(steps: DataFrame, key: str, order: list[str], status: str, allowed: dict[str, list[str]] = TRANSITIONS, first: str = "pending") -> DataFrame:
    """Each step with its former state, whether the move is allowed (staying is), and the count of retries so far."""
    w = Window.partitionBy(key).orderBy(*order)
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    was = F.coalesce(F.lag(status).over(w), F.lit(first))
    out = steps.withColumn("was", was)
    return out.withColumn("legal", F.coalesce((F.col("was") == F.col(status)) | F.array_contains(F.try_element_at(table, F.col("was")), F.col(status)), F.lit(False))).withColumn("attempts", F.sum((F.col(status) == "retrying").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
