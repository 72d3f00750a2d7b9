"""Exact and fuzzy removal of repeated rows; the first row in ``seq`` order survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import levenshtein_ratio
from .names import fresh
from .ranking import checkpointed


def first_per_key(rows: DataFrame, key: Column, seq: str) -> DataFrame:
    """The first row of each key; rows with a null or blank key all stay.

    The survivors' ``seq`` (unique per row) is found by a partial aggregate, so a hot key is one row
    per task before it is shuffled."""
    k = fresh("key", rows)
    keyed = rows.withColumn(k, key)
    blank = F.coalesce(F.regexp_replace(F.col(k).cast("string"), r"\s+", ""), F.lit("")) == ""
    first = keyed.filter(~blank).groupBy(k).agg(F.min(seq).alias(seq)).select(seq)
    return keyed.filter(~blank).drop(k).join(first, seq, "left_semi").unionByName(keyed.filter(blank).drop(k))


def alias_dedup(rows: DataFrame, key: Column, seq: str, score: str, label: str) -> DataFrame:
    """One row per key: the first row's columns, the group's best score, and the distinct labels of the dropped rows in order of their first
    appearance. Labels are made distinct before they are collected: a group's list is as long as it has labels, not rows."""
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.col(seq)).alias("r"), F.max(score).alias("best"), F.min(seq).alias("_first"))
    dropped = keyed.join(first.select(F.col("_first").alias(seq)), seq, "left_anti").groupBy("_key", label).agg(F.min(seq).alias("s"))
    also = dropped.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", F.col(label).alias("l")))), lambda x: x["l"]).alias("also"))
    none = F.array().cast(also.schema["also"].dataType)
    return first.join(also, "_key", "left").select(*(F.col(f"r.{c}").alias(c) for c in rows.columns if c != score), F.col("best").alias(score), F.coalesce("also", none).alias("also"))


def similar_pairs(rows: DataFrame, key: str, text: str, ratio: float, within: list[str] | None = None) -> DataFrame:
    """(a, b) with a before b whose texts reach the ratio; with ``within``, of rows that agree on those columns.

    d >= (1 - t) * n edits are too many, so of the first n characters' cuts into floor((1 - t) * n) + 1
    pieces one must occur unchanged in the other text, near its place: pieces are the join keys."""
    longest = F.length(text)
    r = rows.filter(longest > 0).select(F.col(key).alias("id"), F.col(text).alias("t"), longest.alias("n"), F.concat_ws("\x1f", *(within or [])).alias("g"))
    # A partner's length m is within [t n, n / t]; the edits allowed follow from the longer one.
    pieces = r.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * ratio - 1e-9).cast("int"), F.floor(F.col("n") / ratio + 1e-9).cast("int"))))
    pieces = pieces.withColumn("k", F.floor((1 - ratio) * F.greatest("n", "m") + 1e-9).cast("int") + 1)
    short, long = pieces.filter("n <= m"), pieces.filter("n >= m")
    cut = lambda i: F.floor(i * F.col("n") / F.col("k")).cast("int")
    left = short.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(F.col("id").alias("a"), F.col("t").alias("ta"), F.col("n").alias("na"), F.col("m").alias("nb"), "i", F.substr(F.col("t"), cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))).alias("piece"), "k", "g")
    at = F.floor(F.col("i") * F.col("m") / F.col("k")).cast("int")
    size = F.floor((F.col("i") + 1) * F.col("m") / F.col("k")).cast("int") - at
    right = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    right = right.withColumn("at", F.explode(F.sequence(F.greatest(at - F.col("k") + 1, F.lit(0)), F.least(at + F.col("k") - 1, F.greatest(F.col("n") - size, F.lit(0))))))
    right = right.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("n").alias("nb"), F.col("m").alias("na"), "i", F.substr(F.col("t"), F.col("at") + 1, size).alias("piece"), "g")
    found = left.join(right, ["g", "na", "nb", "i", "piece"]).filter("a != b").select(F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("a")).alias("b"), "ta", "tb")
    return found.dropDuplicates(["a", "b"]).filter(levenshtein_ratio(F.col("ta"), F.col("tb")) >= ratio - 1e-12).select("a", "b")


def greedy_survivors(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Keeps, in key order, each row that is similar to no kept earlier row.

    Not components: a row dropped earlier drops nobody. In rounds, undecided rows without an
    undecided earlier partner are kept and their later partners dropped. Few rounds are needed on
    average; each is cut by a reliable checkpoint."""
    open_pairs = checkpointed(pairs.select("a", "b"))
    dropped = None
    while open_pairs.limit(1).count():
        keep = open_pairs.select("a").distinct().join(open_pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = checkpointed(open_pairs.join(keep, "a", "left_semi").select(F.col("b").alias("x")).distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        open_pairs = checkpointed(open_pairs.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti").join(keep, "a", "left_anti").select("a", "b"))
    return rows if dropped is None else rows.join(dropped.select(F.col("x").alias(key)), key, "left_anti")


def fuzzy_dedup(rows: DataFrame, text: str, seq: str, ratio: float = 0.85, within: list[str] | None = None) -> DataFrame:
    """Greedy fuzzy dedup on a text column; blank texts stay. With ``within``, only rows that agree on those columns are compared.

    Exact repeats are taken out first: their survivor is the first, and no result changes."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    for c in within or []:
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    full = rows.filter(~blank)
    key = F.concat_ws("\x1f", *(within or []), text)
    first = first_per_key(full, key, seq)
    pairs = similar_pairs(first, seq, text, ratio, within)
    return greedy_survivors(first, pairs, seq).unionByName(rows.filter(blank))


def dedup_pipeline(rows: DataFrame, seq: str, hash_col: str, title: str, author: str, doi: str | None = None) -> DataFrame:
    """Exact hashes, then identifiers (``doi``), then fuzzy titles, then fuzzier titles of one author; blanks pass every layer.
    Rows that come in batches go through :class:`skein.operators.dedup_index.DedupIndex` instead."""
    out = first_per_key(rows, F.col(hash_col), seq)
    if doi:
        out = first_per_key(out, F.col(doi), seq)
    # A fuzzy layer reads its rows in several jobs.
    out = checkpointed(fuzzy_dedup(checkpointed(out), title, seq, 0.85))
    return fuzzy_dedup(out, title, seq, 0.75, [author])
