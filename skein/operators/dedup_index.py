"""Dedup of one batch after the other against what earlier batches left in each layer.

Every layer remembers what it let through, whatever later layers did with it: hashes, identifiers, and the pieces
of titles. A batch is compared with these alone, never with earlier rows: a title is cut into more pieces than
similar titles can differ in edits, so one piece of a similar earlier title occurs in a new one near its place, and
the new titles' cuts are joined with the stored pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import levenshtein_ratio
from .dedup import first_per_key, greedy_survivors, similar_pairs
from .names import fresh
from .ranking import checkpointed

EPS = 1e-9


def _clean(c: Column) -> Column:
    """Lower case, without white space at the ends."""
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", ""))


def _cuts(n: Column, ratio: float) -> Column:
    """How many pieces a text of ``n`` characters is cut into: one more than the edits to any text similar to it."""
    return F.floor((1 - ratio) * n / ratio + EPS).cast("int") + 1


def title_pieces(rows: DataFrame, text: str, group: str, ratio: float) -> DataFrame:
    """(g, n, i, piece, text): each distinct text's pieces, by which later texts find it."""
    r = rows.select(F.col(group).alias("g"), F.col(text).alias("text")).distinct().withColumn("n", F.length("text")).withColumn("k", _cuts(F.col("n"), ratio))
    at = lambda i: F.floor(i * F.col("n") / F.col("k")).cast("int")
    return r.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("g", "n", "i", F.substr("text", at(F.col("i")) + 1, at(F.col("i") + 1) - at(F.col("i"))).alias("piece"), "text")


def title_probes(rows: DataFrame, text: str, group: str, ratio: float) -> DataFrame:
    """(g, n, i, piece, t): what a stored text of ``n`` characters may have as its piece ``i`` if it is similar to the text ``t``.

    With at most k - 1 edits spread over k pieces some piece i is unchanged with at most i edits before it and at most
    k - 1 - i behind it, which bounds how far it has moved."""
    r = rows.select(F.col(group).alias("g"), F.col(text).alias("t")).distinct().withColumn("m", F.length("t"))
    r = r.withColumn("n", F.explode(F.sequence(F.greatest(F.ceil(F.col("m") * ratio - EPS).cast("int"), F.lit(1)), F.floor(F.col("m") / ratio + EPS).cast("int")))).withColumn("k", _cuts(F.col("n"), ratio))
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    at = F.floor(F.col("i") * F.col("n") / F.col("k")).cast("int")
    size = F.floor((F.col("i") + 1) * F.col("n") / F.col("k")).cast("int") - at
    moved, after = F.col("m") - F.col("n"), F.col("k") - 1 - F.col("i")
    low, high = F.greatest(at - F.col("i"), at + moved - after, F.lit(0)), F.least(at + F.col("i"), at + moved + after, F.col("m") - size)
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return r.withColumn("p", F.explode(places)).select("g", "n", "i", F.substr("t", F.col("p") + 1, size).alias("piece"), "t")


def similar_to_stored(rows: DataFrame, text: str, group: str, stored: DataFrame, ratio: float) -> DataFrame:
    """(g, t): the texts of ``rows`` that reach the ratio with a stored text of their group."""
    found = title_probes(rows, text, group, ratio).join(stored, ["g", "n", "i", "piece"]).select("g", "t", "text").distinct()
    return found.filter(levenshtein_ratio(F.col("t"), F.col("text")) >= ratio - 1e-12).select("g", "t").distinct()


class DedupIndex:
    """The layers' memory under a folder. A batch has a number; what it adds is a folder of its own in each layer, so a batch
    that is run again replaces its own part and sees only lower numbers. :meth:`reset` comes first and forgets all.

    Within a batch the first row by ``seq`` counts, and all rows of earlier batches come before it. Null and blank hashes,
    identifiers and titles pass their layers; the last layer compares titles of one author only."""

    def __init__(self, spark: SparkSession, path: str, seq: str, hash_col: str, title: str, author: str, doi: str | None = None, ratio: float = 0.85, same_author: float = 0.75):
        self.spark, self.path, self.seq, self.title, self.author = spark, path, seq, title, author
        self.exact = {"hash": hash_col, **({"doi": doi} if doi else {})}
        self.fuzzy = {"title": (None, ratio), "author": (author, same_author)}

    def reset(self) -> None:
        for layer in self.exact:
            self._write(self.spark.createDataFrame([], "value string"), layer, -1, "overwrite")
        for layer in self.fuzzy:
            self._write(self.spark.createDataFrame([], "g string, n int, i int, piece string, text string"), layer, -1, "overwrite")

    def _write(self, rows: DataFrame, layer: str, number: int, mode: str = "overwrite") -> None:
        if number < 0:
            rows.withColumn("batch", F.lit(number).cast("long")).write.mode(mode).partitionBy("batch").parquet(f"{self.path}/{layer}")
        rows.write.mode(mode).parquet(f"{self.path}/{layer}/batch={number}")

    def _stored(self, layer: str, number: int) -> DataFrame:
        columns = "value string" if layer in self.exact else "g string, n int, i int, piece string, text string"
        return self.spark.read.schema(f"{columns}, batch long").parquet(f"{self.path}/{layer}").filter(F.col("batch") < number).drop("batch")

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """The rows of a batch that all layers let through; the layers remember what each of them let through."""
        out = checkpointed(batch)
        for layer, column in self.exact.items():
            key, value = F.regexp_replace(F.col(column).cast("string"), r"^\s+|\s+$", ""), fresh("value", batch)
            seen = self._stored(layer, number).withColumnRenamed("value", value)
            out = checkpointed(first_per_key(out.join(seen, key == F.col(value), "left_anti"), key, self.seq))
            self._write(out.select(key.alias("value")).filter("value <> ''").distinct(), layer, number)
        for layer, (author, ratio) in self.fuzzy.items():
            out = self._fuzzy(out, layer, number, author, ratio)
        return out

    def _fuzzy(self, rows: DataFrame, layer: str, number: int, author: str | None, ratio: float) -> DataFrame:
        text, group = fresh("text", rows), fresh("group", rows)
        r = rows.withColumn(text, _clean(F.col(self.title))).withColumn(group, _clean(F.col(author)) if author else F.lit("."))
        blank = (F.col(text) == "") | (F.col(group) == "")
        full = r.filter(~blank)
        known = similar_to_stored(full, text, group, self._stored(layer, number), ratio)
        g, t = fresh("g", full), fresh("t", full)
        new = full.join(known.toDF(g, t), (F.col(text) == F.col(t)) & (F.col(group) == F.col(g)), "left_anti")
        first = checkpointed(first_per_key(new, F.concat_ws("\x1f", group, text), self.seq))
        kept = checkpointed(greedy_survivors(first, similar_pairs(first, self.seq, text, ratio, [group]), self.seq))
        self._write(title_pieces(kept, text, group, ratio), layer, number)
        return checkpointed(kept.unionByName(r.filter(blank)).drop(text, group))
