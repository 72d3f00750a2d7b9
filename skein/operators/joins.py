"""Lookup, fallback, theta and anti joins with explicit first-wins and last-wins rules.

Every rule that speaks of a first or last row takes an ordering column, so results don't depend on
partitioning. Repeated keys are aggregated before they are joined, which keeps hot keys small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import fresh


def last_wins(rows: DataFrame, keys: list[str], values: list[str], seq: str) -> DataFrame:
    """One row per key: the values of the row with the greatest ``seq``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(seq)).alias("_v")).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def left_lookup(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], seq: str) -> DataFrame:
    """Every left row with the last matching right row's values, or nulls."""
    return left.join(last_wins(right, keys, values, seq), keys, "left")


def top1_lateral(left: DataFrame, right: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """Every left row with the values of the first right row of its key in the given order."""
    ranked = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1")
    return left.join(ranked.select(key, *values), key, "left")


def lookup_default(rows: DataFrame, rules: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Rule columns by exact keys, with defaults where no rule fits. A rule table that is small enough is sent by Spark itself."""
    joined = rows.join(rules, keys, "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()))


#: Needles up to these numbers, of rows and of characters in all, are sent to all tasks.
FEW, FEW_CHARS = 10_000, 1_000_000


def contains_join(needles: DataFrame, haystacks: DataFrame, needle: str, text: str, gram: int = 3, case: bool = False, parts: int = 16, few: int = FEW) -> DataFrame:
    """Pairs in which the text contains the needle; with ``case``, in the same case. Both tables' columns, whatever their names.

    Not a nested loop: each distinct needle is keyed by the rarest of its character sequences of length ``gram``, counted
    over the texts, and joined with the texts that hold that sequence; only those pairs are compared. Needles that begin
    alike so have different keys, and one with a sequence that no text has joins nothing. Texts of a key are dealt to
    ``parts`` tasks, so that a sequence that most texts hold is no single task. Null and empty needles match nothing;
    needles shorter than ``gram`` are keyed by themselves.

    The sequences of texts are many times the texts, which Spark's estimates don't see: they are never broadcast. Up to
    ``few`` needles (and 1,000,000 characters) are sent to where the texts are; more are sorted and merged with them."""
    same = (lambda c: F.col(c)) if case else F.lower
    key, part, low, low_text = (fresh(n, needles, haystacks) for n in ("key", "part", "low", "low_text"))

    def grams(c: str, size: int) -> Column:
        last = F.length(c) - size + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(F.col(c), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    n = needles.filter(F.length(needle) > 0).withColumn(low, same(needle))
    asked = n.select(low).limit(few + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(low)), F.lit(0)).alias("chars")).first()
    small = asked.n <= few and asked.chars <= FEW_CHARS
    way = "broadcast" if small else "merge"
    own = n.select(low).distinct().withColumn(key, F.explode(F.array_distinct(F.when(F.length(low) < gram, F.array(F.col(low))).otherwise(grams(low, gram)))))
    # A small file is read in few tasks, however many sequences its texts have.
    t = haystacks.filter(F.length(text) > 0).repartition(int(haystacks.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn(low_text, same(text))
    held = F.array_distinct(F.concat(*(grams(low_text, size) for size in range(1, gram + 1))))
    counted = t.select(F.explode(held).alias(key))
    if small:
        counted = counted.join(own.select(key).distinct().hint(way), key, "left_semi")
    count = counted.groupBy(key).agg(F.count(F.lit(1)).alias(part))
    # A needle has a match only if all its sequences have been counted; then the rarest is its key.
    rarest = own.join(count.hint(way), key, "left").groupBy(low).agg(F.min_by(key, F.struct(part, key)).alias(key), F.bool_and(F.col(part).isNotNull()).alias(part)).filter(part).select(low, key)
    dealt = n.join(rarest.hint(way), low).withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    exploded = t.withColumn(part, F.pmod(F.xxhash64(*haystacks.columns), F.lit(parts)).cast("int")).withColumn(key, F.explode(held))
    return dealt.hint(way).join(exploded, [key, part]).filter(F.contains(low_text, low)).drop(key, part, low, low_text)


def exact_else_partial(queries: DataFrame, index: DataFrame, wanted: str, name: str, seq: str) -> DataFrame:
    """Each wanted text with the first equal name, else the first name that contains it, else null."""
    exact = index.groupBy(name).agg(F.min(seq).alias("_seq"))
    hit = queries.join(exact.withColumn(wanted, F.col(name)), wanted).select(wanted, F.lit(0).alias("_kind"), "_seq", name)
    part = contains_join(queries.join(hit.select(wanted), wanted, "left_anti"), index.groupBy(name).agg(F.min(seq).alias("_seq")), wanted, name).select(wanted, F.lit(1).alias("_kind"), "_seq", name)
    best = hit.unionByName(part).groupBy(wanted).agg(F.min(F.struct("_kind", "_seq", name)).alias("_m"))
    return queries.join(best, wanted, "left").select(*queries.columns, F.col(f"_m.{name}").alias("match"), F.when(F.col("_m").isNull(), "none").when(F.col("_m._kind") == 0, "exact").otherwise("partial").alias("match_kind"))


def match_cardinality(queries: DataFrame, index: DataFrame, wanted: str, name: str) -> DataFrame:
    """How many distinct names contain the wanted text: exact, unique, ambiguous or none."""
    found = contains_join(queries.select(wanted).distinct(), index.select(name).distinct(), wanted, name).groupBy(wanted).agg(F.count(F.lit(1)).alias("n"), F.max((F.lower(wanted) == F.lower(name)).cast("int")).alias("same"))
    return queries.join(found, wanted, "left").select(*queries.columns, F.coalesce("n", F.lit(0)).alias("n_matches"), F.when(F.col("same") == 1, "exact").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("outcome"))


def without_prefix(rows: DataFrame, prefixes: DataFrame, path: str, prefix: str) -> DataFrame:
    """The rows whose path has none of the prefixes at a ``/`` boundary: each path is expanded to its own prefixes, which join by equality."""
    parts = F.split(F.col(path), "/")
    own = rows.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias(prefix)).distinct()
    covered = own.join(prefixes.select(prefix).distinct(), prefix, "left_semi").select(path).distinct()
    return rows.join(covered, path, "left_anti")


def fitting_texts(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of texts one of which contains the other, case ignored; null and empty texts are in none."""
    x, y = left.select(F.col(a).alias("a")).distinct(), right.select(F.col(b).alias("b")).distinct()
    return contains_join(x, y, "a", "b").unionByName(contains_join(y, x, "b", "a")).distinct()


def coverage(gaps: DataFrame, key: str, text: str, seq: str, status: str, requirements: DataFrame, requirement: str, normal, texts: DataFrame | None = None) -> DataFrame:
    """Every (subject, requirement) with the status of the subject's first gap, by ``seq``, whose text contains the
    requirement or is contained in it (case ignored; an empty text fits all, a null one is empty); else missing.

    Both tables may be large: which texts fit is decided once for each pair of distinct texts (``texts``: a table that has
    those of the gaps, if one is at hand), and each subject's first gap of a text is found before it meets requirements,
    so that a text of many gaps is one row for each subject. The result is the full grid, as large as it is asked to be."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = F.min(F.struct(F.col(seq).alias("seq"), F.col(status).alias("status"))).alias("hit")
    own = gaps.groupBy(F.col(key).alias("k"), empty(text).alias("a")).agg(first)
    wanted = requirements.select(empty(requirement).alias("r")).distinct()
    fits = fitting_texts(gaps if texts is None else texts, wanted, text, "r").withColumnRenamed("b", "r")
    hits = own.join(fits, "a").select("k", "r", "hit")
    if wanted.filter("r = ''").limit(1).count():
        hits = hits.unionByName(own.select("k", F.lit("").alias("r"), "hit"))
    hits = hits.groupBy(F.col("k").alias("k2"), F.col("r").alias("r2")).agg(F.min("hit").alias("hit"))
    grid = own.groupBy("k").agg(F.min(F.when(F.col("a") == "", F.col("hit"))).alias("any")).crossJoin(wanted)
    best = F.least(F.col("hit"), F.col("any"))  # of structs that are not null the least
    return grid.join(hits, F.col("k").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("r2")), "left").select(F.col("k").alias(key), F.col("r").alias("requirement"), F.coalesce(normal(best["status"]), F.lit("missing")).alias("status"))


def reverse_index(marks: DataFrame, sections: DataFrame, key: str, place: list[str]) -> DataFrame:
    """For each section the sorted distinct places that name it."""
    return marks.join(sections.select(key).distinct(), key).groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*place))).alias("places"))
