"""Filter interaction audit over a packed bitmap index.

Which of several filters removes what depends on their order. Each task packs the rows of a batch into
bitsets, a range of whole bytes for each part: one bitset per filter (a set bit fails) and per label.
AND-NOT gives the rows that pass every filter of a subset, popcount their numbers; the counts of all
tasks are summed. What any order removes at any step is a difference of two such counts, so the orders
cost nothing more over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, roomy

#: Rows that are packed together; memory is a few bytes of each, whatever the number of parts.
PACKED_ROWS = 200_000


def subset_counts(part: np.ndarray, fails: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, counts[part, subset, 1 + label]): how many rows of each part pass all filters of a subset, and how many of
    those bear each label. ``part`` holds sorted codes, ``fails`` [filter, row] and ``labels`` [label, row] are boolean."""
    parts, first, size = np.unique(part, return_index=True, return_counts=True)
    width = (size + 7) // 8  # bytes of a part; the bits that fill its last byte are set nowhere
    begin = np.concatenate([[0], np.cumsum(width)])
    at = np.repeat(begin[:-1] * 8 - first, size) + np.arange(len(part))

    def packed(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros(begin[-1] * 8, bool)
        wide[at] = bits
        return np.packbits(wide)

    masks = [packed(f) for f in fails]
    wanted = [packed(np.ones(len(part), bool)), *(packed(x) for x in labels)]
    out = np.zeros((len(parts), 1 << len(masks), len(wanted)), np.int64)
    passing: dict[int, np.ndarray] = {0: wanted[0]}
    for subset in range(1 << len(masks)):
        if subset:
            top = subset.bit_length() - 1
            passing[subset] = passing[subset ^ (1 << top)] & ~masks[top]
        for i, w in enumerate(wanted):
            out[:, subset, i] = np.add.reduceat(np.bitwise_count(passing[subset] & w).astype(np.int64), begin[:-1])
    return parts, out


def passing_counts(rows: DataFrame, filters: list[str], labels: list[str], part: str) -> DataFrame:
    """(part, subset, n, one count for each label): rows of each part that pass every filter of the subset, whose bit i
    stands for ``filters[i]``. ``filters`` are boolean columns (true: fails), ``labels`` too; null reads as false.

    A part's rows may lie anywhere; every task gives one row for each part, subset and packed batch, which are summed
    before and after the shuffle. Null parts are a part of their own; an empty table has no rows."""
    if not 1 <= len(filters) <= 12:
        raise ValueError("between 1 and 12 filters: every subset is counted")
    columns = [f"n{i}" for i in range(1 + len(labels))]

    def batch_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        codes = pc.dictionary_encode(t.column("part").combine_chunks(), null_encoding="encode")
        code = codes.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        bit = lambda name: pc.fill_null(t.column(name), False).combine_chunks().to_numpy(zero_copy_only=False)[order]
        bits = lambda mark, n: np.array([bit(f"{mark}{i}") for i in range(n)]).reshape(n, -1)
        parts, counts = subset_counts(code[order], bits("f", len(filters)), bits("l", len(labels)))
        k = 1 << len(filters)
        return pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(np.repeat(parts, k))), pa.array(np.tile(np.arange(k, dtype=np.int32), len(parts))), *(pa.array(counts[:, :, i].ravel()) for i in range(len(columns)))], ["part", "subset", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACKED_ROWS:
                yield batch_of(held)
                held, n = [], 0
        if held:
            yield batch_of(held)

    narrow = rows.select(F.col(part).alias("part"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(filters)), *(F.col(c).alias(f"l{i}") for i, c in enumerate(labels)))
    kind = narrow.schema["part"].dataType.simpleString()
    counted = narrow.mapInArrow(roomy(run), f"part {kind}, subset int, " + ", ".join(f"{c} long" for c in columns))
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in columns)).select("part", "subset", F.col("n0").alias("n"), *(F.col(f"n{i + 1}").alias(c) for i, c in enumerate(labels)))


def order_report(counts: DataFrame, letters: str, labels: dict[str, str]) -> DataFrame:
    """One row for each part, order and step, from :func:`passing_counts`: what is kept after the step, what its filter
    removes there, what of it earlier filters had removed, what fails it alone, the labelled rows it removes (``labels``:
    count column to output column) and its removals summed over all orders. The filters' names are single letters."""
    n, full = len(letters), (1 << len(letters)) - 1
    a = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", *labels))).alias("a"))  # 2**n entries
    at = lambda mask, c: F.element_at("a", mask + 1)[c]
    total = lambda f: sum(factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1")) * (at(F.lit(s), "n") - at(F.lit(s | 1 << f), "n")) for s in range(full + 1) if not s >> f & 1)
    alone = lambda f: at(F.lit(full ^ 1 << f), "n") - at(F.lit(full), "n")
    per_filter = a.select("part", "a", F.array(*(F.struct(at(F.lit(0), "n") - at(F.lit(1 << f), "n"), alone(f), total(f)) for f in range(n))).cast("array<struct<fails:bigint,alone:bigint,total:bigint>>").alias("f"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    steps = per_filter.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    mask = lambda prefix: sum((F.when(F.contains(prefix, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    prefix = lambda length: F.substr("filter_order", F.lit(1), length)
    steps = steps.withColumns({"was": mask(prefix(F.col("step") - 1)), "now": mask(prefix(F.col("step")))})
    own = F.element_at("f", F.instr(F.lit(letters), F.substr("filter_order", "step", F.lit(1))))
    removed = lambda c: at(F.col("was"), c) - at(F.col("now"), c)
    return steps.select(
        "part", "filter_order", "step", at(F.col("now"), "n").alias("kept"), removed("n").alias("removed"), (own["fails"] - removed("n")).alias("redundant"), own["alone"].alias("unique_fails"),
        *(removed(c).alias(name) for c, name in labels.items()), own["total"].alias("shapley"),
    )


def repeats_earlier(docs: DataFrame, digest: str, id_col: str = "doc_id") -> DataFrame:
    """The rows with a column ``repeated``: a smaller id has the same digest. Null ids are neither smaller nor greater than any.

    The first id of each digest is an aggregate; rows are joined to it by digest and id together, so that
    a text with a third of all copies is spread like any other."""
    d, f = fresh("d", docs), fresh("f", docs)
    first = docs.groupBy(F.col(digest).alias(d)).agg(F.min(id_col).alias(f))
    joined = docs.join(first, (F.col(digest) == F.col(d)) & (F.col(id_col) == F.col(f)), "left")
    return joined.withColumn("repeated", F.col(d).isNull() & F.col(id_col).isNotNull()).drop(d, f)


def text_filters(text: Column) -> dict[str, Column]:
    """The four failure conditions that a text alone decides: few words, repeated words, many capitals, odd characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """How five filters of whole texts interact, by part: A under 200 words; B under half of the words distinct; C over 2 %
    capitals; D any of ``#$%&*|``; E the same text as a smaller id. See :func:`order_report` for the columns.

    Null texts are empty, null parts the empty string. Rows that share an id are all counted, and none of them repeats
    another; a null id repeats nothing and has no labels. Of several label rows of an id any that says 1 counts. An empty
    table has no parts. Other columns of either table are not read, so their names never clash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(name) for name, c in text_filters(F.col(text_col)).items()))
    marks = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = repeats_earlier(rows, "digest").withColumnRenamed("repeated", "E").join(marks, "doc_id", "left")
    counts = passing_counts(joined, list("ABCDE"), ["good", "toxic"], "part")
    return order_report(counts, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
