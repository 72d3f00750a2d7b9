"""Exact top-k inner products by sequential reads of sorted lists, without random access.

Each task holds a block of vectors and, for each component, that component's list of rows sorted by
value. For a query all lists are read side by side, a step at a time, from the end that the sign of
the query's component prefers. What has been read gives every vector two score bounds: a component
not read yet counts at most as the last value read from its list, and at least as the list's last
one. The k-th best lower bound, or the k-th best final score of earlier blocks if that is higher, is
what an outsider has to reach. Reading stops when few vectors, or none besides the k best, still
can; only then are final scores resolved, for those vectors alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise

#: The shares of the lists up to which the steps read, and for how many times k vectors final scores are resolved.
DEPTHS, RESOLVED = (0.55, 0.75, 0.95, 1.0), 8
#: Integers from here on aren't exact as floats; scores are kept within the range of long.
EXACT, LONG = float(2**53), 2**63


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of integers as float64, padded with zeros (or cut off, where a query has no such component) to ``width``."""
    at = col.offsets.to_numpy()
    n = np.diff(at)
    values = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), width))
    row, pos = np.repeat(np.arange(len(n)), n), np.arange(at[0], at[-1]) - np.repeat(at[:-1], n)
    use = pos < width
    out[row[use], pos[use]] = values[at[0] : at[-1]][use]
    return out


def _large(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether products may leave the range in which floats hold integers."""
    return bool(x.size and q.size) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= EXACT


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with one query; large ones in Python's integers, kept within the range of long."""
    if _large(x, q):
        return np.array([min(max(sum(int(a) * int(b) for a, b in zip(r, q, strict=True)), -LONG), LONG - 1) for r in x], np.int64)
    return (x @ q).astype(np.int64)


class Lists:
    """A block of vectors with its sorted lists: ``order[i, j]`` is the row that holds the i-th least value of component j."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.d) = x, x.shape
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.read = np.zeros((self.n, self.d), bool)

    def search(self, q: np.ndarray, k: int, floor: int | None, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows that may be among the query's k best, their final scores, and the share of the lists read sequentially.

        ``floor``: a score that k vectors of earlier blocks have reached; ``skip``: rows that are no candidates."""
        n, used = self.n, np.flatnonzero(q)  # a component of 0 adds nothing
        alive, at = np.flatnonzero(~skip), 0
        up, down = used[q[used] > 0], used[q[used] < 0]
        columns, weight = np.concatenate([up, down]), np.concatenate([q[up], q[down]])
        if not len(columns):  # all scores are 0
            return alive, np.zeros(len(alive), np.int64), 0.0
        first, worst = weight * np.concatenate([self.values[-1, up], self.values[0, down]]), weight * np.concatenate([self.values[0, up], self.values[-1, down]])
        # What sums of floats may be off by; integers below 2**53 are exact.
        slack = 4 * self.d * 2.0**-52 * np.maximum(np.abs(first), np.abs(worst)).sum() if _large(self.x, q) else 0.0
        if floor is not None and first.sum() + slack < floor:
            return alive[:0], np.zeros(0, np.int64), 0.0
        self.read[:] = False
        known = np.zeros(n)
        for depth in DEPTHS:
            to = max(at + 1, int(n * depth)) if at < n else n
            new = np.concatenate([self.order[n - to : n - at, up], self.order[at:to, down]], axis=1)
            values = np.concatenate([self.values[n - to : n - at, up], self.values[at:to, down]], axis=1)
            known += np.bincount(new.ravel(), (values * weight).ravel(), n)
            self.read.ravel()[(new * self.d + columns).ravel()] = True
            at = to
            last = weight * np.concatenate([self.values[n - at, up], self.values[at - 1, down]])
            read = self.read[np.ix_(alive, columns)]
            upper, lower = known[alive] + last.sum() - read @ last, known[alive] + worst.sum() - read @ worst
            if len(alive) >= k:  # scores are kept within the range of long, and so is what is asked of them
                reached = min(float(np.partition(lower, len(lower) - k)[len(lower) - k]) - slack, float(LONG - 1024))
                floor = reached if floor is None else max(floor, reached)
            if floor is not None:
                alive = alive[upper + slack >= floor]
            if at == n or len(alive) <= RESOLVED * k:
                break
        return alive, _scores(self.x[alive], q), at / n


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): components as integers floor(scale * x). Null vectors, null ids, and vectors with
    null, NaN or infinite components are left out."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True))
    return vectors.filter(fine).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, k: int = 10, is_query: F.Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, queries_at_once: int = 4096, rows_at_once: int = 4096) -> DataFrame:
    """Each query's k highest scores against every other row: query_id, rank, vec_id, score.

    Queries are the rows where ``is_query`` holds (by default ids divisible by 100); a query's own id
    is no candidate; of repeated query ids the least vector asks. Fewer candidates give fewer rows; ties go to
    the smaller id. Vectors of other lengths count as padded with zeros. Queries are taken in blocks
    of about ``queries_at_once``, each sent to all tasks; every block is held against all rows.
    Scores beyond the range of long count as its end. Null vectors and those with null or non-finite components take no
    part; other columns are not read. Empty tables give no rows."""
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col, scale)
    asked = rows.filter(F.col("vec_id") % 100 == 0 if is_query is None else is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialise(asked, "queries")
    blocks = max(1, -(-asked.count() // queries_at_once))
    merged = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect() if blocks > 1 else asked.collect()  # about queries_at_once rows
        if not own:
            continue
        width = max(len(r.v) for r in own)
        q = np.zeros((len(own), max(width, 1)))
        for i, r in enumerate(own):
            q[i, : len(r.v)] = r.v
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in own], np.int64), q))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)  # scores and ids, best first
            for b in batches:
                for i in range(0, b.num_rows, rows_at_once):
                    part = b.slice(i, rows_at_once)
                    lists, vec = Lists(_matrix(part.column("v"), q.shape[1])), part.column("vec_id").to_numpy()
                    for j in range(len(ids)):
                        found, new, _ = lists.search(q[j], k, int(best[j][0][-1]) if len(best[j][0]) == k else None, vec == ids[j])
                        if len(found):
                            score, vid = np.concatenate([best[j][0], new]), np.concatenate([best[j][1], vec[found]])
                            keep = np.lexsort((vid, -score))[:k]
                            best[j] = score[keep], vid[keep]
            if sum(len(s) for s, _ in best):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(s) for s, _ in best])), pa.array(np.concatenate([v for _, v in best])), pa.array(np.concatenate([s for s, _ in best]))], ["query_id", "vec_id", "score"])

        found = rows.mapInArrow(search, "query_id long, vec_id long, score long")
        merged = found if merged is None else merged.unionByName(found)
    if merged is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
