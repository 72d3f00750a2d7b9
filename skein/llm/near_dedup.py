"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. In round i every shingle is hashed to a coordinate and a value; a
coordinate takes the least value of the first round that reaches it. From round t on, each round
fills one fixed coordinate, so after 2t rounds none is empty, however small the set. Coordinates
agree with the chance of the sets' similarity, concentrated as for independent hashes. Bands of
coordinates are bucket keys.

Texts of equal shingle sets form one node. First one random member of each bucket is compared with
the others, and found links merge groups. Of the buckets that still hold several groups, small ones
list their pairs; large ones are cut into blocks, and a task compares two blocks by the matrix product
of their shingle incidences, so that only links leave it. Every pair that shares a bucket is so
compared or already linked through others, always on the full shingle sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, fresh, materialise, roomy
from .words import U, mix, shingle_sets, slices

FULL = U(2**64 - 1)
#: A band key is hot from this part of all band keys' rows on.
HOT = 256
_SEED = [int(x) for x in np.random.default_rng(99).integers(1, 2**63, 4096)]


def rows_per_band(t: int, similarity: float, miss: float = 1e-6) -> int:
    """The most coordinates a band may have so that a pair of just this similarity is missed with at most this chance."""
    r = 1
    while (1 - similarity ** (r + 1)) ** (t // (r + 1)) <= miss:
        r += 1
    return r


def sketches(hashes: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of each set of hashes (sets: hashes[at[i]:at[i+1]]; empty sets: all ones)."""
    n = len(at) - 1
    out = np.full(n * t, FULL)
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    x = hashes
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ U(_SEED[i]))
        # The value of a round is hashed apart from its coordinate, and differs from round to round.
        where = row * t + ((h >> U(32)) % U(t)).astype(np.int64) if i < t else row * t + (i - t)
        free = out[where] == FULL
        now = np.full(n * t, FULL) if i == 0 else None
        if now is not None:
            np.minimum.at(now, where, mix(h) >> U(1))
            out = now
        else:
            where, value = where[free], (mix(h[free]) >> U(1))
            order = np.lexsort((value, where))
            where, value = where[order], value[order]
            first = np.ones(len(where), bool)
            first[1:] = where[1:] != where[:-1]
            out[where[first]] = value[first]
        open_ = (out.reshape(n, t) == FULL).any(axis=1) & (size > 0)
        use = open_[row]
        x, row = x[use], row[use]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, r: int) -> np.ndarray:
    """One 64-bit key per band."""
    b = sketch.shape[1] // r
    parts = sketch[:, : b * r].reshape(len(sketch), b, r)
    key = np.zeros((len(sketch), b), np.uint64) + mix(np.arange(1, b + 1, dtype=np.uint64))
    for i in range(r):
        key = mix(key ^ parts[:, :, i]) * U(0x9E3779B97F4A7C15)
    return key


def _profile(docs: DataFrame, words: int, t: int, r: int) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, node (a 64-bit hash of the set), bands and the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            for i, j in slices(texts):
                part = texts.slice(i, j - i)
                h, at = shingle_sets(part, words)
                n = np.diff(at)
                total = np.concatenate([[U(0)], np.cumsum(mix(h), dtype=np.uint64)])
                node = mix((total[at[1:]] - total[at[:-1]]) ^ mix(n.astype(np.uint64))).view(np.int64)
                keys = band_keys(sketches(h, at, t), r).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                packed = [zlib.compress(x.encode(), 1) if c else b"" for x, c in zip(part.to_pylist(), n, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("h").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(node), bands, pa.array(packed, pa.binary())], ["doc_id", "h", "n_shingles", "node", "bands", "packed"])

    rows = docs.withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(roomy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, n_shingles long, node long, bands array<long>, packed binary")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                left, right = b.column("a").to_pylist(), b.column("b").to_pylist()
                packed = dict(zip(left, b.column("pa").to_pylist(), strict=True)) | dict(zip(right, b.column("pb").to_pylist(), strict=True))
                place = {node: n for n, node in enumerate(packed)}
                h, at = shingle_sets(pa.array([zlib.decompress(x).decode() for x in packed.values()], pa.large_string()), words)
                sets = [h[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                good = []
                for x, y in zip(left, right, strict=True):
                    p, q = sets[place[x]], sets[place[y]]
                    both = np.concatenate([p, q])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    good.append(100 * common >= percent * (len(p) + len(q) - common))
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a")
    return left.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b").select("a", "b", "pa", "pb").mapInArrow(roomy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of links (a, b).

    Each round takes the least label among neighbours and then jumps to the label's own label, so
    that long chains take few rounds. Every round is written to the shared folder."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(step.join(of, "label", "left").select("node", "was", F.least("label", "next").alias("label")), "labels")
        discard(labels)
        if not new.filter("label != was").limit(1).count():
            discard(both)
            return new
        labels = new


def _by_key(rows: DataFrame, per_key: DataFrame, hot: list[int]) -> DataFrame:
    """A join with a table of one row per key. ``hot`` keys, fewer than ``HOT``, are sent to all tasks, so their rows stay where they are."""
    is_hot = F.col("key").isin(hot)
    return rows.join(per_key, "key") if not hot else rows.filter(~is_hot).join(per_key.filter(~is_hot), "key").unionByName(rows.filter(is_hot).join(F.broadcast(per_key.filter(is_hot)), "key"))


def _pivots(members: DataFrame, turn: int, hot: list[int]) -> DataFrame:
    """Pairs of each bucket's member drawn for this turn with its members of other groups."""
    drawn = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "grp")).alias("p"), F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low != high")
    drawn = drawn.select("key", F.col("p.node").alias("b"), F.col("p.n").alias("bn"), F.col("p.grp").alias("bg"))
    return _by_key(members, drawn, hot).filter("grp != bg").select(F.col("node").alias("a"), "b", "n", "bn")


def _block_links(table: pa.Table, words: int, percent: int, columns: int = 8192) -> pa.Table:
    """Of the links between two blocks of one bucket (or within one) as many as connect the same groups."""
    h, at = shingle_sets(pa.array([zlib.decompress(x).decode() for x in table.column("packed").to_pylist()], pa.large_string()), words)
    node, grp, chunk = (table.column(c).to_numpy() for c in ("node", "grp", "chunk"))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    row, (every, where, counts) = np.repeat(np.arange(len(node)), np.diff(at)), np.unique(h, return_inverse=True, return_counts=True)
    use = counts[where] > 1  # others meet nowhere
    row, where = row[use], where[use]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
    place = np.zeros(len(node), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(every), columns):
        i, j = np.searchsorted(where, [first, first + columns])
        if i == j:
            continue
        r, c = row[i:j], where[i:j] - first
        x = np.zeros((len(left), columns), np.float32)
        y = x if lo == hi else np.zeros((len(right), columns), np.float32)
        one, two = chunk[r] == lo, chunk[r] == hi
        x[place[r[one]], c[one]] = 1
        y[place[r[two]], c[two]] = 1
        common += x @ y.T
    n = np.diff(at)
    both = n[left][:, None] + n[right][None, :] - common
    linked = (100 * common.astype(np.int64) >= percent * both.astype(np.int64)) & (grp[left][:, None] != grp[right][None, :])
    a, b = np.nonzero(linked)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    keep = []
    for n, (x, y) in enumerate(zip(grp[left[a]].tolist(), grp[right[b]].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(n)
    return pa.table({"a": node[left[a[keep]]], "b": node[right[b[keep]]]})


def _remaining_links(members: DataFrame, texts: DataFrame, words: int, percent: int, alike, hot: list[int], small: int = 8, block: int = 512) -> DataFrame:
    """Links between the groups of each bucket: pairs of buckets of up to ``small`` members, blocks of larger ones."""
    sized = _by_key(members, members.groupBy("key").agg(F.count(F.lit(1)).alias("c")), hot)
    few = sized.filter(F.col("c") <= small)
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("grp").alias("bg"))
    pairs = few.join(other, "key").filter("node < b and grp != bg").filter(alike).select(F.col("node").alias("a"), "b").distinct()
    found = _verified(materialise(pairs, "pairs"), texts, words, percent)
    many = sized.filter(F.col("c") > small).withColumn("k", F.ceil(F.col("c") / block).cast("int"))
    many = many.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).join(texts, "node")
    many = many.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("key", "node", "grp", "chunk", "packed", F.least("chunk", "to").alias("lo"), F.greatest("chunk", "to").alias("hi"))
    blocks = many.groupBy("key", "lo", "hi").applyInArrow(lambda table: _block_links(table, words, percent), "a long, b long")
    return found.unionByName(blocks).distinct()


def _judged(docs: DataFrame, words: int, percent: int, t: int, turns: int, id_col: str, text_col: str) -> DataFrame:
    """:func:`near_groups` with h, a hash of each row's text, and stays: whether it is its group's least (doc_id, h)."""
    spark = docs.sparkSession
    r = rows_per_band(t, percent / 100)
    kind = docs.schema[id_col].dataType
    rows = materialise(_profile(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), words, t, r), "profile")
    linked = rows.filter("n_shingles > 0 and doc_id is not null")
    nodes = linked.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared_keys = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "keys")
    total = shared_keys.agg(F.sum("c")).first()[0] or 0
    hot = [x.key for x in shared_keys.filter(F.col("c") * HOT > total).collect()]  # fewer than HOT
    members = materialise(_by_key(keyed, shared_keys, hot).select("key", "node", "n"), "members")
    discard(shared_keys)
    wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node")
    texts = materialise(linked.select("node", F.struct("doc_id", "h").alias("first"), "packed").join(wanted, ["node", "first"]).dropDuplicates(["node"]).select("node", "packed"), "texts")
    alike = F.least("n", "bn") * 100 >= F.greatest("n", "bn") * percent
    links, groups = None, None
    for turn in range(turns + 1):
        now = members.withColumn("grp", F.col("node")) if groups is None else members.join(groups, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("grp"))
        if turn:
            # Only buckets that still hold several groups matter.
            placed = materialise(now, "placed")
            several = placed.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low != high").select("key")
            now = materialise(_by_key(placed, several, hot), "members")
            discard(placed)
        if turn < turns:
            pairs = _pivots(now, turn, hot).filter(alike)
            pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
            found = materialise(_verified(pairs, texts, words, percent), "found")
            discard(pairs)
        else:
            found = materialise(_remaining_links(now, texts, words, percent, alike, hot), "found")
        if turn:
            discard(now)
        if not found.limit(1).count():
            continue
        links = found if links is None else links.unionByName(found)
        groups = components(links).select("node", "label")
    discard(members, texts)
    if groups is None:
        groups = spark.createDataFrame([], "node long, label long")
    placed = nodes.select("node", "first").join(groups, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    least = placed.groupBy("label").agg(F.min("first").alias("least"))
    of_node = placed.join(least, "label").select("node", "least")
    out = rows.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce("least.doc_id", "doc_id"))
    stays = F.col("doc_id").isNull() | F.col("least").isNull() | ((F.col("doc_id") == F.col("least.doc_id")) & (F.col("h") == F.col("least.h")))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), stays.alias("stays")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, t: int = 128, turns: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of distinct ``words``-word shingles (A-Z lower-cased; fewer words:
    their whole sequence; shingles as 64-bit hashes) satisfy 100 * intersection >= percent * union; component_id is the smallest
    doc_id that links reach; kept marks that document. Null or empty texts and those without words
    have no shingles and no links. Rows with a null id form no groups: their component_id is null and they are kept.
    Rows that repeat an id are judged each by its own text. An empty table gives no rows. Other
    columns are not read."""
    return _judged(docs, words, percent, t, turns, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, t: int = 128, turns: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all columns, of each group of :func:`near_groups`: that of the smallest id, and of rows
    that repeat this id the one whose text has the least hash; equal rows count once. Rows in no group all stay, those of
    null or empty text among them; the columns of ``docs`` may have any names."""
    judged = _judged(docs, words, percent, t, turns, id_col, text_col)
    key = F.struct(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")))
    name = fresh("of", docs)
    of = F.struct("doc_id", "h").alias(name)
    gone = judged.filter("not stays").select(of).distinct()
    twice = judged.filter("stays and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "h").count().filter("count > 1").select(of)
    return _once(docs, key, name, gone, materialise(twice, "twice"))


def _once(docs: DataFrame, key: Column, name: str, gone: DataFrame, twice: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone``, and one of each of ``twice``; both have the column ``name``."""
    same = key.eqNullSafe(F.col(name))
    left = docs.join(gone, same, "left_anti")
    if not twice.limit(1).count():
        return left
    one = left.join(twice, same, "left_semi")
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    return left.join(twice, same, "left_anti").unionByName(one.select("*", n.alias(name)).filter(F.col(name) == 1).drop(name))
