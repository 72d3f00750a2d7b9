"""Benchmark decontamination by spaced-seed hashes.

A seed is a fixed mask over consecutive words; only the positions it selects are hashed, so a hit
survives substitutions at the others. The masks are chosen so that every overlap that counts has a
hit. The seeds of the benchmark's items are a table, and so are those of the documents, joined by
hash; a bitmap of bounded size keeps most document seeds that the benchmark lacks out of the join.
Around the hits a document and an item are compared word by word along the same alignment, and an
overlap counts if it is long enough with few substitutions. Nothing but the bitmap and the masks in
use comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, materialise, roomy
from .words import U, Words, mix, slices

#: Least and most bits of the bitmap; in between it has some 64 for each seed of the benchmark.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 27
#: Rows of one of Spark's bitmap aggregates.
_BUCKET = 32768


def masks(lengths: range, share: float) -> tuple[str, ...]:
    """Masks (1: hashed) of which one fits onto matching words in every range of these lengths whose share agrees.

    k substitutions leave k + 1 runs, the longest of at least ceil((n - k) / (k + 1)) words. Where all n
    that allow no more than the least such run r fill every run exactly, all runs are longer somewhere
    or two runs of r words stand one word apart."""
    can = [(n, int((1 - share) * n + 1e-9)) for n in lengths]
    r = min(-(-(n - k) // (k + 1)) for n, k in can)
    if r > 0 and all(k and n - k == r * (k + 1) for n, k in can if -(-(n - k) // (k + 1)) == r):
        return "1" * (r + 1), "1" * r + "0" + "1" * r
    return ("1" * max(r, 1),)


def _seed(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each start from which it fits into the array (of several texts in a row)."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), U(hash_of(mask)))
    for i, c in enumerate(mask):
        if c == "1" and n > 0:
            out = (out ^ hashes[i : i + n]) * U(0x9E3779B97F4A7C15)
            out ^= out >> U(29)
    return mix(out)


def hash_of(mask: str) -> int:
    return (int("1" + mask, 2) * 0xD6E8FEB86659FD93) & (2**64 - 1)


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col.cast(pa.large_string()))


def item_masks(n_words: int, min_overlap: int, share: float) -> tuple[str, ...]:
    """The masks of an item: of a longer one those that hit every overlap, of a short one those that hit it as a whole."""
    # Longer ranges have a part of such a length that agrees as well.
    return masks(range(min_overlap, 2 * min_overlap), share) if n_words > min_overlap else masks(range(n_words, n_words + 1), share)


def item_seeds(items: DataFrame, min_overlap: int, share: float, min_words: int) -> DataFrame:
    """(item, seed, pos, mask): every seed of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = _lower(b.column("text"))
            for i, j in slices(low):
                w, keys = Words(low.slice(i, j - i), alnum=True), b.column("item").slice(i, j - i).to_pylist()
                for key, a, z in zip(keys, w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
                    for m in item_masks(z - a, min_overlap, share) if z - a >= max(1, min_words) else ():
                        h = _seed(w.hash[a:z], m)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array([m] * len(h))], ["item", "seed", "pos", "mask"])

    return items.select("item", "text").mapInArrow(run, "item long, seed long, pos int, mask string")


def bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits (of bytes, lowest first) at the seeds modulo their number, which has a limit."""
    bits = min(max(LEAST_BITS, 1 << (64 * max(1, seeds.count()) - 1).bit_length()), MOST_BITS)
    at = F.pmod("seed", F.lit(bits)) + 1
    rows = seeds.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # at most MOST_BITS / _BUCKET rows
    out = np.zeros((bits // _BUCKET, _BUCKET // 8), np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def document_seeds(rows: DataFrame, use: list[str], wanted: np.ndarray) -> DataFrame:
    """(doc, seed, at): the seeds of whole texts whose bit is set."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)  # of limited size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            low = _lower(b.column("text"))
            for i, j in slices(low):
                w = Words(low.slice(i, j - i), alnum=True)
                row, keys = w.row_of(), b.column("doc").slice(i, j - i).to_numpy()
                left = np.repeat(w.rows[1:], np.diff(w.rows)) - np.arange(len(w.hash))  # words from here to the row's end
                for m in use:
                    h = _seed(w.hash, m)
                    k = (h & U(len(bits) * 8 - 1)).astype(np.int64)
                    at = np.flatnonzero((bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1)
                    at = at[left[at] >= len(m)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row[at]]), pa.array(h[at].view(np.int64)), pa.array((at - w.rows[row[at]]).astype(np.int32))], ["doc", "seed", "at"])

    return rows.select("doc", "text").mapInArrow(roomy(run), "doc long, seed long, at int")


def _longest(match: np.ndarray, share: float) -> tuple[int, int]:
    """The longest range that begins and ends with matches and in which at least ``share`` of positions match."""
    if not match.any():
        return 0, 0
    steps = np.where(match, 1 - share, -share)
    p = np.concatenate([[0.0], np.cumsum(steps)]) + 1e-9 * np.arange(len(match) + 1)
    low = np.minimum.accumulate(np.where(match, p[:-1], np.inf))
    begin = np.searchsorted(-low, -p[1:], side="left")
    j = int(np.argmax(np.where(match, np.arange(1, len(p)) - begin, 0)))
    return int(begin[j]), j + 1


def _agreeing(at: np.ndarray, n: np.ndarray, own: np.ndarray, where: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many of ``n`` words from ``at`` in ``own`` equal those from ``where`` in ``words``, for each row."""
    out, ends = np.zeros(len(n), np.int64), np.cumsum(n)
    i = 0
    while i < len(n):
        before = ends[i] - n[i]
        j = max(i + 1, int(np.searchsorted(ends, before + (1 << 21), "right")))  # bounded memory
        k = np.arange(ends[j - 1] - before) - np.repeat(ends[i:j] - n[i:j] - before, n[i:j])
        same = own[np.repeat(at[i:j], n[i:j]) + k] == words[np.repeat(where[i:j], n[i:j]) + k]
        out[i:j] = np.bincount(np.repeat(np.arange(j - i), n[i:j]), same, j - i)
        i = j
    return out


def verify(texts: pa.Array, items: pa.Array, shifts: pa.ListArray, min_overlap: int, share: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, first word, words, matching words) of each row whose text and item overlap in one of the alignments ``shifts``
    (the item's first word stands at that word of the text): the longest overlap."""
    low = _lower(texts)
    for i, j in slices(low):
        w, v = Words(low.slice(i, j - i), alnum=True), Words(_lower(items.slice(i, j - i)), alnum=True)
        some = shifts.slice(i, j - i)
        row, shift = pc.list_parent_indices(some).to_numpy().astype(np.int64), pc.list_flatten(some).to_numpy().astype(np.int64)
        size, begin = np.diff(v.rows)[row], np.maximum(0, -shift)
        n = np.minimum(size, np.diff(w.rows)[row] - shift) - begin
        least = np.minimum(min_overlap, size)
        agree = _agreeing(w.rows[row] + shift + begin, n, w.hash, v.rows[row] + begin, v.hash)
        best: dict[int, tuple[int, int, int]] = {}
        use = np.flatnonzero((n >= least) & (agree >= share * least - 1e-9))
        for r, s in sorted(zip(row[use].tolist(), shift[use].tolist(), strict=True)):
            own, words = w.hash[w.rows[r] : w.rows[r + 1]], v.hash[v.rows[r] : v.rows[r + 1]]
            a, b = max(0, -s), min(len(words), len(own) - s)
            match = own[s + a : s + b] == words[a:b]
            x, y = _longest(match, share) if len(words) > min_overlap else (0, len(words))
            new = y - x, int(match[x:y].sum()), s + a + x
            if y - x >= min(min_overlap, len(words)) and new[:2] > best.get(r, (0, 0))[:2]:
                best[r] = new
        for r, (size, matching, first) in best.items():
            yield i + r, first, size, matching


def overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, share: float = 0.8, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Contaminated documents only, one row per document and item: doc_id, item_id, first_word, n_words, n_matching.

    An overlap is a range of at least ``min_overlap`` words that begins and ends with words that agree, or
    the whole of an item that has no more words, whatever its ends; ``share`` of its words agree. None is
    missed. The longest is given, of those the one with most words that agree, of those the first. Words are runs of letters
    and digits in lower case. Items with fewer than ``min_words`` words or none, and null texts, match nothing; repeated
    documents are reported each, repeated items once. Whole texts are searched. Empty tables give no rows."""
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    seeds = materialise(item_seeds(items, min_overlap, share, min_words), "seeds")
    use = sorted(r.mask for r in seeds.select("mask").distinct().collect())  # a few for each length up to min_overlap
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").withColumn("doc", F.xxhash64("doc_id", "text"))
    hits = document_seeds(rows, use, bitmap(seeds)).join(seeds.select("seed", "item", "pos"), "seed")
    pairs = hits.groupBy("doc", "item").agg(F.collect_set(F.col("at") - F.col("pos")).alias("shifts"))
    pairs = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, first_word long, n_words long, n_matching long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(verify(b.column("text"), b.column("item_text"), b.column("shifts"), min_overlap, share))
            if found:
                at, *cols = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("doc_id", "item_id")), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "item_id", "first_word", "n_words", "n_matching"])

    return rows.join(pairs, "doc").select("doc_id", "text", "item_id", "item_text", "shifts").mapInArrow(roomy(run), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that :func:`overlaps` wouldn't report. Rows of null text stay."""
    name = fresh("found", docs)
    key = F.struct(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")))
    found = overlaps(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, id_col="key", **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, key.eqNullSafe(F.col(name)), "left_anti")
