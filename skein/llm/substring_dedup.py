"""Removal of repeated passages by relative Lempel-Ziv parsing of documents against reference blocks.

The corpus is dealt into blocks of bounded size, each of which is a reference with an index: the
64-bit hashes of its windows of k words and their positions. An exchange of these hashes by ranges
tells each block which of its windows may start elsewhere and names, for windows found only once in
the block itself, one other block that has them. Such a block sends the passages asked for, so that
every document meets the reference blocks that can matter and no others.

Then each document is parsed greedily from left to right. Where a window has a reference position,
the words from there on are compared one by one and the longest match becomes a factor (start,
length, reference position); where it has none, or the words differ, the word is a literal. Windows
that start in a factor and end behind it are looked up on their own: the next factor begins at the
first of them that has a reference. So each factor of at least k words is a duplicate span, and no
repeated window is lost at a factor's boundary."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACE, U, Words, slices

#: What a row between blocks holds: answers to a block's hashes, a request for passages, or passages.
ANSWER, REQUEST, PASSAGES = 0, 1, 2


class Reference:
    """Texts with their words in canonical form (one space between words) and the index of their windows."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, k: int):
        self.k = k
        canon, hashes, starts, ends, rows, at, windows = [], [], [], [], [np.zeros(1, np.int64)], [], []
        n_bytes = n_words = 0
        for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
            for i, j in slices(chunk):
                w = Words(chunk.slice(i, j - i))
                inside = ~SPACE[w.raw]
                keep = inside.copy()
                keep[1:] |= inside[:-1]  # what follows a word stands for one space
                out = w.raw[keep]
                out[SPACE[out]] = 32
                place = (np.cumsum(keep) - keep)[w.starts]
                canon.append(out)
                starts.append(place + n_bytes)
                ends.append(place + (w.ends - w.starts) + n_bytes)
                h, ok = w.windows(k)
                hashes.append(w.hash)
                windows.append(h)
                at.append(np.flatnonzero(ok) + n_words)
                rows.append(w.rows[1:] + n_words)
                n_bytes += len(out)
                n_words += len(w.hash)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        self.canon, self.hash, self.rows = join(canon, np.uint8).tobytes(), join(hashes, np.uint64), np.concatenate(rows)
        self.starts, self.ends, self.at, self.windows = join(starts, np.int64), join(ends, np.int64), join(at, np.int64), join(windows, np.uint64)

    @cached_property
    def order(self) -> np.ndarray:
        """The windows by hash, of equals by position."""
        return np.argsort(self.windows, kind="stable")

    @cached_property
    def first(self) -> np.ndarray:
        """Where in ``order`` each distinct hash begins."""
        windows = self.windows[self.order]
        new = np.ones(len(windows), bool)
        new[1:] = windows[1:] != windows[:-1]
        return np.flatnonzero(new)

    @cached_property
    def distinct(self) -> np.ndarray:
        return self.windows[self.order[self.first]]

    @cached_property
    def counts(self) -> np.ndarray:
        """How often each distinct hash occurs."""
        return np.diff(np.append(self.first, len(self.windows)))

    def text(self, start: int, end: int) -> bytes:
        """The words from ``start`` up to ``end``."""
        return self.canon[self.starts[start] : self.ends[end - 1]] if end > start else b""

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The first position of each window, or -1."""
        if not len(self.distinct):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.distinct, hashes), len(self.distinct) - 1)
        return np.where(self.distinct[i] == hashes, self.at[self.order[self.first[i]]], -1)

    def elsewhere(self) -> np.ndarray:
        """For each window in ``order``: another position of the same hash in these texts (the first, or of the first the second), or -1."""
        group = np.repeat(np.arange(len(self.first)), self.counts)
        lead = self.first[group]
        other = np.where(np.arange(len(self.order)) == lead, np.minimum(lead + 1, max(len(self.order) - 1, 0)), lead)
        return np.where(self.counts[group] > 1, self.at[self.order[other]] if len(self.order) else -1, -1)


def _match(a: Reference, i: int, a_end: int, b: Reference, p: int, b_end: int) -> int:
    """How many words agree from ``i`` in a and ``p`` in b."""
    most, n, step = min(a_end - i, b_end - p), 0, 64
    while n < most:
        m = min(step, most - n)
        differs = a.hash[i + n : i + n + m] != b.hash[p + n : p + n + m]
        if differs.any():
            n += int(differs.argmax())
            break
        n, step = n + m, step * 4
    # The words themselves decide: equal hashes of unequal words end the match.
    while n and a.text(i, i + n) != b.text(p, p + n):
        n = next((m for m in range(n) if a.text(i + m, i + m + 1) != b.text(p + m, p + m + 1)), n)
    return n


def parse(own: Reference, foreign: Reference, asked: np.ndarray) -> list[tuple[int, int, bool, int]]:
    """The factors (start, words, whether in ``own``, reference position) of all texts of ``own``, greedily from the left.

    ``asked``: for each distinct hash of ``own``, whether its window may start elsewhere."""
    near = own.elsewhere()
    of = np.repeat(asked, own.counts)
    where, near = own.order[of], near[of]
    far = foreign.find(np.repeat(own.distinct, own.counts)[of])
    by_start = np.argsort(own.at[where])
    starts, near, far = own.at[where][by_start].tolist(), near[by_start].tolist(), far[by_start].tolist()
    row_end = own.rows[np.searchsorted(own.rows, starts, "right")].tolist()
    near_end = own.rows[np.minimum(np.searchsorted(own.rows, near, "right"), len(own.rows) - 1)].tolist()
    far_end = foreign.rows[np.minimum(np.searchsorted(foreign.rows, far, "right"), len(foreign.rows) - 1)].tolist()
    out, n = [], 0
    while n < len(starts):
        i, best = starts[n], (0, True, 0)
        for inside, p, end in ((True, near[n], near_end[n]), (False, far[n], far_end[n])):
            if p >= 0:
                best = max(best, (_match(own, i, row_end[n], own if inside else foreign, p, end), inside, p))
        if best[0] >= own.k:
            out.append((i, *best))
            n = bisect_left(starts, i + best[0] - own.k + 1, n + 1)  # the first window that ends behind the factor
        else:
            n += 1
    return out


def _parts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range, of ``ranges`` equal ones, of each hash."""
    return ((hashes >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True)) if len(keys) else []


def _between(rows: list[tuple]) -> pa.Table:
    """Rows (block, kind, part, data, who) as a table."""
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.binary()] * 2, strict=True)], ["block", "kind", "part", "data", "who"])


def _answer(table: pa.Table) -> list[tuple]:
    """One hash range: what each block is told, and which passages it asks of which block."""
    blocks = table.column("block").to_numpy()
    each = [np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()]
    sizes = [len(x) for x in each]
    hashes, block = np.concatenate(each), np.repeat(blocks, sizes)
    again = np.concatenate([_flags(x, n) for x, n in zip(table.column("again").to_pylist(), sizes, strict=True)])
    order = np.lexsort((block, hashes))
    h, b = hashes[order], block[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(first, len(h)))[group]
    follows = np.arange(len(h)) + 1
    follows[follows == first[group] + size] -= size[follows == first[group] + size]  # behind the last comes the first
    several = np.zeros(len(h), bool)
    several[order] = size > 1
    part, at, out = int(table.column("part")[0].as_py()), 0, []
    for to, n in zip(blocks.tolist(), sizes, strict=True):
        out.append((to, ANSWER, part, _bits((several | again)[at : at + n]), b""))
        at += n
    wants = np.flatnonzero((size > 1) & ~again[order])
    asks, has = b[wants], b[follows[wants]]
    by_block = np.argsort(has, kind="stable")
    wants, asks, has = wants[by_block], asks[by_block], has[by_block]
    # One row for each block that is asked, whoever asks.
    out += [(int(has[i]), REQUEST, part, h[wants[i:j]].tobytes(), asks[i:j].astype("<i4").tobytes()) for i, j in _runs(has)]
    return out


def _serve(own: Reference, asks: np.ndarray) -> bytes:
    """The passages that hold the windows asked for, one to a line."""
    found = own.find(asks)
    at = np.unique(found[found >= 0])
    runs = zip(np.append(0, np.flatnonzero(np.diff(at) > 1) + 1), np.append(np.flatnonzero(np.diff(at) > 1), len(at) - 1), strict=True)
    return b"\n".join([own.text(int(at[i]), int(at[j]) + own.k) for i, j in runs] if len(at) else [])


def remove_repeats(docs: DataFrame, k: int = 35, block_chars: int = 6_000_000, range_windows: int = 1_000_000, digest: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, the kept words (or their sha256, if ``digest``) and the number of factors.

    A word is removed if a window of ``k`` words covers it whose sequence also starts anywhere else.
    Null or empty texts and those of fewer than k words lose nothing. Repeated rows are occurrences
    like others. An empty table gives no rows. Other columns are not read. ``block_chars`` and
    ``range_windows`` set the mean size of blocks and hash ranges; their numbers, and those of the
    tasks, grow with the input."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks, ranges = max(1, -(-chars // block_chars)), max(1, -(-chars // (7 * range_windows)))  # about 7 bytes a word
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    between = "block int, kind int, part int, data binary, who binary"

    def index(table: pa.Table) -> pa.Table:
        own, block = Reference(table.column("text"), k), table.column("block")[0].as_py()
        parts = _parts(own.distinct, ranges)
        runs = _runs(parts)
        return pa.table({
            "part": pa.array([int(parts[i]) for i, _ in runs], pa.int32()), "block": pa.array([block] * len(runs), pa.int32()),
            "data": pa.array([own.distinct[i:j].tobytes() for i, j in runs], pa.binary()), "again": pa.array([_bits(own.counts[i:j] > 1) for i, j in runs], pa.binary()),
        })

    def serve(table: pa.Table, requests: pa.Table) -> pa.Table:
        if not len(requests) or not len(table):
            return _between([])
        own = Reference(table.column("text"), k)
        who, hashes = (np.concatenate([np.frombuffer(x, t) for x in requests.column(c).to_pylist()]) for c, t in (("who", "<i4"), ("data", np.uint64)))
        order = np.argsort(who, kind="stable")
        return _between([(int(who[order[i]]), PASSAGES, -1, _serve(own, hashes[order[i:j]]), b"") for i, j in _runs(who[order])])

    def factor(table: pa.Table, told: pa.Table) -> pa.Table:
        own, told = Reference(table.column("text"), k), told.to_pylist()
        parts, asked = _parts(own.distinct, ranges), np.zeros(len(own.distinct), bool)
        for r in told:
            if r["kind"] == ANSWER:
                i, j = np.searchsorted(parts, [r["part"], r["part"] + 1])
                asked[i:j] = _flags(r["data"], j - i)
        foreign = Reference(pa.array([p for r in told if r["kind"] == PASSAGES for p in r["data"].split(b"\n")], pa.large_binary()), k)
        edge, factors = np.zeros(len(own.hash) + 1, np.int32), parse(own, foreign, asked)
        starts, sizes = (np.array([f[c] for f in factors], np.int64) for c in (0, 1))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + sizes, -1)
        gone = np.cumsum(edge)[:-1] > 0
        lost, n_factors = np.concatenate([[0], np.cumsum(gone)])[own.rows], np.searchsorted(starts, own.rows)
        kept = []
        for n, (a, b) in enumerate(zip(own.rows[:-1].tolist(), own.rows[1:].tolist(), strict=True)):
            if lost[n] == lost[n + 1]:
                kept.append(own.text(a, b))
                continue
            at = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([own.text(int(at[i]), int(at[j - 1]) + 1) for i, j in _runs(at - np.arange(len(at)))]))
        last = pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digest else pa.array([x.decode() for x in kept])
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(own.rows)), "n_removed": pa.array(np.diff(lost)), "kept_sha256" if digest else "kept": last.cast(pa.string()), "n_factors": pa.array(np.diff(n_factors))})

    asked = dealt.groupBy("block").applyInArrow(index, "part int, block int, data binary, again binary").repartition(ranges, "part")
    told = asked.groupBy("part").applyInArrow(lambda table: _between(_answer(table)), between)
    by_block = lambda df: df.repartition(blocks, "block").groupBy("block")
    passages = dealt.groupBy("block").cogroup(by_block(told.filter(F.col("kind") == REQUEST))).applyInArrow(serve, between)
    told = told.filter(F.col("kind") == ANSWER).unionByName(passages)
    return dealt.groupBy("block").cogroup(by_block(told)).applyInArrow(factor, f"doc_id {kind}, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string, n_factors long")
