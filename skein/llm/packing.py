"""Packing of token sequences into windows by the sum-of-squares rule.

Each task packs its own part of the documents, one after the other, without a shuffle. A document
fills as many whole windows as it can; its rest, of s tokens, goes into the fill level h for which
the sum over levels of the squared number of windows filled so far is least after h becomes h + s.
An array holds the count of each level. Windows still open at a task's end stay as the rule filled
them, but for the emptiest: their pieces are cut to top up the others. What is then left over is cut
into sequences of powers of two, which need no padding. Every piece says whether the rule placed it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import id_and_text
from .tokenizing import AT_ONCE, chunk_tokenizer, with_end
from .words import slices

#: Sequence ids: the task's number times this, and a count.
PER_TASK = 1 << 36


class Packer:
    """Pieces are (doc_id, start, doc_tokens, ids as bytes, recut); ``done`` gets (sequence number, offset, piece)."""

    def __init__(self, size: int, max_open: int):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, np.int64)  # of windows open at each fill level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open, self.n_sequences, self.done = 0, 0, []

    def close(self, pieces: list) -> None:
        offset = 0
        for p in pieces:
            self.done.append((self.n_sequences, offset, p))
            offset += len(p[3]) // 4
        self.n_sequences += 1

    def level_for(self, s: int) -> int:
        """The level that keeps the sum of squares least; of equals, the fullest."""
        n = self.size - s
        cost = np.where(self.count[: n + 1] > 0, 1 - 2 * self.count[: n + 1], self.size**4)
        cost[0] = 0
        cost[:n] += 2 * self.count[s : self.size] + 1
        return n - int(np.argmin(cost[::-1]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at, width = len(ids) // 4, 0, self.size * 4
        while len(ids) - at >= width:
            self.close([(doc_id, at // 4, total, ids[at : at + width], False)])
            at += width
        if at == len(ids):
            return
        piece = (doc_id, at // 4, total, ids[at:], False)
        s = total - at // 4
        h = self.level_for(s)
        window = []
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        window.append(piece)
        if h + s == self.size:
            self.close(window)
        else:
            self.open[h + s].append(window)
            self.count[h + s] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self.flush(self.max_open // 2)

    def flush(self, keep: int = 0) -> None:
        """Closes open windows, fullest first, until ``keep`` are left: the emptiest ones' pieces top them up.
        With none to keep, what is left over becomes sequences of powers of two."""
        windows = [w for level in reversed(self.open) for w in level]
        levels = [h for h in range(self.size, -1, -1) for _ in self.open[h]]
        first, last = 0, len(windows)
        spare: list = []  # pieces of the emptiest window, last first

        def fill(window: list, room: int) -> None:
            nonlocal last, spare
            while room:
                if not spare:
                    last -= 1
                    spare = windows[last][::-1]
                doc_id, start, total, ids, _ = spare.pop()
                n = min(room, len(ids) // 4)
                window.append((doc_id, start, total, ids[: n * 4], True))
                if n * 4 < len(ids):
                    spare.append((doc_id, start + n, total, ids[n * 4 :], True))
                room -= n

        left = sum(levels)
        while last - first > keep and left >= self.size:
            window, h = windows[first], levels[first]
            first += 1
            fill(window, self.size - h)
            self.close(window)
            left -= self.size
        rest = ([spare[::-1]] if spare else []) + windows[first:last]
        self.open, self.n_open = [[] for _ in range(self.size + 1)], 0
        self.count[:] = 0
        if keep:
            for window in rest:
                h = sum(len(p[3]) for p in window) // 4
                self.open[h].append(window)
                self.count[h] += 1
                self.n_open += 1
            return
        spare, windows, last = [p for window in reversed(rest) for p in reversed(window)], [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            fill(window, room)
            self.close(window)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 1024, max_open: int = 8192, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every whole text's ids and ``end_id`` into sequences of at most ``size`` tokens: one row per piece.

    Null or empty text: the end id alone. Null or repeated ids are packed like others; ids of any
    type stay as they are. ``max_open`` bounds the windows, of at most 4 * ``size`` bytes each, that a task
    keeps open: beyond it the fuller half is topped up by the emptiest. An empty table gives no rows. Other columns are not
    read. ``with_ids`` adds each piece's ids as little-endian 32-bit integers; ``recut`` marks pieces that
    topped up a window or make up a sequence of a power of two."""
    rows = id_and_text(docs, id_col, text_col)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "recut", *(["ids"] if with_ids else [])]
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in names[1:7]), T.StructField("recut", T.BooleanType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = chunk_tokenizer(tokenizer_path), Packer(size, max_open)
        first, kind = TaskContext.get().partitionId() * PER_TASK, None

        def out() -> pa.RecordBatch:
            done, packer.done = packer.done, []
            pieces = [p for _, _, p in done]
            longs = [[p[1] for p in pieces], [len(p[3]) // 4 for p in pieces], [zlib.crc32(p[3]) for p in pieces], [p[2] for p in pieces], [first + s for s, _, _ in done], [o for _, o, _ in done]]
            ids = [pa.array([p[3] for p in pieces], pa.binary())] if with_ids else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], kind), *(pa.array(c, pa.int64()) for c in longs), pa.array([p[4] for p in pieces], pa.bool_()), *ids], names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for i, j in slices(batch.column("text"), AT_ONCE, batch.num_rows):
                ids, at = with_end(*tokenizer.encode(batch.column("text").slice(i, j - i)), end_id)
                raw, at = ids.tobytes(), (at * 4).tolist()
                for d, a, b in zip(batch.column("doc_id").slice(i, j - i).to_pylist(), at[:-1], at[1:], strict=True):
                    packer.add(d, raw[a:b])
                yield out()
        packer.flush()
        if packer.done:
            yield out()

    return rows.mapInArrow(run, schema)
