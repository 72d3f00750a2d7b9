"""Token ids of whole texts by the ``tokenizers`` library, each distinct chunk of a batch encoded once.

Both vocabularies cut a text at white space before they merge, so a text can be cut in front of a
single space or newline between two other characters: the ids of the chunks, one after the other,
are those of the text. The chunks of some megabytes of text lie in one Arrow array without a copy;
its dictionary goes through the library, many chunks to a call, and the ids are gathered back by
index. Short chunks are remembered in arrays of bounded size, from which those seen least go first."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import flat, slices

#: Bytes of text that are encoded at once, and bytes of joined chunks to a call of the library.
AT_ONCE, TO_A_CALL = 4_000_000, 2_000
#: Chunks that are remembered (some 50 bytes each), their ids, and the longest such chunk in bytes.
REMEMBERED, REMEMBERED_IDS, SHORT = 800_000, 5_000_000, 64
#: White space beyond ASCII, and control characters that some rules count as such: their texts go through the library whole.
_ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters beyond these may be normalised together with their neighbours; such texts go through the library whole too.
_UNSAFE = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{12f}\x{132}-\x{17f}\x{410}-\x{44f}\x{4e00}-\x{9fff}]"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ready: dict[str, ChunkTokenizer] = {}


class ChunkTokenizer:
    """``encode(column)``: the ids of all texts, one after the other, and where each text's begin."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.none = self.tokenizer.normalizer, normalizers.Sequence([])
        self._remember(pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        self.tokenizer.encode_special_tokens = True
        #: The kind that drops white space, normalises and marks word ends; the other keeps a space with the word after it.
        self.drops_space = self.normalizer is not None
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        if self.drops_space:
            #: A word with an id of its own, put behind each chunk: it shows where the chunk's ids end.
            word, self.stop = max((x, i) for i, x in enumerate(names) if x.endswith("</w>") and x[:-4].isascii() and x[:-4].isalpha() and len(x) > 9 and self._ids([x[:-4]])[0].tolist() == [i])
            self.between = f" {word[:-4]}".encode()
            self.tokenizer.normalizer = self.none  # chunks come in lower case and need nothing more
        else:
            #: Ids that begin with the space or newline in front of a chunk.
            self.begins = np.array([x.startswith(("Ġ", "Ċ")) for x in names])
            self.between = b""

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, chunks: pa.Array, ids: np.ndarray, at: np.ndarray, seen: np.ndarray) -> None:
        """``at``: where each chunk's ids end; ``seen``: in how many batches it was, 255 at most."""
        self.known, self.known_ids, self.known_at, self.seen = chunks, ids, at, seen

    def _joined(self, chunks: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and their number for plain chunks, which go through the library some thousand bytes to a text."""
        sizes, cuts = np.cumsum(pc.binary_length(chunks).to_numpy()), [0]
        while cuts[-1] < len(chunks):
            i = cuts[-1]
            cuts.append(max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + TO_A_CALL))))
        parts = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), chunks)
        texts = [(x + self.between).decode() for x in pc.binary_join(parts, pa.scalar(self.between, chunks.type)).to_pylist()]
        out = []
        for i, j, ids in zip(cuts[:-1], cuts[1:], self._ids(texts), strict=True):
            if self.drops_space:
                at = np.flatnonzero(ids == self.stop)
                ends, ids = at - np.arange(len(at)), np.delete(ids, at)
            else:
                ends = np.append(np.flatnonzero(self.begins[ids])[1:], len(ids))
            if len(ends) == j - i:
                out.append((ids, np.diff(ends, prepend=0)))
            else:  # a chunk holds the mark itself
                each = self._ids([x.decode() for x in chunks.slice(i, j - i).to_pylist()])
                out.append((np.concatenate(each), np.array([len(x) for x in each])))
        return out

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks not remembered, with each one's place and number."""
        raw, at = flat(chunks)
        space = _SPACE[raw]
        n_space = np.concatenate([[0], np.cumsum(space)])[at]
        plain = space[at[:-1]] & (np.diff(n_space) == 1) & (np.diff(at) > 1)
        where = np.flatnonzero(plain)
        parts, order = self._joined(chunks.take(pa.array(where))) if len(where) else [], [where]
        where = np.flatnonzero(~plain)
        if len(where):
            each = self._ids([x.decode() for x in chunks.take(pa.array(where)).to_pylist()])
            parts += [(x, np.array([len(x)])) for x in each]
            order.append(where)
        order, counts = np.concatenate(order), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        number, place = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        number[order], place[order] = counts, np.cumsum(counts) - counts
        return np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in parts)]), place, number

    def _dictionary(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of the distinct chunks, with each chunk's place and number."""
        at = pc.index_in(chunks, value_set=self.known)
        old, known_at = at.is_valid().to_numpy(zero_copy_only=False), np.concatenate([[0], self.known_at])
        place, number = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        k = at.drop_null().to_numpy()
        place[old], number[old] = known_at[k], known_at[k + 1] - known_at[k]
        self.seen[k] += self.seen[k] < 255
        fresh = chunks.filter(pa.array(~old))
        ids, new_place, new_number = self._new(fresh)
        place[~old], number[~old] = new_place + len(self.known_ids), new_number
        every = np.concatenate([self.known_ids, ids])
        short = pc.binary_length(fresh).to_numpy() <= SHORT
        self._store(fresh.filter(pa.array(short)), ids, new_place[short], new_number[short])
        return every, place, number

    def _store(self, chunks: pa.Array, ids: np.ndarray, place: np.ndarray, number: np.ndarray) -> None:
        ends = np.cumsum(number)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(place - (ends - number), number)
        self._remember(pa.concat_arrays([self.known, chunks]), np.concatenate([self.known_ids, ids[take]]), np.concatenate([self.known_at, ends + len(self.known_ids)]), np.concatenate([self.seen, np.ones(len(chunks), np.uint8)]))
        if len(self.known) <= REMEMBERED and len(self.known_ids) <= REMEMBERED_IDS:
            return
        least = 2
        while (keep := self.seen >= least).sum() > len(self.seen) // 2:
            least += 1
        number = np.diff(self.known_at, prepend=0)
        self._remember(self.known.filter(pa.array(keep)), self.known_ids[np.repeat(keep, number)], np.cumsum(number[keep]), np.maximum(self.seen[keep] // 2, 1))

    def _chunked(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut, and where each text's begin."""
        if self.drops_space:
            col = pc.utf8_lower(col)
        raw, at = flat(col)
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(col) + 1, np.int64)
        space = _SPACE[raw]
        cut = np.zeros(n, bool)
        cut[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
        if not self.drops_space:
            cut &= (raw == 32) | (raw == 10)
        # No cut has its neighbour in another text; each text begins a chunk.
        edges = at[(at > 0) & (at < n)]
        cut[edges - 1] = False
        cut[at[:-1][np.diff(at) > 0]] = True
        begins = np.flatnonzero(cut)
        offsets = np.append(begins, n)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = chunks.dictionary_encode()
        ids, place, number = self._dictionary(coded.dictionary)
        index = coded.indices.to_numpy()
        count = number[index]
        ends = np.cumsum(count)
        take = np.arange(ends[-1]) + np.repeat(place[index] - (ends - count), count)
        first = np.searchsorted(begins, at)
        return ids[take], np.append(ends - count, ends[-1])[first]

    def _some(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(col, _UNSAFE if self.drops_space else _ODD_SPACE).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._chunked(col)
        ids, at = self._chunked(col.filter(pa.array(~odd)))
        if self.drops_space:
            self.tokenizer.normalizer = self.normalizer
        whole = iter(self._ids(col.filter(pa.array(odd)).to_pylist()))
        if self.drops_space:
            self.tokenizer.normalizer = self.none
        cut = iter(np.split(ids, at[1:-1]) if len(at) > 1 else [])
        each = [next(whole) if x else next(cut) for x in odd]
        return np.concatenate(each), np.cumsum([0, *map(len, each)])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Null reads as empty; both have no ids."""
        col = pc.fill_null(col.cast(pa.large_string()), "")
        ids, at, before = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for i, j in slices(col, AT_ONCE, len(col)):
            got, ends = self._some(col.slice(i, j - i))
            ids.append(got)
            at.append(ends[1:] + before)
            before += int(ends[-1])
        return np.concatenate(ids), np.concatenate(at)


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """The process's tokenizer for this file; one file is held at a time."""
    if path not in _ready:
        _ready.clear()
        _ready[path] = ChunkTokenizer(path)
    return _ready[path]


def forget() -> None:
    _ready.clear()


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each text's ids."""
    return np.insert(ids, at[1:], end_id).astype("<u4"), at + np.arange(len(at))
