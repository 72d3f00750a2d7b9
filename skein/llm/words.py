"""Words of whole texts as numpy arrays: positions and 64-bit hashes, one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the two polynomial hashes (over bytes, over words), and of their second family.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_MASK = 2**64 - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept and grown by the process)."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 2**64), U)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    up, down = _powers[base]
    return up[:n], down[:n]


def forget() -> None:
    """Drops the powers that long texts made grow."""
    for base in [b for b, (up, _) in _powers.items() if len(up) > 1 << 21]:
        del _powers[base]


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0], dtype=U, out=out[1:])
    return out


def ranges_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The hash of each range of what ``prefix`` was made from; equal content, equal hash."""
    return mix((prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts])


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and the offsets of its rows; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type not in (pa.large_string(), pa.large_binary()):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8).copy() if offsets is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(col: pa.Array, most: int = 2_000_000, rows: int = 500) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (or one row) and ``rows`` rows each, to bound memory."""
    _, at = flat(col)
    i = 0
    while i < len(col):
        j = max(i + 1, min(i + rows, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield i, j
        i = j


class Words:
    """Words of a slice of rows: byte range of each, hash of each, and where each row's begin.

    Words are maximal runs of other than space and \\x09-\\x0D (``alnum``: runs of ASCII letters
    and digits and of all bytes beyond ASCII). ``lower`` lower-cases A-Z."""

    def __init__(self, col: pa.Array, lower: bool = False, alnum: bool = False):
        raw, at = flat(col)
        if lower:
            raw = _LOWER[raw]
        n, inside = len(raw), (_ALNUM[raw] if alnum else ~SPACE[raw])
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = at[(at > 0) & (at < n)]
        before[edges] = after[edges - 1] = False
        self.raw, self.at = raw, at
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(self.starts, at)
        self._bytes = sums(_TABLE[raw], BYTE_BASE)
        self.hash = ranges_hash(self._bytes, self.starts, self.ends, BYTE_BASE)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def prefix_hash(self, n_bytes: int) -> np.ndarray:
        """The hash of each word's first bytes."""
        return ranges_hash(self._bytes, self.starts, np.minimum(self.starts + n_bytes, self.ends), BYTE_BASE)

    def windows(self, k: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words of one row, by start, and a mask: which word positions start one."""
        n = len(self.hash)
        ok = np.arange(n) + k <= np.repeat(self.rows[1:], np.diff(self.rows))
        p = sums(self.hash, base)
        s = np.flatnonzero(ok)
        return ranges_hash(p, s, s + k, base), ok


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row (ASCII lower case) as sorted 64-bit hashes, with row offsets.
    A row of fewer words has its whole sequence as one shingle; a row without words has none."""
    w = Words(col, lower=True)
    n_words = np.diff(w.rows)
    h, ok = w.windows(k)
    row = w.row_of()[ok]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        p = sums(w.hash, WORD_BASE)
        h = np.concatenate([h, ranges_hash(p, w.rows[short], w.rows[short + 1], WORD_BASE) ^ U(0x5851F42D4C957F2D)])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[first], row[first]
    return h, np.searchsorted(row, np.arange(len(n_words) + 1))
