"""Secret scan with a worklist of decoded layers.

A text is a layer, and so is what its URL escapes, Unicode escapes and base64 runs (plain or
compressed) hide. Every layer not seen before at its place is scanned and unwrapped again until
nothing new appears. Each character of a layer knows its range in the original text, so a find maps
back; the same content from two places is two layers."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, roomy

KINDS = ("assign", "access", "hex")
#: Patterns and least lengths (of group 2 for assign, of the match for the others).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = (6, 20, 24)
#: What a text must hold, for a linear-time engine, before the patterns are tried on it.
NEEDS = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")
NEEDS_DECODING = r"\x1f|%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|[A-Za-z0-9+/_-]{16}"
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
#: A base64 run may go on over single line breaks, indented or not.
BASE64 = tuple(re.compile(rf"[{x}]{{16,}}+(?:\r?\n[\x20\t]*[{x}]++)*+={{0,2}}") for x in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
LINE, HIDES = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(NEEDS_DECODING + r"|BZh[1-9]1AY&SY|7zXZ|x[\x01\x5e\x9c\xda]")
#: How compressed data begin: gzip, bzip2 and xz in any layer, zlib, of two bytes, in all but the text itself.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
PACKED_HIDDEN = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
BYTES = re.compile("[\x00-\xff]+")
#: Decompressed content is scanned in pieces of about so many bytes, cut behind a byte marked in APART; where so many have none, pieces overlap.
PIECE, STRETCH, OVERLAP = 1 << 20, 1 << 24, 1 << 16
APART = np.array([not re.match(rb"""[A-Za-z0-9+/_.=\-"'\x20\t\r\n:%\\]""", bytes([c])) for c in range(256)])
PRINTABLE = bytes(c for c in range(256) if 32 <= c < 127 or c in (9, 10, 13) or c >= 128)


def find(text: str, which: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each match that is long enough, in order; leftmost, non-overlapping per kind."""
    out = []
    if which[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST[0]]
    if which[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST[1]]
    if which[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST[2]]
    return sorted(out)


def _utf8(raw: bytes) -> list[tuple[str, int, int]]:
    """Characters of bytes with their byte ranges; bytes that are no UTF-8 become U+FFFD one by one."""
    out, at = [], 0
    for ch in raw.decode("utf-8", "surrogateescape"):
        n = 1 if "\udc80" <= ch <= "\udcff" else len(ch.encode("utf-8"))
        out.append(("�" if n == 1 and ch > "\x7f" else ch, at, at + n))
        at += n
    return out


def _unescape(text: str, starts: np.ndarray, ends: np.ndarray, run: re.Pattern, chars) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The layer with each run of escapes replaced by its characters; ``chars`` gives them with ranges in the run."""
    parts, s, e, at = [], [], [], 0
    for m in run.finditer(text):
        parts.append(text[at : m.start()])
        s.append(starts[at : m.start()])
        e.append(ends[at : m.start()])
        new = chars(m[0])
        parts.append("".join(c for c, _, _ in new))
        s.append(np.array([starts[m.start() + a] for _, a, _ in new], np.int64))
        e.append(np.array([ends[m.start() + b - 1] for _, _, b in new], np.int64))
        at = m.end()
    if not at:
        return None
    return "".join([*parts, text[at:]]), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]])


def _url(run: str) -> list[tuple[str, int, int]]:
    return [(c, 3 * a, 3 * b) for c, a, b in _utf8(bytes.fromhex(run.replace("%", "")))]


def _url_bytes(run: str) -> list[tuple[str, int, int]]:
    return [(chr(c), 3 * i, 3 * i + 3) for i, c in enumerate(bytes.fromhex(run.replace("%", "")))]


def _unicode(run: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for m in UNICODE_ONE.finditer(run):
        code = int(m[1] or m[2] or m[3], 16)
        if out and 0xDC00 <= code < 0xE000 and "\ud800" <= out[-1][0] < "\udc00":  # a surrogate pair
            high = out.pop()
            out.append((chr(0x10000 + ((ord(high[0]) - 0xD800) << 10) + code - 0xDC00), high[1], m.end()))
        else:
            out.append((chr(code) if code < 0x110000 else "�", m.start(), m.end()))
    return out


def _decompressor(raw: bytes):
    """One for data that begin like gzip, zlib, bzip2 or xz; None for others."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if raw[:6] == b"\xfd7zXZ\x00" else None


def _member(raw: bytes, step: int) -> Iterator[tuple[bytes, int]]:
    """The content of the member at the start of ``raw`` in parts, each with 0, or the member's length where it ends."""
    d = _decompressor(raw)
    for i in range(0, len(raw), step):
        more = data = raw[i : i + step]
        while more or data:
            data = d.decompress(more, PIECE)
            yield data, min(i + step, len(raw)) - len(d.unused_data) if d.eof else 0
            if d.eof:
                return
            more = getattr(d, "unconsumed_tail", b"")


def _inflate(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """The content of all compressed members in a row, in parts, each with the end of the last whole member so far.
    Of a damaged member all that comes before the damage."""
    at = 0
    while _decompressor(raw[at : at + 6]) is not None:
        given = used = 0
        for step in (1 << 16, 1):  # byte by byte if an error took a larger step's content with it
            n = 0
            try:
                for data, used in _member(raw[at:], step):
                    n += len(data)
                    if n > given:
                        yield data[len(data) - (n - given) :], at
                        given = n
                break
            except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
                pass
        if not used:
            return
        at += used
        yield b"", at
        while raw[at : at + 1] == b"\0":  # padding between members
            at += 1


def _stream(parts: Iterator[bytes], step: int = 1 << 12) -> Iterator[bytes]:
    """The content of all compressed members in a row of a stream that comes in parts; of a damaged member all that
    comes before the damage. Memory is that of a part, however much it unpacks to."""
    held = b"".join(islice(parts, 1))
    while len(held) < 6 and (more := next(parts, None)) is not None:
        held += more
    while (d := _decompressor(held[:6])) is not None:
        while not d.eof:
            if not held:
                if (held := next(parts, None)) is None:
                    return
                continue
            before = d.copy() if hasattr(d, "copy") else None
            more, held = held[:step], held[step:]
            try:
                while more or getattr(d, "needs_input", True) is False:
                    yield d.decompress(more, PIECE)
                    if d.eof:
                        break
                    more = getattr(d, "unconsumed_tail", b"")
            except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
                if before is not None and step > 1:
                    yield from _last_words(before, more)
                return
        held = (d.unused_data + held).lstrip(b"\0")
        while len(held) < 6 and (more := next(parts, None)) is not None:
            held = (held + more).lstrip(b"\0")


def _last_words(d, damaged: bytes) -> Iterator[bytes]:
    """What bytes give, one by one, up to the one that is damaged."""
    try:
        for i in range(len(damaged)):
            yield d.decompress(damaged[i : i + 1])
    except zlib.error:
        return


def _skipped(parts: Iterator[bytes], n: int) -> Iterator[bytes]:
    """A stream without its first ``n`` bytes."""
    for part in parts:
        if n < len(part):
            yield part[n:]
        n = max(0, n - len(part))


def _pieces(parts: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """Parts joined to pieces, each with its place, cut behind bytes that no secret, escape or base64 run holds.
    Stretches that have none are kept whole up to ``STRETCH`` bytes; beyond, pieces overlap."""
    held, at = bytearray(), 0
    for part in parts:
        new = len(held)
        held += part
        if len(held) >= PIECE:
            apart = np.flatnonzero(APART[np.frombuffer(bytes(held[new:]), np.uint8)]) + new
            cut = int(apart[-1]) + 1 if len(apart) else 0
            if cut or len(held) >= STRETCH:
                yield at, bytes(held[: cut or len(held)])
                gone = cut or len(held) - OVERLAP
                at += gone
                del held[:gone]
    yield at, bytes(held)


def _unpacked(content: Callable[[], Iterator[bytes]], chain: frozenset[int] = frozenset()) -> Iterator[tuple[bytes, bool]]:
    """The pieces of a content, and those of all that is compressed in it, at any depth and place, each with whether
    it begins a content. Content that has itself inside ends there."""
    tail, opened = b"", set()
    for i, (at, piece) in enumerate(_pieces(content())):
        if not i:
            if hash(piece) in chain:
                return
            chain |= {hash(piece)}
        yield piece, i == 0
        inside = [at - len(tail) + m.start() for m in PACKED_HIDDEN.finditer(tail + piece)]
        if not i and _decompressor(piece[:6]) is not None and inside[:1] != [0]:
            inside.insert(0, 0)
        for p in inside:
            if p not in opened:
                opened.add(p)
                yield from _unpacked(lambda p=p: _stream(_skipped(content(), p)), chain)
        tail = piece[-9:]


def _readable(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return bool(raw) and len(raw.translate(None, PRINTABLE)) <= 0.05 * len(raw)


def _decode(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _base64_layers(text: str, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, bool]]:
    """What each base64 run holds, byte by byte as characters (all that is searched for is ASCII), and whether
    that reads as text. A run of several lines is read line by line and as a whole, from each line on."""
    seen = set()
    for pattern in BASE64:
        for m in pattern.finditer(text):
            if m.span() in seen:
                continue
            seen.add(m.span())
            lines = [c.span() for c in LINE.finditer(text, *m.span())]
            body = "".join(text[a:b] for a, b in lines).replace("-", "+").replace("_", "/")
            at = np.concatenate([np.arange(a, b) for a, b in lines])
            offsets = np.cumsum([0, *(b - a for a, b in lines)]).tolist()
            close = ends[m.end() - 1]  # with the padding
            alone = [(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a >= 16]
            whole = [(a, len(body)) for a in offsets[:-1]] if len(lines) > 1 else []
            phases, opened, single = set(), 0, set()
            for a, b in alone + whole:
                joined = b == len(body) and (a, b) not in alone
                if _decompressor(_decode(body[a : a + 8])) is not None and not (joined and (a < opened or a in single)):
                    raw, parts, size, end = _decode(body[a:b]), [], 0, 0
                    for part, end in _inflate(raw):
                        size += len(part)
                        if size <= PIECE:
                            parts.append(part)
                    if size:  # any byte of it depends on all that is compressed
                        to = a + -(-(end or len(raw)) * 4 // 3)
                        if end and joined:
                            opened = to
                        elif end == len(raw):
                            single.add(a)
                        s, e = starts[at[a]], close if to >= len(body) else ends[at[to - 1]]
                        yield from _content(lambda parts=parts, size=size, raw=raw: iter(parts) if size <= PIECE else (x for x, _ in _inflate(raw)), s, e)
                if joined and a % 4 in phases:  # already read from an earlier line on
                    continue
                if joined:
                    phases.add(a % 4)
                raw = _decode(body[a:b])
                k = np.arange(len(raw))
                yield raw.decode("latin-1"), starts[at[a + k * 4 // 3]], ends[at[a + np.minimum(-(-(k + 1) * 4 // 3), b - a) - 1]], _readable(raw)


def _content(content: Callable[[], Iterator[bytes]], s: int, e: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Layers of what compressed data between ``s`` and ``e`` hold: any byte depends on all of them."""
    for piece, first in _unpacked(content):
        yield piece.decode("latin-1"), np.broadcast_to(s, len(piece)), np.broadcast_to(e, len(piece)), first and _readable(piece)


def _packed_layers(text: str, starts: np.ndarray, ends: np.ndarray, pattern: re.Pattern, first: int = 0) -> Iterator[tuple[str, np.ndarray, np.ndarray, bool]]:
    """What compressed data in a layer hold whose characters stand for bytes."""
    for run in BYTES.finditer(text):
        raw, to = run[0].encode("latin-1"), first
        for m in pattern.finditer(raw):
            if m.start() < to:  # a member that follows another, which has been read
                continue
            size = end = 0
            for part, end in _inflate(raw[m.start() :]):
                size += len(part)
            if size:
                to = m.start() + (end or len(raw) - m.start())
                rest = raw[m.start() :]
                yield from _content(lambda rest=rest: (x for x, _ in _inflate(rest)), starts[run.start() + m.start()], ends[run.start() + to - 1])


def _layers(text: str, starts: np.ndarray, ends: np.ndarray, packed: re.Pattern = PACKED_HIDDEN) -> Iterator[tuple[str, np.ndarray, np.ndarray, bool]]:
    for run, chars in ((URL_RUN, _url), (UNICODE_RUN, _unicode)):
        new = _unescape(text, starts, ends, run, chars)
        if new is not None:
            yield *new, True
            as_bytes = _unescape(text, starts, ends, run, _url_bytes) if run is URL_RUN else new
            yield from _packed_layers(*as_bytes, PACKED_HIDDEN)
    yield from _packed_layers(text, starts, ends, packed, 1)  # what a base64 run begins with is opened there
    yield from _base64_layers(text, starts, ends)


def _place(layer: str, starts: np.ndarray, ends: np.ndarray) -> int:
    """A layer's content and where each of its characters comes from."""
    return hash((layer, starts.tobytes(), ends.tobytes()))


def scan(text: str, base: list[tuple[int, int, int]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(spans of the text as it is, all spans, number of hidden layers that read as text or hold a secret).

    Every layer is scanned whole, whatever it holds and however large it is; large ones come in pieces,
    so that decompression bombs cost time but no memory."""
    base = find(text) if base is None else base
    first = text, np.arange(len(text)), np.arange(1, len(text) + 1)
    spans, seen, layers, work = set(base), {_place(*first)}, 0, [_layers(*first, PACKED)]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        *layer, readable = new
        if (place := _place(*layer)) in seen:
            continue
        seen.add(place)
        found = find(layer[0])
        layers += bool(readable or found)
        spans.update((int(layer[1][s]), k, int(layer[2][e - 1])) for s, k, e in found)
        if HIDES.search(layer[0]):
            work.append(_layers(*layer))
    return base, sorted(spans), layers


def _scan_column(col: pa.Array) -> Iterator[tuple[str, list, list, int]]:
    """For each text of the column (null: empty): itself, base spans, all spans, hidden layers."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    need = [pc.match_substring_regex(col, p).to_pylist() for p in (*NEEDS, NEEDS_DECODING)]
    for i, (a, b, c, d) in enumerate(zip(*need, strict=True)):
        if not (a or b or c or d):
            yield "", [], [], 0
            continue
        text = col[i].as_py()
        base = find(text, (a, b, c)) if a or b or c else []
        yield (text, *(scan(text, base) if d else (base, base, 0)))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the count of each kind in the text itself, a digest of those spans, all
    spans with those of hidden layers, and the number of hidden layers. Spans are code points of the
    original text, end exclusive. Null or empty texts have none. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, layers = [], [], [], []
            for _, base, every, n in _scan_column(b.column("text")):
                counts.append([sum(k == i for _, k, _ in base) for i in range(3)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                layers.append(n)
            c = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(layers, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_layers"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(roomy(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with each span of a secret replaced by ``mark`` (overlapping spans by
    one) and the length column, if there is one, brought up to date. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(text_col)
            texts = None
            for i, (text, _, every, _) in enumerate(_scan_column(col)):
                if not every:
                    continue
                texts = col.to_pylist() if texts is None else texts
                parts, at = [], 0
                for s, _, e in every:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                texts[i] = "".join([*parts, text[at:]])
            yield b if texts is None else b.set_column(b.schema.get_field_index(text_col), text_col, pa.array(texts, col.type))

    out = docs.mapInArrow(roomy(run), docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType)))
    return out
