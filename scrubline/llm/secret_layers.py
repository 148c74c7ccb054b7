"""Secrets in texts and in what is encoded in them.

Every text is scanned with three patterns.  Then a worklist unwraps layers:
percent escapes, Unicode and character escapes, base64 runs, and compressed
data inside any of them.  Each unwrapped layer is scanned in turn and goes
back on the list, until nothing new comes out.  A layer is known by its
content and its place, so one that unwraps into itself (a compressed file
that holds itself) ends the walk.  Each layer carries, for each of its
characters, the range of the original text it came from, so whatever is
found there is reported as a span of the original.

Nothing that a pattern or an encoding matches contains a line feed, so an
escape layer is only the lines that hold the escapes.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import q, small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs of these two are maximal, so the length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 8

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|%u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: The end of a text that is one escape of an ASCII character.
LAST = re.compile(r"(?:%|\\x|\\u00|%u00|\\U000000)([0-7][0-9A-Fa-f])$|\\u\{0{0,4}([0-7]?[0-9A-Fa-f])\}$|&#[xX]0{0,4}([0-7]?[0-9A-Fa-f]);$|&#(0{0,4}(?:[0-9]{1,2}|1[01][0-9]|12[0-7]));$")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WORDS64 = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
#: Escapes nested deeper than this are unwrapped in one pass instead of one layer a level.
NESTED = 64
#: Decompressed data is scanned in pieces of whole lines of about this size.
PIECE = 1 << 22


def find(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of a text."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST:
            yield m.start(), 0, m.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            yield m.start(), kind, m.end()


def _chars(data: bytes, width: int, at: int):
    """Characters of escaped bytes, each with the range of its escapes; a
    byte that is no UTF-8 is a character of its own."""
    out = []
    for c in data.decode("utf-8", "surrogateescape"):
        n = width * (1 if "\udc80" <= c <= "\udcff" else len(c.encode()))
        out.append((c, at, at + n))
        at += n
    return out


def _unicode_chars(run: str, at: int):
    if run.startswith("\\x"):
        return _chars(bytes.fromhex(run.replace("\\x", "")), 4, at)
    if run[:2] in ("\\u", "%u") and run[2] != "{":
        out, units = [], [int(run[i + 2:i + 6], 16) for i in range(0, len(run), 6)]
        i = 0
        while i < len(units):
            u, n = units[i], 1
            if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                u, n = 0x10000 + (u - 0xD800) * 1024 + units[i + 1] - 0xDC00, 2
            if 0xD800 <= u < 0xE000:  # half a pair: it stays as it is
                out.extend((c, at + 6 * i + k, at + 6 * i + k + 1) for k, c in enumerate(run[6 * i:6 * i + 6]))
            else:
                out.append((chr(u), at + 6 * i, at + 6 * (i + n)))
            i += n
        return out
    code = int(run[2:-1]) if run[:2] == "&#" and run[2] not in "xX" else int(run[2:].strip("{};xX"), 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return [(c, at + k, at + k + 1) for k, c in enumerate(run)]
    return [(chr(code), at, at + len(run))]


class Layer:
    """A text with, for every character, its range in the original."""

    __slots__ = ("text", "start", "end", "path")

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, path: tuple[str, ...]):
        self.text, self.start, self.end, self.path = text, start, end, path

    def key(self):
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(self.start[0]), int(self.end[-1])


def _lines(text: str, hits: list[re.Match]) -> Iterator[tuple[int, int, list[re.Match]]]:
    """The lines (one or more at a time) that hold the hits."""
    i = 0
    while i < len(hits):
        lo = text.rfind("\n", 0, hits[i].start()) + 1
        hi = text.find("\n", hits[i].end())
        hi = len(text) if hi < 0 else hi
        j = i + 1
        while j < len(hits) and hits[j].start() < hi:
            j += 1
        yield lo, hi, hits[i:j]
        i = j


def _rewritten(layer: Layer, pattern: re.Pattern, name: str) -> Iterator[Layer]:
    """The lines of a layer that hold escapes, with the escapes resolved."""
    text = layer.text
    for lo, hi, hits in _lines(text, list(pattern.finditer(text))):
        chars, s, e, at = [], [], [], lo
        for m in [*hits, None]:
            stop = m.start() if m else hi
            chars.append(text[at:stop])
            s.append(np.arange(at, stop))
            e.append(np.arange(at + 1, stop + 1))
            if m:
                found = _chars(bytes.fromhex(m[0].replace("%", "")), 3, stop) if pattern is PERCENT else _unicode_chars(m[0], stop)
                chars.append("".join(c for c, _, _ in found))
                s.append(np.array([x for _, x, _ in found], np.int64))
                e.append(np.array([x for _, _, x in found], np.int64))
                at = m.end()
        s, e, new = np.concatenate(s), np.concatenate(e), "".join(chars)
        if new and new != text[lo:hi]:
            yield Layer(new, layer.start[s], layer.end[e - 1], (*layer.path, name))


def _collapsed(layer: Layer) -> Layer:
    """All nested escapes of ASCII characters resolved in one pass from left
    to right: a resolved character may end the next escape."""
    out, s, e = [], [], []
    for c, x, y in zip(layer.text, layer.start.tolist(), layer.end.tolist()):
        out.append(c), s.append(x), e.append(y)
        while out[-1] in "0123456789abcdefABCDEF};":
            m = LAST.search("".join(out[-12:]))
            if not m:
                break
            n = len(m[0])
            out[-n:] = [chr(int(m[1] or m[2] or m[3], 16) if not m[4] else int(m[4]))]
            s[-n:], e[-n:] = [s[-n]], [e[-1]]
    return Layer("".join(out), np.array(s, np.int64), np.array(e, np.int64), (*layer.path, "nested"))


def _unpack(data: bytes) -> Iterator[bytes] | None:
    """The decompressed data in pieces, if the bytes are compressed data."""
    if data[:3] == b"\x1f\x8b\x08":
        pieces = _pieces(zlib.decompressobj(31), data)
    elif len(data) > 6 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        pieces = _pieces(zlib.decompressobj(), data)
    elif data[:3] == b"BZh":
        pieces = _pieces(bz2.BZ2Decompressor(), data)
    elif data[:6] == b"\xfd7zXZ\x00":
        pieces = _pieces(lzma.LZMADecompressor(), data)
    else:
        return None
    first = next(pieces, None)  # text can begin like compressed data
    return None if first is None else chain([first], pieces)


def _pieces(d, data: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE bytes; damaged data ends where the damage begins."""
    try:
        while not d.eof:
            got = d.decompress(data, PIECE)
            data = d.unconsumed_tail if hasattr(d, "unconsumed_tail") else b""
            if got:
                yield got
            elif not data:
                return
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return


def _unpacked(data: bytes, start: int, end: int, path: tuple[str, ...]) -> Iterator[Layer | tuple]:
    """Layers of compressed data, in pieces of whole lines; each character's
    place is all of the compressed data.  Compressed data in it comes as
    (bytes, start, end, path)."""
    rest, first = b"", True
    path = (*path, "compressed")
    pieces = _unpack(data)
    for got in pieces:
        if first and _unpack(got) is not None:
            yield b"".join([got, *pieces]), start, end, path
            return
        first = False
        rest += got
        cut = rest.rfind(b"\n") + 1
        if len(rest) >= PIECE and cut:
            yield _flat(rest[:cut], start, end, path)
            rest = rest[cut:]
    if rest:
        yield _flat(rest, start, end, path)


def _flat(data: bytes, start: int, end: int, path) -> Layer:
    text = data.decode("utf-8", "surrogateescape")
    return Layer(text, np.broadcast_to(np.int64(start), len(text)), np.broadcast_to(np.int64(end), len(text)), path)


def _base64(layer: Layer) -> Iterator[Layer | tuple]:
    """What base64 runs hold, if it is UTF-8 or compressed data; of a run that
    holds neither, its parts between / _ and - are tried."""
    for m in BASE64.finditer(layer.text):
        found = _decoded(layer, m[0], m.start())
        if not found and re.search("[/_-]", m[0]):
            for part in WORDS64.finditer(m[0]):
                yield from _decoded(layer, part[0], m.start() + part.start())
        yield from found


def _decoded(layer: Layer, run: str, at: int) -> list[Layer | tuple]:
    body = run.rstrip("=")
    body = body[:-1] if len(body) % 4 == 1 else body
    data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    path = (*layer.path, "base64")
    out = [] if _unpack(data) is None else [(data, int(layer.start[at]), int(layer.end[at + len(run) - 1]), path)]
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return out
    first = np.nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[0]
    last = np.append(first[1:], len(data))
    return [*out, Layer(text, layer.start[at + first * 4 // 3], layer.end[at + (last * 4 + 2) // 3 - 1], path)]


def _escaped_data(layer: Layer) -> Iterator[tuple]:
    """Compressed data written as percent or byte escapes."""
    for pattern, mark in ((PERCENT, "%"), (UNICODE, "\\x")):
        for m in pattern.finditer(layer.text):
            if m[0].startswith(mark) and m[0][1] != "u":
                data = bytes.fromhex(m[0].replace(mark, ""))
                if _unpack(data) is not None:
                    yield data, int(layer.start[m.start()]), int(layer.end[m.end() - 1]), (*layer.path, "url" if mark == "%" else "unicode")


def scan(text: str) -> dict[tuple[int, int, int], str]:
    """(start, kind, end) -> the layers it was unwrapped from ('' for the text itself)."""
    out = dict.fromkeys(find(text), "")
    escaped, runs = "%" in text or "\\" in text or "&#" in text, BASE64.search(text)
    if not escaped and not runs:
        return out
    root = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1), ())
    todo, seen = deque([root]), {root.key()}
    while todo:
        layer = todo.popleft()
        if isinstance(layer, tuple):
            data, start, end, path = layer
            key = (hashlib.blake2b(data, digest_size=16).digest(), start, end)
            if key in seen:
                continue
            seen.add(key)
            for inner in _unpacked(data, start, end, path):
                if isinstance(inner, tuple):
                    todo.append(inner)
                else:
                    _take(inner, out, seen, todo)
            continue
        t = layer.text
        if "%" in t or "\\" in t or "&#" in t:
            deep = sum(p in ("url", "unicode") for p in layer.path) >= NESTED
            for inner in [_collapsed(layer)] if deep and "nested" not in layer.path else () if deep else (
                    *_rewritten(layer, PERCENT, "url"), *_rewritten(layer, UNICODE, "unicode"), *_escaped_data(layer)):
                _take(inner, out, seen, todo)
        for inner in _base64(layer):
            _take(inner, out, seen, todo)
    return out


def _take(layer: Layer | tuple, out: dict, seen: set, todo: deque) -> None:
    """Scans a new layer and puts it on the worklist."""
    if isinstance(layer, tuple):
        todo.append(layer)
        return
    if not layer.text:
        return
    key = layer.key()
    if key in seen:
        return
    seen.add(key)
    todo.append(layer)
    path = ">".join(layer.path)
    for a, kind, b in find(layer.text):
        out.setdefault((int(layer.start[a]), kind, int(layer.end[b - 1])), path)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): one row per input row; ``spans`` are (kind, start, end,
    layers) in code points of the original text, ordered by start, kind and
    end, each once; ``layers`` names what was unwrapped, '' for none.

    A null text is empty; an empty text has no spans.  Very long texts and
    layers are scanned whole (decompressed data in pieces of whole lines).
    Data that does not decode is no layer; damaged compressed data is one up
    to the damage.  Rows stand for themselves: ties, repeated rows and null
    ids need nothing; an empty table gives an empty result; other columns
    are ignored.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(q(id_col)).cast("long").alias("id"), F.col(q(text_col)).cast("string").alias("text"))

    def run(batches):
        for t in batches:
            at, kind, start, end, path = [0], [], [], [], []
            for text in t.column(1).to_pylist():
                found = scan(text) if text else {}
                for a, k, b in sorted(found):
                    kind.append(KINDS[k]), start.append(a), end.append(b), path.append(found[a, k, b])
                at.append(len(kind))
            spans = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(path, pa.string())],
                                               ["kind", "start", "end", "layers"])
            yield pa.RecordBatch.from_arrays([t.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)], ["id", "spans"])

    return src.mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long,layers:string>>")
