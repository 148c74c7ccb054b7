"""Word lists of any size (B11, D2) found by a multi-pattern automaton.

A rule list is compiled into one expression, which suits hundreds of rules.
A word list may hold millions of words: here it is compiled once into hashes
kept as arrays, broadcast to the executors, and every text is walked in one
pass, whatever the number of words.

The size is measured before anything reaches the driver.  A list whose index
would exceed ``PART_BYTES`` stays a table: only bitmaps of its hashes, made
by the executors, are broadcast; what they let through in one pass over the
texts meets the words by a join, and the hits meet per row again.  So
neither the driver nor a Python worker holds the list, and texts are walked
once for a list of any size.

Walking is vectorised: the texts of an Arrow batch stand one behind the
other, and the hash of any of their windows is the difference of two sums.
Hashes only lead to words; each hit is compared with its word.

Folding is that of a case-insensitive literal rule: an all-ASCII word folds
A-Z only, any other word folds by simple Unicode case mapping.  Of one
word, occurrences are found from left to right without overlap.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline import fixed as FX
from scrubline.functions.sqlx import ident, name, q
from scrubline.operators.words import LISTS
from scrubline.session import checkpoint_dir

#: Bytes of one index; what it has besides its words, and for each word besides its characters.
PART_BYTES, OWN_BYTES, WORD_BYTES = 256 << 20, 1 << 17, 18
#: A bitmap has 2 to the power of these bits at least and at most.
LEAST_BITS, MOST_BITS = 15, 29
#: Characters that are worked on at a time.
BLOCK = 1 << 18
#: Rows of an Arrow batch; batches of short texts are walked together until they have these bytes.
BATCH_ROWS, WALK_BYTES = 256, 1 << 20
#: No character: stands between texts.
NONE = 0x110000
_BASE = 0xD1342543DE82EF95
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

HIT_FIELDS = {"start": "int", "end": "int", "bstart": "int", "bend": "int", "cat": "int", "ord": "int", "word": "string", "match": "string"}
_HIT = pa.struct([(k, pa.string() if t == "string" else pa.int32()) for k, t in HIT_FIELDS.items()])
HIT_TYPE = f"array<struct<{', '.join(f'{k}: {t}' for k, t in HIT_FIELDS.items())}>>"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.lru_cache(maxsize=1)
def _unicode_folds() -> np.ndarray:
    """Simple case folding of every code point: to upper, then to lower case, where that is one character."""
    out = np.arange(NONE + 1, dtype=np.uint32)
    for c in range(128, NONE):
        u = chr(c).upper()
        v = (u if len(u) == 1 else chr(c)).lower()
        if len(v) == 1:
            out[c] = ord(v)
    out[65:91] += 32
    return out


def fold(cps: np.ndarray, ascii_only: bool) -> np.ndarray:
    if ascii_only:
        return np.where((cps >= 65) & (cps <= 90), cps + np.uint32(32), cps)
    return _unicode_folds()[cps]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse modulo 2 ** 64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.where(np.arange(n), np.uint64(x), np.uint64(1))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return tuple(_POWERS)


def _sums(chars: np.ndarray) -> np.ndarray:
    """What the hash of a window is read from; see ``_window``."""
    out = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(chars * _powers(len(chars))[0][:len(chars)], out=out[1:])
    return out


def _window(sums: np.ndarray, at: np.ndarray, size) -> np.ndarray:
    """The hash of the ``size`` characters at each place."""
    return (sums[at + size] - sums[at]) * _POWERS[1][at]


def _key(window: np.ndarray, size) -> np.ndarray:
    """The hash of a word: of its characters and their number."""
    x = (window + np.atleast_1d(np.asarray(size, np.uint64)) * _ODD) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def _flat(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all characters of pieces of ``size`` characters, piece behind piece."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether pieces of two texts are equal; none is empty."""
    out, ends = np.empty(len(size), bool), np.cumsum(size)
    lo = 0
    while lo < len(size):  # some at a time, to bound memory
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, side="right")))
        n = size[lo:hi]
        differ = a[_flat(a_at[lo:hi], n)] != b[_flat(b_at[lo:hi], n)]
        out[lo:hi] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        lo = hi
    return out


class Bits:
    """A set of hashes as a bitmap of 8 to 16 bits for each; it may hold
    others too."""

    def __init__(self, hashes: np.ndarray | None, bits: int = 0, packed: np.ndarray | None = None):
        self.bits, self.map = bits, packed
        if packed is None:
            self.bits = self.wanted(len(hashes))
            slots = np.zeros(1 << self.bits, bool)
            slots[self.slot(hashes, self.bits)] = True
            self.map = np.packbits(slots, bitorder="little")

    @staticmethod
    def wanted(hashes: int) -> int:
        return min(MOST_BITS, max(LEAST_BITS, (8 * hashes - 1).bit_length()))

    @staticmethod
    def slot(hashes: np.ndarray, bits: int) -> np.ndarray:
        return (hashes * _MIX) >> np.uint64(64 - bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        s = self.slot(hashes, self.bits)
        return (self.map[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)


def steps(shortest: int, longest: int) -> list[int]:
    """The sizes of the beginnings by which words are told: powers of two, from one that every word has."""
    first = shortest.bit_length() - 1
    return [1 << k for k in range(first, longest.bit_length())]


class Automaton:
    """The ways into the words that fold alike: from every place of a text a
    walk goes on as long as its first 4, 8, 16 ... characters begin a word,
    and looks for the words between two steps by their sizes.  Beginnings are
    kept as ``Bits``, so a walk costs next to nothing where no word begins,
    whatever the number of words."""

    def __init__(self, sizes: np.ndarray, begin: dict[int, Bits]):
        self.sizes, self.begin = np.unique(sizes), begin

    def nbytes(self) -> int:
        return sum(b.map.nbytes for b in self.begin.values())

    def walk(self, folded: np.ndarray):
        """(starts, size, keys) of the windows that may be words."""
        longest = int(self.sizes[-1])
        block = max(BLOCK, longest)
        for s in range(0, len(folded) - int(self.sizes[0]) + 1, block):
            c = folded[s:s + block + longest - 1]
            sums = _sums(c)
            i = None
            for g, bits in self.begin.items():
                most = max(0, min(block, len(c) - g + 1))
                if i is None:
                    i = np.nonzero(bits.has((sums[g:g + most] - sums[:most]) * _POWERS[1][:most]))[0]
                else:
                    i = i[:np.searchsorted(i, most)]
                    i = i[bits.has(_window(sums, i, g))]
                if not len(i):
                    break
                for n in self.sizes[np.searchsorted(self.sizes, g):np.searchsorted(self.sizes, 2 * g)].tolist():
                    j = i[:np.searchsorted(i, max(0, len(c) - n + 1))]
                    if len(j):
                        yield s + j, n, _key(_window(sums, j, n), n)


def _pieces(at: np.ndarray):
    """Ranges of words of about BLOCK characters."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK)) - 1)
        yield lo, hi
        lo = hi


def _hashed(chars: np.ndarray, at: np.ndarray, ascii_only: bool, prefix: int | None = None) -> np.ndarray:
    """The key of each word ``chars[at[i]:at[i + 1]]``, or the hashes of the
    first ``prefix`` characters of those that have them, each once."""
    out = [np.empty(0, np.uint64)]
    for lo, hi in _pieces(at):
        a = at[lo:hi + 1].astype(np.int64)
        sums, n, a = _sums(fold(chars[a[0]:a[-1]].astype(np.uint32), ascii_only)), np.diff(a), a[:-1] - a[0]
        if prefix is None:
            out.append(_key(_window(sums, a, n), n))
        else:
            out.append(np.unique(_window(sums, a[n >= prefix], prefix)))
    return np.concatenate(out) if prefix is None else np.unique(np.concatenate(out))


def _spelled(words: pa.Array, ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """The characters of words, one behind the other, and where each begins."""
    words = words.cast(pa.large_string())
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = memoryview(words.buffers()[2] or b"")[int(ends[0]):int(ends[-1])]
    return (np.frombuffer(data, np.uint8) if ascii_only else code_points(str(data, "utf-8"))), at


def _classes(words: pa.Array):
    """(ascii_only, the places of these words): all-ASCII words, then others; none empty."""
    plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    for ascii_only in (True, False):
        at = np.nonzero(full & (plain == ascii_only))[0]
        if len(at):
            yield ascii_only, at


#: The hashes by which a key is kept in a bitmap.
PROBES = (lambda keys: keys, lambda keys: keys * _MIX ^ (keys >> np.uint64(32)))


def _decoded(cps: np.ndarray) -> str:
    return cps.tobytes().decode("utf-32-le", "surrogatepass")


class _Part:
    """The words that fold alike, by key: their characters, category and
    place, a table from the first bits of a key to its words, and further
    bits of each."""

    def __init__(self, ascii_only: bool, words: pa.Array, cat: np.ndarray, place: np.ndarray):
        self.ascii_only = ascii_only
        self.chars, at = chars, at = _spelled(words, ascii_only)
        keys = _hashed(chars, at, ascii_only)
        order = self._first_of_equal(np.argsort(keys, kind="stable"), keys, at, cat, place)
        size = np.diff(at)[order]
        self.automaton = Automaton(size, {g: Bits(_hashed(chars, at, ascii_only, g)) for g in steps(int(size.min()), int(size.max()))})
        self.chars = np.concatenate([chars[_flat(at[o], np.diff(at)[o])] for o in np.array_split(order, -(-len(order) // BLOCK))])
        self.at = np.concatenate([[0], np.cumsum(size)]).astype(np.uint32 if len(self.chars) < 1 << 32 else np.int64)
        self.cat, self.place = cat[order].astype(np.int8), place[order].astype(np.int32)
        keys = keys[order]
        self.bits = max(1, len(keys).bit_length() - 1)
        self.tag = self._tag(keys)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self._bucket(keys), minlength=1 << self.bits))]).astype(np.int32)

    def _first_of_equal(self, order, keys, at, cat, place):
        """``order`` with the first by (category, place, word) of the words that fold alike."""
        k = keys[order]
        alike = np.concatenate([[False], k[1:] == k[:-1]])
        if not alike.any():
            return order
        many = alike | np.concatenate([alike[1:], [False]])
        rows, once = order[many], order[~many]
        rows = rows[np.lexsort((place[rows], cat[rows], keys[rows]))]
        head = np.concatenate([[True], keys[rows[1:]] != keys[rows[:-1]]])
        first = rows[head][np.cumsum(head) - 1]
        size = np.diff(at)
        same = size[rows] == size[first]
        same[same] = _equal(self, at[rows[same]], self, at[first[same]], size[rows[same]])
        tied = same & (cat[rows] == cat[first]) & (place[rows] == place[first])
        plain = same & ~tied
        plain[tied] = _equal(self.chars, at[rows[tied]], self.chars, at[first[tied]], size[rows[tied]])
        odd = np.isin(keys[rows], keys[rows[~plain]])  # keys of several words, and words listed twice at one place
        best: dict[tuple, tuple] = {}
        for w in rows[odd].tolist():
            word = self.chars[at[w]:at[w + 1]].astype(np.uint32)
            key = (int(keys[w]), fold(word, self.ascii_only).tobytes())
            mine = (int(cat[w]), int(place[w]), word.tolist(), w)
            best[key] = min(best.get(key, mine), mine)
        stand = np.concatenate([once, rows[head & ~odd], np.array([b[-1] for b in best.values()], np.int64)])
        return stand[np.argsort(keys[stand], kind="stable")]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def _tag(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(32 - self.bits)).astype(np.uint32)

    def nbytes(self) -> int:
        return self.automaton.nbytes() + sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))

    def hits(self, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, word) of every occurrence of every word."""
        out = [(np.empty(0, np.int64),) * 3]
        for start, n, keys in self.automaton.walk(folded):
            b, tag = self._bucket(keys), self._tag(keys)
            i, at, end = np.arange(len(b)), self.first[b].astype(np.int64), self.first[b + 1]
            while len(i := i[at[i] < end[i]]):
                same = i[self.tag[at[i]] == tag[i]]
                same = same[(self.at[at[same] + 1] - self.at[at[same]]) == n]
                w = at[same]
                same = same[_equal(folded, start[same], self, self.at[w].astype(np.int64), np.full(len(w), n))]
                out.append((start[same], start[same] + n, at[same]))
                at[i] += 1
        return tuple(np.concatenate(v) for v in zip(*out))

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        return fold(self.chars[places].astype(np.uint32), self.ascii_only)

    def spelled(self, words: np.ndarray) -> pa.Array:
        at = self.at[words].astype(np.int64)
        size = self.at[words + 1] - at
        if self.ascii_only:
            return _strings(self.chars, at, size)
        return pa.array([_decoded(self.chars[a:a + n]) for a, n in zip(at.tolist(), size.tolist())], pa.string())


class WordFilter:
    """What tells the windows of a text that may be words of a list that is
    not at hand: by class, the automaton and a bitmap of its words' keys."""

    def __init__(self, parts: list[tuple[bool, Automaton, Bits]]):
        self.parts = parts

    def nbytes(self) -> int:
        return sum(a.nbytes() + b.map.nbytes for _, a, b in self.parts)

    def hits(self, cps: np.ndarray, base: np.ndarray):
        """(ascii_only, start, end, folded window) of the windows within a
        text; of equal ones those that do not overlap."""
        for ascii_only, automaton, bits in self.parts:
            folded = fold(cps, ascii_only)
            out = [(np.empty(0, np.int64),) * 2]
            for start, n, keys in automaton.walk(folded):
                for probe in PROBES:
                    ok = bits.has(probe(keys))
                    start, keys = start[ok], keys[ok]
                out.append((start, start + n))
            start, end = (np.concatenate(v) for v in zip(*out))
            keep = end < base[np.searchsorted(base, start, side="right")]
            start, end = start[keep], end[keep]
            text = _decoded(np.where(folded == NONE, np.uint32(0), folded)) if len(start) else ""
            number: dict[str, int] = {}
            word = np.array([number.setdefault(text[a:b], len(number)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
            start, end, _ = _without_overlap(start, end, word)
            yield ascii_only, start, end, [text[a:b] for a, b in zip(start.tolist(), end.tolist())]


class WordIndex:
    """A compiled word list: up to two parts (one of them of words that fold
    by Unicode), numbered one behind the other."""

    def __init__(self, rows: list[tuple[str, int, int]] | pa.Table):
        """``rows``: (word, category, place); of words that fold alike the first by (category, place) stands."""
        if not isinstance(rows, pa.Table):
            rows = pa.table([pa.array(v, t) for v, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32()))] if rows else [pa.array([], pa.string())] * 3, ["word", "cat", "ord"])
        words, cat, place = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)
        cat, place = cat.to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False)
        self.parts = [_Part(a, words if len(at) == len(words) else words.take(pa.array(at)), cat[at], place[at]) for a, at in _classes(words)]
        self.base = np.concatenate([[0], np.cumsum([len(p.cat) for p in self.parts])]).astype(np.int64)

    def nbytes(self) -> int:
        return sum(p.nbytes() for p in self.parts)

    def spelled(self, words: np.ndarray) -> pa.Array:
        """The words of these numbers as they are listed."""
        part = np.searchsorted(self.base, words, side="right") - 1
        back = np.argsort(np.argsort(part, kind="stable"))
        return pa.concat_arrays([p.spelled(words[part == k] - self.base[k]) for k, p in enumerate(self.parts)]).take(pa.array(back))

    def hits(self, cps: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, category, place, word) of all occurrences in code points
        that may hold several texts parted by NONE, ordered by start, category,
        place and end."""
        out = [(np.empty(0, np.int64),) * 5]
        for p, base in zip(self.parts, self.base.tolist()):
            start, end, word = _without_overlap(*p.hits(fold(cps, p.ascii_only)))
            out.append((start, end, p.cat[word], p.place[word], word + base))
        start, end, cat, place, word = (np.concatenate(v) for v in zip(*out))
        o = np.lexsort((word, end, place, cat, start))
        return start[o], end[o], cat[o], place[o], word[o]


def _without_overlap(start: np.ndarray, end: np.ndarray, word: np.ndarray):
    """Of each word the occurrences from left to right that do not overlap."""
    o = np.lexsort((start, word))
    start, end, word = start[o], end[o], word[o]
    clash = np.concatenate([[False], (word[1:] == word[:-1]) & (start[1:] < end[:-1])])[:len(word)]
    if clash.any():
        keep = np.ones(len(word), bool)
        for w in np.unique(word[clash]):
            a, b = np.searchsorted(word, (w, w + 1))
            last = -1
            for k in range(a, b):
                if start[k] < last:
                    keep[k] = False
                else:
                    last = end[k]
        start, end, word = start[keep], end[keep], word[keep]
    return start, end, word


def _joined(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts as one, their code points parted by NONE, and where each text begins there."""
    texts = [t or "" for t in texts]
    base = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    cps = code_points("\0".join([*texts, ""])).copy()
    cps[base[1:] - 1] = NONE
    return "".join(texts), cps, base


def _strings(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """Pieces of UTF-8 bytes as an Arrow array."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(data[_flat(at, size)]))


def _spans(text: str, cps, base, doc, start, end) -> tuple[list[np.ndarray], pa.Array]:
    """Start and end of hits in their texts, in code points and in UTF-8 bytes, and what they hold."""
    wide = (cps != NONE).view(np.int8)
    if len(data := np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)) > len(text):
        wide = wide * np.where(cps < 0x80, np.int8(1), np.where(cps < 0x800, np.int8(2), np.where(cps < 0x10000, np.int8(3), np.int8(4))))
    width = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])  # UTF-8 bytes before each code point
    at, a, b = base[doc], width[start], width[end]
    return [start - at, end - at, a - width[at], b - width[at]], _strings(data, a, b - a)


def _batch_hits(index: WordIndex, texts: list[str | None]) -> pa.Array:
    """The hits of each text as an Arrow list of HIT_FIELDS structs."""
    text, cps, base = _joined(texts)
    start, end, cat, place, word = index.hits(cps)
    if not len(start):
        return pa.array([[]] * len(texts), pa.list_(_HIT))
    doc = np.searchsorted(base, start, side="right") - 1
    ints, match = _spans(text, cps, base, doc, start, end)
    fields = [*[pa.array(v.astype(np.int32)) for v in (*ints, cat, place)], index.spelled(word), match]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, list(HIT_FIELDS)))


def _listed(words: DataFrame) -> DataFrame:
    cats = F.array(*[F.lit(c) for c in LISTS])
    w = words.select("word", (F.array_position(cats, F.col("word_category")) - 1).cast("int").alias("cat"), F.col("ordinal").cast("int").alias("ord"))
    return w.where("word <> '' AND cat >= 0 AND ord IS NOT NULL")


def word_parts(words: DataFrame, part_bytes: int | None = None) -> int:
    """How many indexes' worth of memory a word table needs, from its characters (one aggregate)."""
    n = F.length("word")
    own = F.lit(WORD_BYTES) + 2 * F.floor(F.log2(n)) + F.when(F.octet_length("word") == n, n).otherwise(4 * n)
    size = _listed(words).agg(F.coalesce(F.sum(own), F.lit(0))).first()[0] + OWN_BYTES
    return max(1, -(-size // (part_bytes or PART_BYTES)))


def compile_words(words: DataFrame) -> WordIndex:
    """The index of a word table; its rows, bounded by PART_BYTES, are what
    the driver holds."""
    return WordIndex(_listed(words).toArrow())


def _gathered(batches):
    """Batches put together up to WALK_BYTES of text: a walk takes as many
    steps for a few characters as for many."""
    held, size = [], 0
    for t in batches:
        held.append(t)
        size += t.column(0).nbytes
        if size >= WALK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _walked(df: DataFrame, text: str, index: WordIndex, keep: list[str], out: str) -> DataFrame:
    """``keep`` and the hits of ``text`` as column ``out``; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(index)
    src = _in_batches(df).select(F.col(ident(text)).alias("__text"), *[F.col(ident(c)) for c in keep])
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.DataType.fromDDL(HIT_TYPE))])

    def run(batches):
        for t in _gathered(batches):
            yield pa.RecordBatch.from_arrays([*t.columns[1:], _batch_hits(shared.value, t.column(0).to_pylist())], [*keep, out])

    return src.mapInArrow(run, schema)


def _in_batches(df: DataFrame) -> DataFrame:
    """``df`` to be read in Arrow batches of BATCH_ROWS."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def _word_hashes(batches, sizes: dict[bool, list[int]]):
    """Of words, by class, the hashes of their beginnings (by size) and of the keys (size 0)."""
    for t in batches:
        for ascii_only, at in _classes(t.column(0)):
            chars, begin = _spelled(t.column(0).take(pa.array(at)), ascii_only)
            keys = _hashed(chars, begin, ascii_only)
            found = {g: _hashed(chars, begin, ascii_only, g) for g in steps(min(sizes[ascii_only]), max(sizes[ascii_only]))}
            found[0] = np.unique(np.concatenate([probe(keys) for probe in PROBES]))
            for g, h in found.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), ascii_only)), pa.array(np.full(len(h), g, np.int32)), pa.array((h * _MIX).view(np.int64))], ["plain", "step", "h"])


def compile_filter(words: DataFrame) -> WordFilter:
    """The bitmaps of a word table.  The executors make them; the driver
    holds them and the sizes of the words."""
    listed = _listed(words).select("word")
    plain = F.octet_length("word") == F.length("word")
    sizes = {r.plain: sorted(r.n) for r in listed.groupBy(plain.alias("plain")).agg(F.collect_set(F.length("word")).alias("n")).collect()}
    hashes = listed.mapInArrow(lambda batches: _word_hashes(batches, sizes), "plain boolean, step int, h long")
    bits = {(r.plain, r.step): Bits.wanted(r.n) for r in hashes.groupBy("plain", "step").agg(F.approx_count_distinct("h").alias("n")).collect()}
    shift = F.coalesce(*[F.when((F.col("plain") == p) & (F.col("step") == g), F.lit(64 - b)) for (p, g), b in bits.items()])
    slots = hashes.withColumn("shift", shift).selectExpr("plain", "step", "shiftrightunsigned(h, shift) + 1 AS slot").distinct()
    blocks = slots.selectExpr("plain", "step", "bitmap_bucket_number(slot) - 1 AS block", "bitmap_bit_position(slot) AS bit")
    maps = {k: np.zeros(1 << b >> 3, np.uint8) for k, b in bits.items()}
    for r in blocks.repartition("plain", "step", "block").groupBy("plain", "step", "block").agg(F.bitmap_construct_agg("bit").alias("map")).toLocalIterator():
        part = maps[r.plain, r.step][r.block * len(r.map):][:len(r.map)]
        part |= np.frombuffer(r.map, np.uint8)[:len(part)]
    made = {k: Bits(None, bits[k], m) for k, m in maps.items()}
    return WordFilter([(p, Automaton(np.array(n), {g: made[p, g] for g in steps(n[0], n[-1])}), made[p, 0]) for p, n in sizes.items()])


_FOUND = "start int, end int, bstart int, bend int, match string, plain boolean, folded string"


def _may_be_words(df: DataFrame, text: str, key: str, found: WordFilter) -> DataFrame:
    """A row for each window of ``text`` that may be a word, with ``key``; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(found)
    src = _in_batches(df).select(F.col(ident(text)).alias("__text"), F.col(ident(key)))
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(_FOUND).fields])

    def run(batches):
        for t in _gathered(batches):
            texts, cps, base = _joined(t.column(0).to_pylist())
            for plain, start, end, folded in shared.value.hits(cps, base):
                if len(start):
                    doc = np.searchsorted(base, start, side="right") - 1
                    ints, match = _spans(texts, cps, base, doc, start, end)
                    yield pa.RecordBatch.from_arrays([t.column(1).take(pa.array(doc)), *[pa.array(v.astype(np.int32)) for v in ints], match,
                                                      pa.array(np.full(len(doc), plain)), pa.array(folded, pa.string())], schema.names)

    return src.mapInArrow(run, schema)


def _by_folded(words: DataFrame) -> DataFrame:
    """The words by how they fold; of words that fold alike the first by (category, place)."""
    def run(batches):
        for t in batches:
            for ascii_only, at in _classes(t.column(0)):
                w = t.take(pa.array(at))
                chars, begin = _spelled(w.column(0), ascii_only)
                text, ends = _decoded(fold(chars.astype(np.uint32), ascii_only)), begin.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ascii_only)), pa.array([text[a:b] for a, b in zip(ends, ends[1:])], pa.string()), *w.columns[1:], w.column(0)],
                                                 ["plain", "folded", "cat", "ord", "word"])

    rows = _listed(words).mapInArrow(run, "plain boolean, folded string, cat int, ord int, word string")
    return rows.groupBy("plain", "folded").agg(F.min(F.struct("cat", "ord", "word")).alias("w"))


def word_hits(df: DataFrame, text: str, words: DataFrame, key: str | None = None, out: str = "__w", part_bytes: int | None = None) -> DataFrame:
    """``df`` with column ``out``: the occurrences of a word table's words in
    ``text``, (start, end, bstart, bend, cat, ord, word, match), ordered by
    start, list and place; code points and UTF-8 bytes.

    A list of one part is a narrow pass.  A larger list is joined to what one
    pass over the texts finds by its bitmaps, and the hits meet by ``key``,
    which must identify a row; without a key the rows are written once with
    one.  Null and empty texts have no hits; an empty list gives none; null
    words and unknown categories are ignored.
    """
    cols = list(df.columns)
    if word_parts(words, part_bytes) == 1:
        return _walked(df, text, compile_words(words), cols, out)
    spark, own = df.sparkSession, key is None
    if own:
        key = "__row"
        path = f"{checkpoint_dir(spark).rstrip('/')}/word-rows-{uuid.uuid4().hex}"
        df.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
        df = spark.read.parquet(path)
    found = _may_be_words(df, text, key, compile_filter(words)).join(_by_folded(words), ["plain", "folded"])
    value = {f: F.col(f"w.{f}") if f in ("cat", "ord", "word") else F.col(f) for f in HIT_FIELDS}
    hit = F.struct(*[value[f].alias(f"__{f}") for f in ("start", "cat", "ord", "end", "word")], F.struct(*[value[f].alias(f) for f in HIT_FIELDS]).alias("h"))
    met = found.groupBy(ident(key)).agg(F.array_sort(F.collect_list(hit)).alias("__h"))
    met = met.select(ident(key), F.transform("__h", lambda x: x["h"]).alias(out))
    empty = F.array().cast(met.schema[out].dataType)
    both = df.join(met, key, "left").withColumn(out, F.coalesce(out, empty))
    return both.select(*[F.col(ident(c)) for c in cols], out)


# ------------------------------------------------------- as detections

def candidates_sql(hits: str, rank: int, prio: int, cands: str) -> str:
    """The candidates of a row (see ``detect``) and its word hits as one
    sorted array; a candidate of a word carries the listed word, its list as
    ``sub`` and its place as ``seq``."""
    c, w = name("c"), name("w")
    fields = ("start", "rank", "sub", "seq", "end", "bstart", "bend", "prio", "match", "vstart", "vend")
    old = "named_struct(" + ", ".join(f"'{f}', {c}.{ident(f)}" for f in fields) + ", 'word', CAST(NULL AS STRING))"
    value = {"rank": str(rank), "sub": f"{w}.cat", "seq": f"{w}.ord", "prio": str(prio), "vstart": "-1", "vend": "-1"}
    new = "named_struct(" + ", ".join(f"'{f}', {value.get(f, f'{w}.{ident(f)}')}" for f in fields) + f", 'word', {w}.word)"
    return f"array_sort(concat(transform({cands}, {c} -> {old}), transform({hits}, {w} -> {new})))"


def word_fields(c: str, strategy: str) -> dict[str, str]:
    """Rule id, name, category, pattern and replacement of a word candidate ``c``."""
    def pick(values):
        return f"get(array({', '.join(q(v) for v in values)}), {c}.sub)"
    label = {f: pick([FX.WORD_RULE_LABELS[k][f] for k in LISTS]) for f in ("id", "name", "category")}
    if strategy == "custom":
        repl = f"regexp_replace(regexp_replace(regexp_replace({c}.word, '[A-Z]', 'X'), '[a-z]', 'x'), '[0-9]', '0')"
    elif strategy == "competitor":
        names = f"array({', '.join(q(n) for n in FX.COMPETITOR_NAMES)})"
        repl = (f"CASE WHEN {c}.sub = 0 THEN get({names}, CAST(pmod(xxhash64({c}.word), {len(FX.COMPETITOR_NAMES)}) AS INT)) "
                f"ELSE {pick([f'[{k.upper()}_REDACTED]' for k in LISTS])} END")
    elif strategy == "generic":
        repl = pick([FX.GENERIC_WORD_REPLACEMENT.get(k, FX.REDACTED) for k in LISTS])
    else:
        repl = q(FX.REDACTED)
    own = f"{c}.sub = 0"
    return {"rule_id": f"CASE WHEN {own} THEN {label['id']} ELSE concat({label['id']}, '_', CAST({c}.seq AS STRING)) END",
            "rule_name": f"CASE WHEN {own} THEN {label['name']} ELSE concat({label['name']}, ': ', {c}.word) END",
            "category": label["category"], "pattern": f"{c}.word", "replacement": repl}
