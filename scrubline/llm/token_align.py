"""Alignment of two tokenizations of the same text.

Both tokenizers cut the bytes of a space and the text.  Per Arrow batch the
tokens of each side stand in one frame, ordered by their byte offset and
keyed by document; ``merge_asof`` finds for each token start the other
side's token that covers it.  The union of both directions is the set of
overlapping tokens.  Overlapping tokens with equal ends close a group: the
text is cut there for both sides, and tokens of a group explain each other.

Corpus-wide link counts are aggregated over (document, pair) rows.  Looking
them up again for every link would join on very frequent pairs; pairs that
hold more than 1 / HOT_PAIRS of all links are at most HOT_PAIRS, so they are
broadcast, and only the rare rest is joined by a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import cut, q, small_batches

TOKENIZERS = "/opt/tokenizers"
#: Pairs looked up by a broadcast table: its size bound.
HOT_PAIRS = 1 << 17
#: Chunks remembered by a worker, and the longest of them.
KNOWN, SHORT = 400_000, 32
#: Link pairs expanded at once.
BLOCK = 1 << 21


class Side:
    """One tokenizer: its encoder, and the bytes of each id."""

    def __init__(self, encode, pieces: list[bytes | None], joined: bool):
        self.encode, self.joined = encode, joined  # whether many short texts are encoded faster as one
        self.pieces = pieces
        self.size = len(pieces)
        self.lengths = np.array([len(p or b"") for p in pieces], np.int64)
        self.bytes = np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths

    def ids(self, chunks: list[str], text: str, want: np.ndarray, stops: np.ndarray) -> list[bytes] | None:
        """The ids of each chunk as 32-bit numbers; None unless they give back
        each chunk's bytes.  ``want`` are the bytes of the chunks behind each
        other, ``stops`` where each ends."""
        found = self.encode([text[1:]] if self.joined else [c[1:] for c in chunks])
        ids = np.array(found[0] if self.joined else list(chain.from_iterable(found)), np.uint32)
        size = self.lengths[ids]
        end = np.cumsum(size)
        if not len(ids) or end[-1] != len(want) or not np.array_equal(self.bytes[np.repeat(self.at[ids] - end + size, size) + np.arange(len(want))], want):
            return None
        place = np.searchsorted(end, stops)
        if not np.array_equal(end[place], stops):
            return None
        data, cuts = ids.tobytes(), ((place + 1) * 4).tolist()
        return [data[x:y] for x, y in zip([0, *cuts], cuts)]


class Pair:
    """Both tokenizers on one text.

    Neither kind of vocabulary joins a character to a space that follows it,
    so a text falls into chunks (see ``chunks``) that are encoded by
    themselves; short ones are remembered, as words repeat, in two
    generations: what the younger has met again outlives the older."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.changed: set[str] = set()  # chunks whose bytes one side does not give back

    def tokens(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of each text, given as its chunks, on both sides; None for
        a text whose bytes one side does not give back."""
        if 2 * len(self.known) > KNOWN:
            self.old, self.known = self.known, {}
            self.changed.intersection_update(self.old)
        known, old = self.known, self.old
        new = list(set().union(*texts).difference(known))
        again = [c for c in new if c in old]
        if again:
            known.update((c, old[c]) for c in again)
            new = [c for c in new if c not in old]
        # chunks of one run of letters behind a space can stand behind each other like words of a text
        plain = [c for c in new if len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        if not self._learn(plain):
            plain = []
        for c in new if len(plain) < len(new) else ():
            if c not in known and not self._learn([c]):
                self.changed.add(c)
                known[c] = b"", b""
        out = []
        for t in texts:
            if t and self.changed.isdisjoint(t):
                a, b = zip(*map(known.__getitem__, t))
                out.append((np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.uint32)))
            else:
                out.append(None)
        for c in new:
            if len(c) > SHORT:
                del known[c]
                self.changed.discard(c)
        return out

    def _learn(self, chunks: list[str]) -> bool:
        """Remembers the ids of chunks; False (and nothing remembered) unless
        both sides give back each chunk's bytes."""
        if not chunks:
            return True
        text = "".join(chunks)
        want = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        sizes = map(len, chunks) if text.isascii() else (len(c.encode("utf-8", "surrogatepass")) for c in chunks)
        stops = np.cumsum(np.fromiter(sizes, np.int64, len(chunks)))
        a = self.a.ids(chunks, text, want, stops)
        b = a and self.b.ids(chunks, text, want, stops)
        if not b:
            return False
        self.known.update(zip(chunks, zip(a, b)))
        return True


@functools.lru_cache(maxsize=4)
def _pair(a: Side, b: Side) -> Pair:
    return Pair(a, b)


#: No mark of Unicode: stands between chunks.
_CUT = "\uffff"
_SPACES = re.compile(r" (?:\s|\Z)|\A ")


def chunks(text: str) -> list[str]:
    """A space and the text, cut before each space that follows no space and
    that no white space follows.  A byte-level pattern takes a run of white
    space up to its last character before a word, and a piece holds spaces at
    its start only, so no token of either kind crosses a cut."""
    if not _SPACES.search(text) and _CUT not in text:
        return f" {text}".replace(" ", _CUT + " ").split(_CUT)[1:]
    out: list[str] = []
    last = ""
    for p in text.split(" "):
        if out and (not last or not p or p[0].isspace()):
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(" " + p)
        last = p
    return out


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level_side(spec: str) -> Side:
    """A byte-level BPE from its JSON text; special tokens' strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.encode_special_tokens = True
    tok.no_truncation()
    tok.no_padding()
    alphabet = _byte_alphabet()
    vocab = json.loads(spec)["model"]["vocab"]
    pieces: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    def encode(texts):
        return [e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return Side(encode, pieces, joined=True)


def piece_side(model: bytes) -> Side:
    """A SentencePiece model; it puts the space before the text itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())):
        raise ValueError("the model has pieces with a space inside: texts cannot be cut at spaces")
    pieces = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
              for i in range(sp.get_piece_size())]
    return Side(lambda texts: sp.encode(texts, num_threads=1), pieces, joined=False)


@functools.lru_cache(maxsize=2)
def _sides(a_spec: str, b_model: bytes) -> tuple[Side, Side]:
    return byte_level_side(a_spec), piece_side(b_model)


class Batch:
    """The aligned tokens of a batch of texts.  ``a`` and ``b`` are frames
    (doc, id, at, end, group) in text order, offsets counted over the batch."""

    def __init__(self, texts: list[str | None], side_a: Side, side_b: Side):
        real = [i for i, t in enumerate(texts) if t]
        doc, a, b, size = [], [], [], []
        for i, found in zip(real, _pair(side_a, side_b).tokens([chunks(texts[i]) for i in real])):
            if found is None:
                continue  # one side changed the text: no tokens
            doc.append(i), a.append(found[0]), b.append(found[1]), size.append(int(side_a.lengths[found[0]].sum()))
        self.rows, self.base = len(texts), np.zeros(len(texts), np.int64)
        self.base[doc] = np.cumsum([0, *size])[:-1]
        self.a, self.b = self._frame(doc, a, side_a), self._frame(doc, b, side_b)
        self.overlaps = self._overlaps()
        ends = self.a["end"].to_numpy()
        both = ends[self.overlaps[0]] == self.b["end"].to_numpy()[self.overlaps[1]]
        for f, at in zip((self.a, self.b), self.overlaps):
            last = np.zeros(len(f), np.int64)
            last[at[both]] = 1  # overlapping tokens with equal ends are the last of a group
            f["group"] = np.cumsum(last) - last
        #: where tokens of both sides end
        self.cuts = np.sort(ends[self.overlaps[0][both]])

    @staticmethod
    def _frame(doc: list[int], ids: list[np.ndarray], side: Side) -> pd.DataFrame:
        flat = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
        end = np.cumsum(side.lengths[flat])
        return pd.DataFrame({"doc": np.repeat(np.array(doc, np.int64), [len(x) for x in ids]) if doc else np.empty(0, np.int64),
                             "id": flat, "at": end - side.lengths[flat], "end": end})

    def _overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """(token of A, token of B) positions of all pairs that share a byte."""
        a = self.a[["doc", "at"]].assign(a=np.arange(len(self.a)))
        b = self.b[["doc", "at"]].assign(b=np.arange(len(self.b)))
        over = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy(np.int64)  # the token of B over each start of A
        under = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy(np.int64)
        twice = self.a["at"].to_numpy()[under] == self.b["at"].to_numpy()  # equal starts are in both directions
        other = np.nonzero(~twice)[0]
        return np.concatenate([np.arange(len(over)), under[other]]), np.concatenate([over, other])

    def counts(self):
        """(tokens of A, tokens of B, groups, links) of each text."""
        n = len(self.cuts)
        ga, gb = np.bincount(self.a["group"], minlength=n), np.bincount(self.b["group"], minlength=n)
        doc = np.zeros(n, np.int64)
        doc[self.a["group"]] = self.a["doc"]
        links = np.zeros(self.rows, np.int64)
        np.add.at(links, doc, ga * gb)
        count = lambda x: np.bincount(x, minlength=self.rows)
        return count(self.a["doc"]), count(self.b["doc"]), count(doc), links

    def group_hashes(self, labels: np.ndarray, size_a: int, size_b: int) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        key = np.concatenate([self.a["group"].to_numpy() * 2, self.b["group"].to_numpy() * 2 + 1])
        order = np.argsort(key, kind="stable")
        k = key[order]
        last = np.concatenate([k[1:] != k[:-1], [True]])[:len(k)]
        sep = np.where(last, 1 + k % 2, 0)  # , within a side, | between the sides, ; after a group
        ids = np.concatenate([self.a["id"].to_numpy(), self.b["id"].to_numpy()])[order]
        parts = labels[sep * max(size_a, size_b) + ids].tolist()
        doc = np.concatenate([self.a["doc"].to_numpy(), self.b["doc"].to_numpy()])[order]
        at = np.searchsorted(doc, np.arange(self.rows + 1)).tolist()
        return [hashlib.sha256("".join(parts[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]

    def links(self, size_a: int, size_b: int):
        """Yields (text, pair, links): the distinct id pairs of each text with
        the number of their linked occurrences, pair = a * size_b + b."""
        def tokens(f, size):
            return f["group"].to_numpy(), f["id"].to_numpy(), np.ones(len(f), np.int64)

        def distinct(f, size):
            k, n = np.unique(f["group"].to_numpy() * size + f["id"].to_numpy(), return_counts=True)
            return k // size, k % size, n

        def per_group(gb):
            size = np.bincount(gb, minlength=len(self.cuts))  # every group has tokens of both sides
            return np.cumsum(size) - size, size
        doc = np.zeros(len(self.cuts), np.int64)
        doc[self.a["group"]] = self.a["doc"]
        ga, a, ca = tokens(self.a, size_a)
        gb, b, cb = tokens(self.b, size_b)
        start, size = per_group(gb)
        if size[ga].sum() <= BLOCK:
            blocks = [(0, len(ga))]
        else:  # very many links: of equal ids of a group one stands for all, and an id's rows of one text are in one block
            ga, a, ca = distinct(self.a, size_a)
            gb, b, cb = distinct(self.b, size_b)
            start, size = per_group(gb)
            own = doc[ga] * size_a + a
            o = np.argsort(own, kind="stable")
            ga, a, ca, own = ga[o], a[o], ca[o], own[o]
            total = np.concatenate([[0], np.cumsum(size[ga])])
            blocks, x = [], 0
            while x < len(ga):
                y = max(x + 1, int(np.searchsorted(total, total[x] + BLOCK, side="right")) - 1)
                blocks.append((x, int(np.searchsorted(own, own[y - 1], side="right"))))
                x = blocks[-1][1]
        for x, y in blocks:
            n = size[ga[x:y]]
            i = np.repeat(np.arange(x, y), n)
            if not len(i):
                continue
            at = np.cumsum(n) - n
            j = np.arange(len(i)) + np.repeat(start[ga[x:y]] - at, n)
            key, weight = (doc[ga[i]] * size_a + a[i]) * size_b + b[j], ca[i] * cb[j]
            s = np.argsort(key)
            key, weight = key[s], weight[s]
            new = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            key, weight = key[new], np.add.reduceat(weight, new)
            yield key // (size_a * size_b), key % (size_a * size_b), weight


def _labels(size: int) -> np.ndarray:
    """Decimal ids followed by each separator."""
    return np.array([f"{i}{s}" for s in ",|;" for i in range(size)], object)


def _load(spark, a_path: str, b_path: str):
    """Both tokenizer files, read on the driver and broadcast (a few MB, whatever the corpus)."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def align_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 a_path: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """(id, a, b, overlaps, group_ends): one row per input row with both
    token lists, the (position in a, position in b) pairs of overlapping
    tokens and the byte offsets, in space + text, where both sides end.

    Texts that are null, empty or that a side does not give back byte by byte
    have no tokens.  Very long texts are aligned whole.  Rows stand for
    themselves, so ties, repeated rows and null ids need nothing; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    files = _load(spark, a_path, b_path)
    src = df.select(F.col(q(id_col)).cast("long").alias("id"), F.col(q(text_col)).cast("string").alias("text"))

    def run(batches):
        sides = _sides(*files.value)
        for t in batches:
            m = Batch(t.column(1).to_pylist(), *sides)
            docs = np.arange(t.num_rows + 1)
            at = [np.searchsorted(f["doc"].to_numpy(), docs) for f in (m.a, m.b)]
            lists = [pa.ListArray.from_arrays(pa.array(x, pa.int32()), pa.array(f["id"].to_numpy(), pa.int32())) for x, f in zip(at, (m.a, m.b))]
            i, j = m.overlaps
            o = np.lexsort((j, i))
            i, j = i[o], j[o]
            d = m.a["doc"].to_numpy()[i]
            pairs = pa.StructArray.from_arrays([pa.array(i - at[0][d], pa.int32()), pa.array(j - at[1][d], pa.int32())], ["a", "b"])
            own = np.zeros(len(m.cuts), np.int64)
            own[m.a["group"]] = m.a["doc"]
            yield pa.RecordBatch.from_arrays(
                [t.column(0), *lists, pa.ListArray.from_arrays(pa.array(np.searchsorted(d, docs), pa.int32()), pairs),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(own, docs), pa.int32()), pa.array(m.cuts - m.base[own], pa.int64()))],
                ["id", "a", "b", "overlaps", "group_ends"])

    return src.mapInArrow(run, "id long, a array<int>, b array<int>, overlaps array<struct<a:int,b:int>>, group_ends array<long>")


def link_rows(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, links): one row
    per input row and, for texts with very many pairs, further rows whose
    counts are null that hold more of ``links`` (k = a * |B| + b, m)."""
    spark = df.sparkSession
    small_batches(spark)
    files = _load(spark, a_path, b_path)
    src = df.select(F.monotonically_increasing_id().alias("row"), F.col(q(id_col)).cast("long").alias("id"), F.col(q(text_col)).cast("string").alias("text"))
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]

    def run(batches):
        a, b = _sides(*files.value)
        labels = _labels(max(a.size, b.size))
        for t in batches:
            m = Batch(t.column(2).to_pylist(), a, b)
            head = [pa.array(v, pa.int64()) for v in m.counts()] + [pa.array(m.group_hashes(labels, a.size, b.size), pa.string())]
            empty = [pa.nulls(t.num_rows, h.type) for h in head]
            for doc, key, n in [*m.links(a.size, b.size)] if len(m.a) < BLOCK else m.links(a.size, b.size):
                at = pa.array(np.searchsorted(doc, np.arange(t.num_rows + 1)), pa.int32())
                links = pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["k", "m"])
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *head, pa.ListArray.from_arrays(at, links)], names)
                head = empty
            if head is not empty:  # no tokens at all
                none = pa.array([[]] * t.num_rows, pa.list_(pa.struct([("k", pa.int64()), ("m", pa.int64())])))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), *head, none], names)

    return src.mapInArrow(run, "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<k:long,m:long>>")


def link_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                a_path: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256):
    one row per input row.  A link is a pair of token occurrences in one
    group, an id pair's count the number of rows that hold it linked;
    ``n_best`` are the links whose count is the highest of their A id (ties
    included), ``count_sum`` sums the counts over the links.

    Rows without tokens (see ``align_tokens``) are zeros and ''.  Repeated
    rows count as documents of their own, null ids too.
    """
    files = _load(df.sparkSession, a_path, b_path)
    size_b = piece_side(files.value[1]).size
    rows = cut(link_rows(df, id_col, text_col, a_path, b_path), "aligned")
    each = rows.select("row", F.inline("links"))
    n = each.groupBy("k").agg(F.count("*").alias("n")).withColumn("a", F.floor(F.col("k") / size_b))
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    # an id of A has at most |B| pairs, so no key of this join is hot
    n = cut(n.join(top, "a").select("k", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    floor = (n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HOT_PAIRS
    hot = F.broadcast(n.where(F.col("n") > floor))  # fewer than HOT_PAIRS rows, whatever the corpus
    sums = [F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum")]
    known = each.join(hot, "k").groupBy("row").agg(*sums)
    rare = each.join(hot.select("k"), "k", "left_anti").join(n.where(F.col("n") <= floor), "k").groupBy("row").agg(*sums)
    total = known.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.where("n_a is not null").drop("links").join(total, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
