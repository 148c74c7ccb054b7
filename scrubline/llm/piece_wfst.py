"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (dummy
prefix, white space to U+2581), the closure of the pieces, and the byte
fallback that spells a character without a piece by byte pieces.  A text is
composed with them and the shortest path over the tropical semiring
(costs add along a path, the cheaper path wins) is its encoding.

Arc weights.  Unigram model: the negative score of the piece.  BPE model:
two pieces in a row cost 0 if the merge rule keeps the boundary between
them and infinity if it merges across it.  A sequence of pieces is the BPE
encoding of its text exactly if the merge rule gives every piece and every
pair of neighbours back unchanged, so just one path has a finite weight,
and the last piece of each prefix's path is its only live state.

The composition is cut where no piece can span (before white space, between
letters and other characters, as far as the model's pieces allow), and the
paths of the segments between cuts are remembered up to ``CACHE`` entries.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.llm.common import q, small_batches

SPACE = "▁"
#: Segments a worker remembers in each of two generations, and piece pairs.
CACHE = 200_000
PAIRS = 1_000_000
#: Segments up to this length are composed together, as rows of one matrix.
ROW = 40
#: Multiplier of the piece hash.
HASH = np.uint64(0x9E3779B97F4A7C15)
#: Code points composed at once (cut at a segment boundary).
BLOCK = 1 << 19
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Piece types and model types of the model file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _pack(ids: tuple) -> bytes:
    return array("i", ids).tobytes()


class Machine:
    """The compiled transducers of one model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        m.ParseFromString(model)
        self.bpe = m.trainer_spec.model_type == BPE
        if m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped white space is supported")
        self.dummy_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.vocab, self.score, self.surface, self.byte_id, self.unk = {}, {}, [], {}, 0
        for i, p in enumerate(m.pieces):
            self.surface.append("" if p.type == CONTROL else p.piece.replace(SPACE, " "))
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
            elif p.type == UNKNOWN:
                self.unk, self.surface[i] = i, " ⁇ "
            elif p.type == USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
            elif p.type in (NORMAL, UNUSED):
                self.vocab[p.piece] = i
                self.score[p.piece] = p.score
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        for i, b in self.id_byte.items():  # ASCII bytes stand for themselves
            self.surface[i] = chr(b) if b < 128 else None
        self.high = np.array([i in self.id_byte and self.id_byte[i] >= 128 for i in range(len(self.surface))])
        self.string = {i: p for p, i in self.vocab.items()}
        self.prefixes = {p[:k] for p in self.vocab for k in range(1, len(p) + 1)}
        self.cuts = self._cuts()
        self.can_cut = self.cuts.pattern != ".+"
        self.paths: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple, bool] = {}
        self._compile_table()

    def _cuts(self) -> re.Pattern:
        """Splits a text where no piece can span.  Cuts depend on two
        neighbouring characters only, so a rule is safe if it leaves every
        piece whole; the finest safe rule is taken."""
        odd = "".join(sorted({c for p in self.vocab for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        letters = f"[^\\W\\d_{re.escape(odd)}]"
        rules = [f"{SPACE}*{letters}+|{SPACE}*(?:(?![{SPACE}\n]){letters.replace('[^', '[')})+|{SPACE}+|\n",
                 f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n", f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"]
        for rule in rules:
            r = re.compile(rule, re.S)
            if all(r.match(p).end() == len(p) for p in self.vocab if r.match(p)) and all(r.match(p) for p in self.vocab):
                return r
        return re.compile(".+", re.S)

    def _compile_table(self):
        """Pieces by length as sorted hashes with ids; known pairs as sorted keys."""
        self.names = [""] * (len(self.surface) + 1)  # the last stands for the start
        by_len: dict[int, list] = {}
        for p, i in self.vocab.items():
            self.names[i] = p
            by_len.setdefault(len(p), []).append((p, i))
        self.start = len(self.surface)
        self.longest = max(by_len)
        self.slots = {}
        for n, items in by_len.items():
            h = self._rows([p for p, _ in items], n)
            acc = np.zeros(len(items), np.uint64)
            for k in range(n):
                acc = (acc + h[:, k]) * HASH
            order = np.argsort(acc)
            acc, ids = acc[order], np.array([i for _, i in items])[order]
            # first entry of each value of the top 16 bits: a short scan finds the piece
            top = (acc >> np.uint64(48)).astype(np.int64)
            first = np.searchsorted(top, np.arange((1 << 16) + 1))
            self.slots[n] = (acc, ids, first.astype(np.int32), int(np.diff(first).max()))
        self.known = np.empty(0, np.int64)
        self.legal = np.empty(0, bool)

    @staticmethod
    def _rows(strings: list[str], n: int) -> np.ndarray:
        return np.array(strings, dtype=f"<U{n}").view(np.uint32).reshape(len(strings), n).astype(np.uint64)

    def _find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces of length ``n`` with these hashes, -1 for none."""
        acc, ids, first, deep = self.slots[n]
        at = first[(h >> np.uint64(48)).astype(np.int64)]
        out = np.full(len(h), -1, np.int64)
        for k in range(deep):
            x = np.minimum(at + k, len(acc) - 1)
            hit = acc[x] == h
            out[hit] = ids[x[hit]]
        return out

    def _keep_rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``keeps`` for rows of piece ids; new pairs are merged once."""
        key = a * np.int64(self.start + 1) + b
        if not len(self.known):
            at, hit = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
            out = np.zeros(len(key), bool)
        else:
            at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            hit = self.known[at] == key
            out = self.legal[at] & hit
        if not hit.all():
            miss = np.nonzero(~hit)[0]
            new, back = np.unique(key[miss], return_inverse=True)
            names, width = self.names, self.start + 1
            ok = np.array([self.keeps(names[x // width], names[x % width]) for x in new.tolist()], bool)
            out[miss] = ok[back]
        return out

    def _remember_pairs(self):
        """Moves newly merged pairs into the sorted keys."""
        if self.pairs:
            vocab, start, width = self.vocab, self.start, self.start + 1
            new = [((vocab[a] if a else start) * width + vocab[b], ok) for (a, b), ok in self.pairs.items() if (not a or a in vocab) and b in vocab]
            self.pairs.clear()
            if len(self.known) > PAIRS:
                self.known, self.legal = np.empty(0, np.int64), np.empty(0, bool)
            key = np.concatenate([self.known, np.array([k for k, _ in new], np.int64)])
            ok = np.concatenate([self.legal, np.array([o for _, o in new], bool)])
            self.known, at = np.unique(key, return_index=True)
            self.legal = ok[at]

    def path_rows(self, segs: list[str]) -> list[tuple]:
        """``path`` of segments of one length at once: the same composition
        and shortest path, a row per segment (BPE models)."""
        n, m = len(segs[0]), len(segs)
        c = self._rows(segs, n)
        last = np.full((m, n + 1), -1, np.int64)
        back = np.zeros((m, n + 1), np.int8)
        last[:, 0] = self.start
        for i in range(n):
            live = np.nonzero(last[:, i] >= 0)[0]
            h = np.zeros(m, np.uint64)
            for size in range(1, min(self.longest, n - i) + 1):
                h = (h + c[:, i + size - 1]) * HASH
                if size not in self.slots:
                    continue
                rows = live[last[live, i + size] < 0]
                if not len(rows):
                    continue
                ids = self._find(size, h[rows])
                ok = ids >= 0
                rows, ids = rows[ok], ids[ok]
                if len(rows):
                    keep = self._keep_rows(last[rows, i], ids)
                    rows, ids = rows[keep], ids[keep]
                    last[rows, i + size] = ids
                    back[rows, i + size] = size
        self._remember_pairs()
        out, done = [], last[:, n] >= 0
        lists, steps = last.tolist(), back.tolist()
        for r in range(m):
            if not done[r]:  # a character without a piece: the byte fallback
                out.append(self.path(segs[r]))
                continue
            ids, j, row, step = [], n, lists[r], steps[r]
            while j:
                ids.append(row[j])
                j -= step[j]
            ids.reverse()
            out.append(tuple(ids))
        return out

    def learn(self, segs) -> None:
        """Paths of new segments, by length; a full generation becomes the older one."""
        if len(self.paths) > CACHE:
            self.older, self.paths = self.paths, {}
        by_len: dict[int, list] = {}
        for s in segs:
            if s in self.paths:
                continue
            if s in self.older:
                self.paths[s] = self.older[s]
                continue
            by_len.setdefault(len(s), []).append(s)
        for n, group in by_len.items():
            if self.bpe and n <= ROW and len(group) > 8:
                self.paths.update(zip(group, map(_pack, self.path_rows(group))))
            else:
                for s in group:
                    self.paths[s] = _pack(self.path(s))

    # ---- normaliser

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    # ---- weights of the BPE closure

    def merged(self, s: str) -> list[str]:
        """The merge rule on a short string: best score first, then leftmost."""
        syms = list(s)
        while True:
            best, at = None, -1
            for k in range(len(syms) - 1):
                w = self.score.get(syms[k] + syms[k + 1])
                if w is not None and (best is None or w > best):
                    best, at = w, k
            if at < 0:
                return syms
            syms[at:at + 2] = [syms[at] + syms[at + 1]]

    def keeps(self, a: str, b: str) -> bool:
        """Whether the arc to piece ``b`` after ``a`` ('' at the start) has weight 0."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    # ---- composition and shortest path

    def path(self, seg: str) -> tuple:
        """Piece ids of the cheapest path that spells ``seg``."""
        n = len(seg)
        cost, last, back = [None] * (n + 1), [""] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            if cost[i] is None:
                continue
            j = i + 1
            while j <= n:
                s = seg[i:j]
                known = s in self.vocab
                if known or j == i + 1:  # a piece, or one character for the byte fallback
                    if self.bpe:
                        c = cost[i] if self.keeps(last[i], s) else None
                    else:
                        c = cost[i] + (-self.score[s] if known else 1e6)
                    if c is not None and (cost[j] is None or c < cost[j]):
                        cost[j], last[j], back[j] = c, s, i
                if s not in self.prefixes:
                    break
                j += 1
        out, j = [], n
        while j:
            out.append(last[j])
            j = back[j]
        ids = []
        for s in reversed(out):
            i = self.vocab.get(s)
            if i is not None:
                ids.append(i)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in s.encode("utf-8", "replace"))
            else:
                ids.append(self.unk)
        return tuple(ids)

    def _blocks(self, norm: str):
        at = 0
        while at < len(norm):
            end = at + BLOCK
            if end < len(norm) and self.can_cut:
                m = re.compile(f"(?<!{SPACE}){SPACE}").search(norm, end)
                end = m.start() if m else len(norm)
            else:
                end = len(norm)
            yield norm[at:end]
            at = end

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null and '' have none."""
        return np.frombuffer(b"".join(self._spell([b]) for b in self._blocks(self.normalise(text or ""))), np.int32)

    def _spell(self, blocks: list[str]) -> bytes:
        segs = [self.cuts.findall(b) for b in blocks]
        self.learn(set(chain.from_iterable(segs)))
        return b"".join(map(self.paths.__getitem__, chain.from_iterable(segs)))

    def encode_many(self, texts: list) -> list[np.ndarray]:
        """``encode`` of a batch; new segments of short texts are composed together."""
        out: list = [None] * len(texts)
        group, size = [], 0
        short = [i for i, t in enumerate(texts) if len(t or "") <= BLOCK]
        for i in short:
            group.append(i)
            size += len(texts[i] or "")
            if size > 4 * BLOCK or i == short[-1]:
                segs = [self.cuts.findall(self.normalise(texts[k] or "")) for k in group]
                self.learn(set(chain.from_iterable(segs)))
                for k, s in zip(group, segs):
                    out[k] = np.frombuffer(b"".join(map(self.paths.__getitem__, s)), np.int32)
                group, size = [], 0
        return [x if x is not None else self.encode(t) for x, t in zip(out, texts)]

    # ---- the inverse transducer

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids spell: runs of byte pieces are read as UTF-8
        (an invalid byte becomes U+FFFD), the dummy prefix is taken off."""
        surface = self.surface
        if self.high[ids].any():
            out, run = [], bytearray()
            for i in ids.tolist():
                b = self.id_byte.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(surface[i])
            out.append(run.decode("utf-8", "replace"))
            s = "".join(out)
        else:
            s = "".join(map(surface.__getitem__, ids.tolist()))
        return s[1:] if self.dummy_prefix and s.startswith(" ") else s


_MACHINES: dict[int, Machine] = {}


def machine(model: bytes) -> Machine:
    """One machine per worker process and model."""
    key = hash(model)
    if key not in _MACHINES:
        _MACHINES[key] = Machine(model)
    return _MACHINES[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # read by the driver; its fixed few hundred KB travel with the tasks
        return f.read()


def encode(df: DataFrame, text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All rows and columns with ``ids`` (array<int>), ``n_tokens``, and
    ``round_trip``: decoding the ids gives the text back (with U+2581 read
    as a space, and runs of spaces squeezed if the model does so).

    Null and empty texts have no ids and round-trip to ''.  Texts are
    encoded whole, in blocks cut at segment boundaries.  Repeated rows are
    encoded alike, an empty table gives an empty result, and an input column
    called like a result column is replaced by it.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("ids", "n_tokens", "round_trip")])
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_model_bytes(model_path))
    out = T.StructType(df.schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
                                           T.StructField("round_trip", T.BooleanType())])
    src = df.select(*[F.col(q(c)) for c in df.columns], F.col(q(text_col)).alias("__text"))

    def run(batches):
        m = machine(shared.value)
        for b in batches:
            texts, same = b.column(b.num_columns - 1).to_pylist(), []
            ids = m.encode_many(texts)
            for text, x in zip(texts, ids):
                norm = m.normalise(text or "").replace(SPACE, " ")
                same.append(m.decode(x) == (norm[1:] if m.dummy_prefix else norm))
            ends = np.cumsum([0] + [len(x) for x in ids])
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            arr = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [arr, pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())],
                                             b.schema.names[:-1] + ["ids", "n_tokens", "round_trip"])

    return src.mapInArrow(run, out)


def decode(df: DataFrame, ids_col: str = "ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All rows and columns with ``decoded``: the text that the ids spell
    (null ids: null; an id outside the vocabulary: skipped)."""
    df = df.drop(*[c for c in df.columns if c.lower() == "decoded"])
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_model_bytes(model_path))
    out = T.StructType(df.schema.fields + [T.StructField("decoded", T.StringType())])
    src = df.select(*[F.col(q(c)) for c in df.columns], F.col(q(ids_col)).alias("__ids"))

    def run(batches):
        m = machine(shared.value)
        for b in batches:
            texts = []
            for x in b.column(b.num_columns - 1):
                if not x.is_valid:
                    texts.append(None)
                    continue
                a = np.array([i for i in x.as_py() if i is not None and 0 <= i < len(m.surface)], np.int64)
                texts.append(m.decode(a))
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(texts, pa.string())], b.schema.names[:-1] + ["decoded"])

    return src.mapInArrow(run, out)
