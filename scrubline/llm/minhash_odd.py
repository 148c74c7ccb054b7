"""MinHash near-duplicate detection with odd sketches.

Documents are sets of word shingles.  MinHash samples are banded to find
candidates; the samples are also folded into a parity bitmap (odd sketch),
whose population count under XOR estimates the similarity of a candidate
pair from 128 bytes, and a second parity bitmap of the whole set gives a
bound that is never wrong: a bit that differs needs an element that
differs.  Pairs that pass both are confirmed on their full shingle sets.

Only what connects documents is confirmed: every bucket first links its
members to one of them, then the members that are still apart are compared
by their sketches.  Pairs within a component that is already connected are
never listed, so a bucket of m copies costs m links, not m^2.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import cut, drop_cut, map_runs, q, small_batches
from scrubline.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bands x rows of the MinHash: a pair misses all buckets with a probability
#: of 7e-9 at a similarity of 0.85 and of 3e-6 at 0.8.
BANDS, ROWS = 32, 5
#: Bits of each parity bitmap.
SKETCH_BITS = 1024
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 6.0
#: Members of a bucket, and words of their texts, that one task compares with as many others;
#: larger buckets are dealt out in pairs of blocks.
BLOCK, BLOCK_WORDS = 2048, 1 << 21
_rng = np.random.default_rng(8)
MUL = (_rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
RADIX = 0x9E3779B97F4A7C15
TEXT_BLOCK = 1 << 16
#: Words of more bytes are hashed by a keyed hash of their own.
LONG_WORD = 256


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of RADIX and of its inverse, modulo 2^64."""
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (RADIX, pow(RADIX, -1, 1 << 64)))


_POWERS = _powers(TEXT_BLOCK + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    sep = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], sep, [True]]).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    out, i = [], 0
    while i < len(start):  # blocks of whole words: bounded memory for very long texts
        j = max(i + 1, int(np.searchsorted(end, start[i] + TEXT_BLOCK)))
        out.append(_hash_words(b[start[i]:end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]))
        i = j
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hash_words(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """sum of (byte + 1) * r^(end - position) of every word, by prefix sums."""
    n = len(b)
    up = _POWERS if n < len(_POWERS[0]) else _powers(n + 1)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[1][:n])])
    out = _mix((s[end] - s[start]) * up[0][end] ^ ((end - start).astype(np.uint64) << np.uint64(48)))
    for i in np.nonzero(end - start > LONG_WORD)[0]:  # sums of powers of two coincide on some long strings
        out[i] = int.from_bytes(hashlib.blake2b(b[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; the whole
    sequence if there are fewer words; empty without words."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, np.uint64)
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def minhashes(s: np.ndarray) -> np.ndarray:
    out = np.empty(BANDS * ROWS, np.uint64)
    for i in range(0, len(s), 4096):  # blocks: bounded memory for very long texts
        m = (s[i:i + 4096, None] * MUL + ADD).min(0)
        out = m if i == 0 else np.minimum(out, m)
    return out


def parity(x: np.ndarray) -> np.ndarray:
    """Parity bitmap of hashed elements: SKETCH_BITS bits as 64-bit words."""
    bits = np.bincount((x >> np.uint64(54)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def band_keys(m: np.ndarray) -> np.ndarray:
    k = np.full(BANDS, 0, np.uint64)
    rows = m.reshape(BANDS, ROWS)
    for r in range(ROWS):
        k = _mix(k * np.uint64(0xD6E8FEB86659FD93) + rows[:, r])
    return _mix(k + np.arange(BANDS, dtype=np.uint64))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, digest, keys, odd, whole) for every row; no text leaves the scan."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(q(id_col)).cast("long").alias("id"), F.col(q(text_col)).cast("string").alias("__text"))
    out = "id long, n long, digest binary, keys array<long>, odd binary, whole binary"

    def run(batches):
        slot = (np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        for b in batches:
            n, digest, keys, odd, whole = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                if not len(s):
                    digest.append(None), keys.append(None), odd.append(None), whole.append(None)
                    continue
                m = minhashes(s)
                digest.append(np.array([s.sum(), np.bitwise_xor.reduce(_mix(s * MUL[0])), (_mix(s ^ MUL[1])).sum()], np.uint64).tobytes())
                keys.append(band_keys(m).view(np.int64))
                odd.append(parity(_mix(m ^ slot)).tobytes())
                whole.append(parity(_mix(s)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                                              pa.array(odd, pa.binary()), pa.array(whole, pa.binary())], ["id", "n", "digest", "keys", "odd", "whole"])

    return src.mapInArrow(run, out)


def _may_link(oa, wa, na, ob, wb, nb, num: int, den: int) -> np.ndarray:
    """Candidate test of rows against rows; False only for pairs that are
    certainly (whole-set bitmap) or almost certainly (MARGIN standard errors
    of the odd sketch) below num / den."""
    t = num / den
    total = na + nb
    # J >= t  <=>  |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|); the bitmaps differ in at most that many bits
    sure = np.bitwise_count(wa ^ wb).sum(-1).astype(np.int64) <= np.floor((1 - t) / (1 + t) * total + 1e-9)
    k = BANDS * ROWS
    z = np.bitwise_count(oa ^ ob).sum(-1).astype(np.float64)
    d = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * z / SKETCH_BITS, 1e-3))  # samples that differ, counted twice
    j = 1 - d / (2 * k)
    err = np.sqrt(t * (1 - t) / k + 0.25 * d / k / k)
    size = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    return sure & size & (j >= t - MARGIN * err)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The (a, b) whose full shingle sets have den * |A & B| >= num * |A | B|."""
    p = pairs.join(texts.select(F.col("id").alias("a"), F.col("__text").alias("ta")), "a")
    p = p.join(texts.select(F.col("id").alias("b"), F.col("__text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        memo: dict = {}

        def sets(i, t):
            if i not in memo:
                if len(memo) > 512:
                    memo.clear()
                memo[i] = shingle_set(t, width)
            return memo[i]

        for b in batches:
            a, c, ok = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, j, s, t in zip(a, c, b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = sets(i, s), sets(j, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return p.mapInArrow(run, "a long, b long")


def _frame(g: pd.DataFrame):
    """(ids, components, sizes, odd sketches, whole sketches) of members."""
    odd, whole = (np.frombuffer(b"".join(g[c]), np.uint64).reshape(len(g), -1) for c in ("odd", "whole"))
    return g["id"].to_numpy(), g["c"].to_numpy(), g["n"].to_numpy(), odd, whole


def _apart(members: DataFrame, sketches: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """(g, id, c): groups of bucket members, in different components, that
    the sketches connect; one row a member, however many pairs pass.  Buckets
    whose members are all connected drop out before any sketch is moved; a
    bucket over BLOCK members is dealt out as pairs of blocks, each its own
    group.  Equal groups, met in several buckets, have one ``g``."""
    m = members.join(comp, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
    open_ = m.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("words")).where("lo < hi")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    m = m.join(open_.select("key", blocks.alias("nb")), "key").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    m = m.select("key", "id", "c", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"), "blk")
    m = m.join(sketches, "id").select("key", "b1", "b2", "blk", "id", "c", "n", "odd", "whole")

    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        ids, c, n, odd, whole = _frame(g)
        split, first = g["b1"].iloc[0] != g["b2"].iloc[0], (g["blk"] == g["b1"]).to_numpy()
        lab = np.arange(len(g))
        for i in np.nonzero(first)[0] if split else range(len(g)):
            # members that this one may link and that no chain of such pairs has reached yet
            other = np.nonzero((c != c[i]) & (lab != lab[i]) & (~first if split else np.arange(len(g)) > i))[0]
            if len(other):
                ok = other[_may_link(odd[i], whole[i], n[i], odd[other], whole[other], n[other], num, den)]
                if len(ok):
                    lab[np.isin(lab, lab[ok])] = lab[i]
        root, size = np.unique(lab, return_counts=True)
        keep = np.isin(lab, root[size > 1])
        if not keep.any():
            return None
        out = pd.DataFrame({"lab": lab[keep], "id": ids[keep], "c": c[keep]}).sort_values(["lab", "id"])
        sign = {k: hashlib.blake2b(v.to_numpy().tobytes(), digest_size=16).digest() for k, v in out.groupby("lab")["id"]}
        return pd.DataFrame({"g": out["lab"].map(sign), "id": out["id"], "c": out["c"]})

    return map_runs(m, ["key", "b1", "b2"], one, "g binary, id long, c long").distinct()


def _joined(groups: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): components joined by links confirmed on full shingle sets.  A
    task holds the texts of one group; pairs that are connected already are
    skipped, so at most a spanning forest comes out."""
    rows = groups.join(sketches, "id").join(texts.withColumnRenamed("__text", "text"), "id").select("g", "id", "c", "n", "odd", "whole", "text")

    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        g = g.sort_values(["n", "id"])  # likely partners are near each other in size
        ids, c, n, odd, whole = _frame(g)
        text, sets, lab, edges = g["text"].tolist(), {}, c.copy(), []

        def full(i):
            if i not in sets:
                sets[i] = shingle_set(text[i], width)
            return sets[i]

        for i in range(len(g) - 1):
            other = i + 1 + np.nonzero(lab[i + 1:] != lab[i])[0]
            if not len(other):
                continue
            for j in other[_may_link(odd[i], whole[i], n[i], odd[other], whole[other], n[other], num, den)].tolist():
                if lab[i] == lab[j]:
                    continue
                both = len(np.intersect1d(full(i), full(j), assume_unique=True))
                if den * both >= num * (n[i] + n[j] - both):
                    edges.append((lab[i], lab[j]))
                    lab[lab == lab[j]] = lab[i]
            sets.pop(i, None)
        return pd.DataFrame(edges, columns=["a", "b"]) if edges else None

    return map_runs(rows, ["g"], one, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    num: int = 4, den: int = 5) -> DataFrame:
    """(id, n_shingles, component_id): one row per input row; documents are
    linked if the similarity of their shingle sets is at least num / den,
    ``component_id`` is the smallest id reachable.

    Rows with equal sets are one class and are linked.  Null, empty and
    blank texts have no shingles and link with nothing.  Ids must be
    integers, and rows that repeat an id must repeat its text; a null id
    keeps a row with a null component.  An
    empty table gives an empty result; other columns are ignored.
    """
    sig = cut(signatures(docs, id_col, text_col, width), "sig")
    real = sig.where("n > 0 and id is not null")
    # one representative per set: copies link to it and take no part in the search
    rep = real.groupBy("n", "digest").agg(F.min("id").alias("rep"), F.min_by(F.struct("keys", "odd", "whole"), "id").alias("s"))
    rep = cut(rep.select("n", "digest", F.col("rep").alias("id"), "s.*"), "rep")
    copies = real.join(rep.select("n", "digest", F.col("id").alias("rep")), ["n", "digest"]).where("id <> rep").select("rep", "id")
    keys = rep.select("id", "n", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    members = cut(keys.join(buckets, "key").select("key", "id", "n", "hub"), "members")
    near = cut(members.select("id").distinct(), "near")  # written, so Spark knows its size when it picks the joins
    text = docs.select(F.col(q(id_col)).cast("long").alias("id"), F.col(q(text_col)).cast("string").alias("__text"))
    # texts of bucket members only, written once for both confirmations
    texts = cut(text.join(near, "id", "left_semi").dropDuplicates(["id"]), "texts")
    sketches = rep.join(near, "id", "left_semi").select("id", "n", "odd", "whole")
    # first the links of every bucket to its smallest member
    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    s1 = stars.join(sketches.select(F.col("id").alias("a"), F.struct("n", "odd", "whole").alias("sa")), "a") \
              .join(sketches.select(F.col("id").alias("b"), F.struct("n", "odd", "whole").alias("sb")), "b")
    links = cut(_confirmed(_screen(s1, num, den), texts, width, num, den), "links")
    comp = cut(components(links), "comp")
    # then the members that are still apart: their links join components
    groups = cut(_apart(members.drop("hub"), sketches, comp, num, den), "groups")
    joined = cut(components(cut(_joined(groups, sketches, texts, width, num, den), "joined")), "comp2")
    for t in (members, near, texts, links, groups):
        drop_cut(t)  # all that is left to read is ids
    found = rep.select("id").join(comp, "id", "left").select("id", F.coalesce("component_id", "id").alias("c"))
    found = found.join(joined.select(F.col("id").alias("c"), "component_id"), "c", "left").select("id", F.coalesce("component_id", "c").alias("component_id"))
    found = found.unionByName(copies.join(found.withColumnRenamed("id", "rep"), "rep").select("id", "component_id"))
    return (sig.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
            .select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id")))


def _screen(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of pairs whose sketches let them through."""
    def run(batches):
        for t in batches:
            g = t.to_pylist()
            if not g:
                continue
            get = lambda s, f: np.frombuffer(b"".join(x[s][f] for x in g), np.uint64).reshape(len(g), -1)
            na, nb = (np.array([x[s]["n"] for x in g]) for s in ("sa", "sb"))
            ok = pa.array(_may_link(get("sa", "odd"), get("sa", "whole"), na, get("sb", "odd"), get("sb", "whole"), nb, num, den))
            yield pa.RecordBatch.from_arrays([pa.array([x["a"] for x in g], pa.int64()).filter(ok), pa.array([x["b"] for x in g], pa.int64()).filter(ok)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")
