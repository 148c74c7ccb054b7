"""Removal of long byte strings that occur twice, by a sampled enhanced
suffix array with its tree of common-prefix intervals.

Every window of LENGTH bytes holds one anchor, the leftmost smallest hash
of its WIDTH-byte strings, wherever the window occurs.  So it suffices to
sort the suffixes at anchors: anchors with the same WIDTH bytes meet in
one group, which is a piece of the suffix array.  In a group the suffixes
are sorted, a stack scan over their common prefixes builds the tree of
LCP intervals, and each interval's members are compared by what stands to
their left: members that share a left extension long enough form a repeat
with all its occurrences, not just neighbours.  What they cover is removed.

Whole documents that occur twice are one class from the start.  Equal
contexts in a group are one member, and a group with more than BLOCK rows is
reduced to one row a member.  A group with more than BLOCK members
is split by longer keys: windows that start far left of the anchor share
more bytes there, windows that end far right share more on that side, so
both halves are smaller groups of their own.  Members that agree on the
bytes of all windows of a half are done with it, and one of them stands for
all; so a passage in very many documents costs a row a document and half,
not a row a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.functions.stored import bitmap, maybe_in, surely_out
from scrubline.llm.common import cut, map_runs, q, small_batches, text_or_empty

#: Bytes of the strings an anchor is chosen by; a longer string means fewer false meetings and more anchors.
WIDTH = 200
#: Rows of a group that one task holds and sorts.
BLOCK = 1 << 12
#: Rows of a group beyond which it is reduced to one row a context first, and rows of small groups a task gets.
ROWS, TASK_ROWS = 1 << 11, 1 << 14
#: Bytes of a text handled at once when anchors are chosen.
PIECE = 1 << 18
RADIX = 0x9E3779B97F4A7C15
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple] = {}


def _powers(n: int):
    if n not in _POWERS:
        one = np.ones(1, np.uint64)
        _POWERS[n] = tuple(np.concatenate([one, np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (RADIX, pow(RADIX, -1, 1 << 64)))
    return _POWERS[n]


def _prefix_sums(b: np.ndarray):
    up, down = _powers(PIECE + (1 << 12))
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[:len(b)], out=s[1:])
    return s, up


def anchors(b: np.ndarray, length: int, width: int = WIDTH):
    """(positions, keys, context hashes) of a text's anchors."""
    n, w = len(b), length - width + 1
    pos, key, ctx = [], [], []
    for at in range(0, n - length + 1, PIECE):
        lo = max(0, at - (w - 1))  # contexts reach w - 1 bytes left and length bytes right of an anchor
        part = b[lo:at + PIECE + 2 * length]
        s, up = _prefix_sums(part)
        h = _mix((s[width:] - s[:-width]) * up[:len(part) - width + 1])
        first = at - lo
        last = min(at + PIECE, n - length + 1) - lo  # window starts first..last-1
        v = (h[first:last + w - 1] & ~np.uint64(PIECE * 2 - 1)) | np.arange(last - first + w - 1, dtype=np.uint64)
        pad = -len(v) % w
        v = np.concatenate([v, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
        left = np.minimum.accumulate(v, 1).ravel()
        right = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
        m = np.minimum(right[:last - first], left[w - 1:w - 1 + last - first])
        p = np.unique(m & np.uint64(PIECE * 2 - 1)).astype(np.int64) + first
        a, e = np.maximum(p - (w - 1), 0), np.minimum(p + length, len(part))
        pos.append(p + lo)
        key.append(h[p])
        ctx.append(_mix(_mix((s[e] - s[a]) * up[a]) + ((p - a) * 4096 + (e - p)).astype(np.uint64)))
    if not pos:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    p, k, c = map(np.concatenate, (pos, key, ctx))
    p, i = np.unique(p, return_index=True)
    return p, k[i], c[i]


def _merge(start: np.ndarray, end: np.ndarray):
    """Union of intervals as sorted disjoint runs (touching runs are one)."""
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(end) - 1]])]


def _classes(docs: DataFrame, length: int) -> DataFrame:
    """One row per distinct text of at least ``length`` bytes: its hash, how
    often it occurs, the smallest id, anchors, and the runs that anchors with
    equal contexts inside the text cover."""
    small_batches(docs.sparkSession)

    def run(batches):
        for t in batches:
            keys, pos, spans = [], [], []
            for text in t.column(2).to_pylist():
                b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                p, k, c = anchors(b, length)
                u, first, n = np.unique(c, return_index=True, return_counts=True)
                runs = []
                if (n > 1).any():  # equal contexts inside the text: covered, and one of them stands for all
                    r = p[np.isin(c, u[n > 1])]
                    a, e = np.maximum(r - (length - WIDTH), 0), np.minimum(r + length, len(b))
                    ok = e - a >= length
                    if ok.any():
                        runs = np.stack(_merge(a[ok], e[ok]), 1).ravel().tolist()
                first.sort()
                keys.append(k[first].view(np.int64))
                pos.append(p[first])
                spans.append(runs)
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(keys, longs), pa.array(pos, ints), pa.array(spans, ints)],
                                             ["id", "h", "keys", "pos", "spans"])

    long_ = docs.where(F.octet_length("text") >= length).select("id", "h", "text")
    out = long_.mapInArrow(run, "id long, h binary, keys array<long>, pos array<int>, spans array<int>")
    return out.groupBy("h").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.any_value("keys").alias("keys"),
                                F.any_value("pos").alias("pos"), F.any_value("spans").alias("spans"))


def _contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(key, c1, c2, h, pos, l, r, ctx): every anchor that met another, with
    the bytes around it.  Of equal contexts in a batch only one carries them."""
    # a fixed-size bitmap of the documents in question keeps the others' texts out of the shuffle
    # and texts are dealt out once, by columns that serve both the distinct rows and the join
    by, known = ["h", "some", "none"], [F.coalesce("id", F.lit(0)).alias("some"), F.col("id").isNull().alias("none")]
    held = (maybe_in(docs, bitmap(places, ["h", "id"]), ["h", "id"]).select("h", *known, "text").dropDuplicates(by)
            .join(places.select("h", *known, "places"), by).select("h", "places", "text"))

    def run(batches):
        for t in batches:
            seen: set = set()
            rows: list[list] = [[] for _ in range(8)]
            for h, at, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist()):
                b = text.encode("utf-8", "surrogatepass")
                for x in at:
                    p = x["pos"]
                    a, e = max(0, p - (length - WIDTH)), min(len(b), p + length)
                    ctx = b[a:e]
                    c = hashlib.blake2b(ctx, digest_size=16, salt=(p - a).to_bytes(4, "big")).digest()
                    for out, v in zip(rows, (x["key"], int.from_bytes(c[:8], "big", signed=True), int.from_bytes(c[8:], "big", signed=True),
                                             h, p, p - a, e - p, None if c in seen else ctx)):
                        out.append(v)
                    seen.add(c)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, types)], ["key", "c1", "c2", "h", "pos", "l", "r", "ctx"])

    return held.mapInArrow(run, "key long, c1 long, c2 long, h binary, pos int, l int, r int, ctx binary")


def _common(rows: list[bytes]) -> np.ndarray:
    """Lengths of the common prefixes of neighbouring strings."""
    wide = max(1, *map(len, rows))
    size = np.array([len(r) for r in rows])
    m = np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in rows), np.uint8).reshape(len(rows), wide)
    differ = m[1:] != m[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), wide)
    return np.minimum(lcp, np.minimum(size[1:], size[:-1]))


def _intervals(lcp: list[int], floor: int):
    """LCP intervals (depth, first, last) of depth >= floor, by a stack scan."""
    stack = [(0, 0)]
    for i, d in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][0] > d:
            depth, left = stack.pop()
            if depth >= floor:
                yield depth, left, i
        if not stack or stack[-1][0] < d:
            stack.append((d, left))


def group_cover(left: list[bytes], right: list[bytes], lo: int, hi: int, length: int):
    """(member, l, r) covers of a group: the bytes from l before to r after
    the anchor lie in windows, starting lo..hi bytes before it, that another
    member has too.  ``left`` holds the reversed bytes before the anchors."""
    order = sorted(range(len(right)), key=right.__getitem__)
    ranks = np.empty(len(left), np.int64)
    ranks[sorted(range(len(left)), key=left.__getitem__)] = np.arange(len(left))
    lcp = _common([right[i] for i in order]).tolist()
    for depth, i, j in _intervals(lcp, length - hi):
        members = sorted(order[i:j + 1], key=ranks.__getitem__)
        ext = _common([left[m] for m in members])
        # left-extension diversity: neighbours in left order that share enough belong to one repeat
        best = np.maximum(np.concatenate([[0], ext]), np.concatenate([ext, [0]]))
        best = np.minimum(best, hi)
        reach = min(depth, length - lo)
        for k in np.nonzero(best + reach >= length)[0].tolist():
            yield members[k], int(best[k]), reach


def _group(length: int):
    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        c1, c2 = g["c1"].to_numpy(), g["c2"].to_numpy()
        _, first = np.unique(c1 ^ (c2 * 31), return_index=True)
        if len(first) < 2:
            return None
        l, ctx, lo, hi = g["l"].to_numpy(), g["ctx"].tolist(), int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
        left = [ctx[i][:l[i]][::-1] for i in first]
        right = [ctx[i][l[i]:] for i in first]
        found = list(group_cover(left, right, lo, hi, length))
        if not found:
            return None
        m, a, e = map(np.array, zip(*found))
        # every member's covers in a lane of their own, merged at once
        lane, zero = 4 * length, length
        s, t = _merge(m * lane + zero - a, m * lane + zero + e)
        k = s // lane
        return pd.DataFrame({"c1": c1[first[k]], "c2": c2[first[k]], "s": s - k * lane - zero, "e": t - k * lane - zero})

    return one


def _covers(ctx: DataFrame, length: int) -> DataFrame:
    """(c1, c2, s, e): what each context covers, relative to its anchor.

    Groups are sized on narrow rows first.  Bitmaps of the keys tell the rows
    of small groups, which are dealt out at once, from those that may have a
    key with very many rows.  The latter are joined by key, so adaptive
    execution can split such a key, and it is reduced to one row a context by
    an aggregate that works map-side, before its rows are dealt out by key."""
    source = ctx.where("ctx is not null").select("key", "c1", "c2", "l", "r", "ctx")
    source = source.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - WIDTH))
    cover, limit = "c1 long, c2 long, s int, e int", min(ROWS, BLOCK)
    result = None
    while True:
        g = ["key", "lo", "hi"]
        size = cut(source.groupBy(*g).agg(F.countDistinct("c1", "c2").alias("m"), F.count("*").alias("n")).where(f"m > 1 OR n > {limit}"), "size")
        two = size.where("m > 1")
        rows, many = two.agg(F.coalesce(F.sum(F.least("n", F.greatest("m", F.lit(limit)))), F.lit(0)), F.count_if(F.col("n") > limit)).first()
        tasks = max(1, -(-rows // TASK_ROWS))
        # a key that slips through the bitmap has few rows of one context, which cover nothing
        large = bitmap(size.where(f"n > {limit}"), g, "large")
        small, apart = surely_out(maybe_in(source, bitmap(two, g, "small"), g), large, g), maybe_in(source, large, g)
        small = small.unionByName(apart.join(two.where(f"n <= {limit}").select(*g), g).select(*small.columns))
        if not many:
            part = map_runs(small, g, _group(length), cover, tasks=tasks)
            return part if result is None else result.unionByName(part)
        once = apart.join(two.where(f"n > {limit}").select(*g, "m"), g)
        once = cut(once.groupBy(*g, "m", "c1", "c2").agg(*[F.any_value(c).alias(c) for c in ("l", "r", "ctx")]), "hot")
        part = map_runs(small.unionByName(once.where(f"m <= {BLOCK}").select(*small.columns)), g, _group(length), cover, tasks=tasks)
        result = part if result is None else result.unionByName(part)
        hot = once.where(f"m > {BLOCK}").drop("m")
        if hot.isEmpty():
            return result
        # the bytes of all windows from lo to hi: members that share them share every window, and one of them stands for all
        whole = (F.col("l") >= F.col("hi")) & (F.col("r") >= F.lit(length) - F.col("lo"))
        span = F.substring(F.col("ctx"), (F.col("l") - F.col("hi") + 1).cast("int"), (F.col("hi") + F.lit(length) - F.col("lo")).cast("int"))
        hot = hot.select("*", *[F.when(whole, F.xxhash64(F.lit(k), span)).alias(f"u{k}") for k in (1, 2)])
        same = hot.where("u1 IS NOT NULL").groupBy(*g, "u1", "u2").agg(F.count("*").alias("k"), F.min(F.struct("c1", "c2")).alias("one")).where("k > 1").drop("k")
        hot = cut(hot.join(cut(same, "same"), [*g, "u1", "u2"], "left"), "told")
        result = result.unionByName(hot.where("one IS NOT NULL").select("c1", "c2", (-F.col("hi")).alias("s"), (F.lit(length) - F.col("lo")).cast("int").alias("e")))
        rest = hot.where((F.col("one").isNull() | (F.col("one") == F.struct("c1", "c2"))) & (F.col("lo") < F.col("hi"))).drop("u1", "u2", "one")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
        split = rest.withColumn("half", F.explode(halves)).drop("lo", "hi").select("*", "half.*").drop("half")
        # the bytes that all windows of the half share
        split = split.where(F.col("l") >= F.col("lo")).where(F.col("r") >= F.lit(length) - F.col("hi"))
        shared = F.substring(F.col("ctx"), (F.col("l") - F.col("lo") + 1).cast("int"), (F.col("lo") + F.lit(length) - F.col("hi")).cast("int"))
        source = cut(split.withColumn("key", F.xxhash64("key", shared)).select("key", "c1", "c2", "l", "r", "ctx", "lo", "hi"), "halves")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans): one row per
    input row.  Removed is every byte covered by a ``length``-byte string
    that also starts anywhere else, in the same or another document; spans
    are the removed runs as (start, end) byte offsets, flattened.

    Null texts are empty.  Texts shorter than ``length`` stay.  A text that
    occurs in two rows (whatever their ids) is removed whole, ties included.
    Very long texts are handled whole, in pieces that overlap.  An empty
    table gives an empty result; other columns are ignored.
    """
    text = text_or_empty(F.col(q(text_col)).cast("string"))
    docs = df.select(F.col(q(id_col)).cast("long").alias("id"), text.alias("text"))
    docs = docs.withColumn("h", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    cls = cut(_classes(docs, length), "cls")
    at = cls.select("h", F.explode(F.arrays_zip("keys", "pos")).alias("x")).select("h", F.col("x.keys").alias("key"), F.col("x.pos").alias("pos"))
    place = F.xxhash64("h", "pos")
    # written, so that the join by key is one of two scans and adaptive execution can split a key that very many rows have
    met = cut(at.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("key"), "met")
    places = cut(maybe_in(at, bitmap(met, ["key"]), ["key"]).join(met, "key").groupBy("h").agg(F.collect_list(F.struct("key", "pos")).alias("places"))
                 .join(cls.select("h", "id"), "h"), "places")
    ctx = cut(_contexts(docs, places, length), "ctx")
    covers = cut(_covers(ctx, length), "covers")
    where = ctx.select("c1", "c2", "h", "pos", "l", "r")
    once = cls.where("copies = 1").select("h", "id")
    # a context that occurs twice is covered whole; covers found by sorting concern the others
    count = where.groupBy("c1", "c2").count()
    covers = covers.groupBy("c1", "c2", "s").agg(F.max("e").alias("e")).join(count.where("count = 1").drop("count"), ["c1", "c2"], "left_semi")
    sorted_ = where.join(covers, ["c1", "c2"]).select("h", (F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e")).alias("e"))
    equal = where.where(F.col("l") + F.col("r") >= length).join(count.where("count > 1").drop("count"), ["c1", "c2"], "left_semi").select(
        "h", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e"))
    own = cls.where("size(spans) > 0").select("h", F.explode(F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(
        F.get("spans", i).alias("s"), F.get("spans", i + 1).alias("e")))).alias("x")).select("h", "x.s", "x.e")
    runs = sorted_.unionByName(equal).unionByName(own).join(once, "h")
    partial = cut(runs.groupBy("h", "id").agg(F.collect_list(F.struct("s", "e")).alias("runs")), "runs")

    # rows without a partial removal need no text
    narrow = docs.select("id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    all_ = F.coalesce(F.col("copies") > 1, F.lit(False))
    whole = (narrow.join(cls.select("h", "copies"), "h", "left").join(partial.select("h", F.lit(True).alias("cut")), "h", "left")
             .where("cut is null").select(
                 "id", "n_bytes", F.when(all_, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
                 all_.cast("long").alias("n_spans"), F.when(all_, F.lit(EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"),
                 F.when(all_, F.array(F.lit(0), F.col("n_bytes").cast("int"))).otherwise(F.array().cast("array<int>")).alias("spans")))
    p = partial.select(F.col("h").alias("h2"), F.col("id").alias("id2"), "runs")
    rest = maybe_in(docs, bitmap(partial, ["h"]), ["h"]).join(p, (F.col("h") == F.col("h2")) & F.col("id").eqNullSafe(F.col("id2"))).select("id", "runs", "text")

    def run(batches):
        for t in batches:
            rows: list[list] = [[] for _ in range(5)]
            for runs_, text_ in zip(t.column(1).to_pylist(), t.column(2).to_pylist()):
                b = text_.encode("utf-8", "surrogatepass")
                s, e = _merge(np.array([x["s"] for x in runs_]), np.array([x["e"] for x in runs_]))
                sha, at_ = hashlib.sha256(), 0
                for x, y in zip(s.tolist(), e.tolist()):
                    sha.update(b[at_:x])
                    at_ = y
                sha.update(b[at_:])
                for out, v in zip(rows, (len(b), int((e - s).sum()), len(s), sha.hexdigest(), np.stack([s, e], 1).ravel().tolist())):
                    out.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([t.column(0)] + [pa.array(v, k) for v, k in zip(rows, types)],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return whole.unionByName(rest.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>"))
