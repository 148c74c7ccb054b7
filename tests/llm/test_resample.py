"""Importance resampling: CRCs of word runs, draws and hostile rows against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, n):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz09é語 -_.\n\U0001f600", max_size=60)), max_size=6), st.integers(1, 4))
def test_runs_have_the_crc_of_their_text(texts, n):
    doc, crc, count = resample.features(texts, n)
    got = Counter(zip(doc.tolist(), crc.tolist()))
    want = Counter((i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in grams(t, n))
    assert got == want and count.tolist() == [len(words(t)) for t in texts]


def test_shift_past_many_zeros():
    c = np.array([zlib.crc32(b"abc")] * 3, np.uint32)
    n = np.array([0, 1, 70_001])
    tail = [bytes(k) for k in n]
    want = [zlib.crc32(b"abc" + t) ^ zlib.crc32(t) for t in tail]
    assert resample.shifted(c, n).tolist() == want


def brute(docs, target, n, buckets, percent, least, seed):
    def crc(g):
        return zlib.crc32(g.encode()) % buckets
    s = Counter(crc(g) for _, t in docs for g in grams(t, n))
    t = Counter(crc(g) for x in target for g in grams(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = [gain[crc(g)] for g in grams(x, n)]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(f) // len(f) if f else 0
        rows.append([i, len(words(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): k for k, r in enumerate(fit[:len(fit) * percent // 100], 1)}
    return sorted((tuple([*r, rank.get(id(r))]) for r in rows), key=repr)


def test_draw_against_brute_force(spark):
    docs = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 40)) + " É.x") for i in range(150)]
    docs += [(200, None), (201, ""), (202, "?! -"), (None, "a b c " * 30), (203, "Word " * 50_000), (7, docs[7][1]), (7, docs[7][1]), (90, "w1 w2 " * 30)]
    target = ["w1 w2 w3 w3", None, "", "w5 W5 é"]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, rank int, score string")
    tg = spark.createDataFrame([(t,) for t in target], "text string")
    for n, percent in ((1, 10), (3, 50), (2, 100), (2, 0)):
        got = resample.importance_resample(df, tg, max_n=n, buckets=64, percent=percent)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, n, 64, percent, 20, 2024)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.importance_resample(none, some).collect() == []
    assert [r["weight"] for r in resample.importance_resample(some, none).collect()] == [-693]  # floor(1000 ln(10003 / 20000))
