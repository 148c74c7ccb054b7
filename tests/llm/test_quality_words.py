"""Words of a whole column are coded together; their codes are those of one word at a time."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from scrubline.llm import quality


def plain(word):
    shape = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word), flags=re.S)
    s = zlib.crc32(shape.encode())
    return zlib.crc32(word.lower().encode(), s) % quality.BUCKETS, s * 31 % quality.BUCKETS


def words(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcXYZ019é-Σς字İß😀\0") for _ in range(rnd.randrange(1, 14))) for _ in range(n)]


def test_codes_are_those_of_each_word(monkeypatch):
    some = [*words(500, 1), "x" * 300, "aB0" * 100]
    texts = [None, "", " \n ", " ".join(some[:200]) + " ", " " + "\x1c".join(some[200:])]
    for block in (quality.BLOCK, 50):
        monkeypatch.setattr(quality, "BLOCK", block)
        for kind in (pa.string(), pa.large_string()):
            parts = list(quality.word_codes(pa.array(texts, kind)))
            row, _, w, s = (np.concatenate([p[i] for p in parts]).tolist() for i in range(4))
            assert list(zip(row, w, s)) == [(i, *plain(x)) for i, t in enumerate(texts) for x in (t or "").split()]


def test_words_are_not_coded_one_at_a_time(monkeypatch):
    calls = []
    crc32 = zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda *a: calls.append(a) or crc32(*a))
    list(quality.word_codes(pa.array([" ".join(words(5000, 2))])))
    assert not calls


def test_features_do_not_depend_on_the_other_texts():
    table = np.random.default_rng(3).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = [" ".join(words(k, k)) for k in range(40)]
    x = quality.pooled(pa.array(texts), table)
    assert np.array_equal(x, np.concatenate([quality.pooled(pa.array([t]), table) for t in texts]))
    w, s = map(np.array, zip(*map(plain, texts[20].split())))
    assert np.allclose(x[20, :quality.DIM], table[w].mean(0)) and np.allclose(x[20, quality.DIM:2 * quality.DIM], quality.INDEX[s].mean(0))
