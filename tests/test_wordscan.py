"""Word lists by automaton: against plain scans, against rules, split lists, a million words."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.operators import words as W
from scrubline.operators import wordscan as S
from scrubline.operators.detect import Options, detect
from scrubline.operators.rules import Rule
from scrubline.operators.sanitize import sanitize


def plain(text, words):
    """(start, end, word) by scanning for each word from left to right."""
    out = []
    for i, w in enumerate(words):
        f = lambda x: "".join(chr(c) for c in S.fold(S.code_points(x), w.isascii()))
        t, p, at = f(text), f(w), 0
        while (k := t.find(p, at)) >= 0:
            out.append((k, k + len(w), i))
            at = k + len(w)
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abAéİſ ", min_size=1, max_size=5), min_size=1, max_size=8), st.lists(st.text(alphabet="abAÉéſs\U0001f600 ", max_size=40), max_size=4))
def test_hits_equal_plain_scans(words, texts):
    distinct = {S.fold(S.code_points(w), w.isascii()).tobytes() + bytes([w.isascii()]): w for w in reversed(words)}
    words = list(distinct.values())
    index = S.WordIndex([(w, 0, i) for i, w in enumerate(words)])
    got = S._batch_hits(index, [None, *texts]).to_pylist()
    assert got[0] == []
    for t, hits in zip(texts, got[1:]):
        assert sorted((h["start"], h["end"], h["ord"]) for h in hits) == plain(t, words)
        for h in hits:
            assert h["match"] == t[h["start"]:h["end"]] and t.encode()[h["bstart"]:h["bend"]].decode() == h["match"]


def test_long_words_and_lanes():
    rnd = random.Random(5)
    base = "".join(rnd.choice("ab") for _ in range(400))
    words = [base, base[:200], base[:63], base[:64], base[:65], base[100:130], "ab", "b" * 70]
    text = "x".join(base[:rnd.randint(20, 400)].upper() for _ in range(60)) + "b" * 500
    index = S.WordIndex([(w, 1, i) for i, w in enumerate(words)])
    got = S._batch_hits(index, [text, text]).to_pylist()
    assert sorted((h["start"], h["end"], h["ord"]) for h in got[1]) == plain(text, words)
    assert got[0] == got[1] and index.nbytes() < 1 << 20


LISTS = {"company": ["Elle"], "competitor": ["über", "the"], "project": ["the", "x.y", "aa"], "custom": ["tion", "ELLE", "on the"]}
TEXTS = ["Belle and THE station on the Über x.y", None, "", "aaaa elle", "ÜBERTHE\U0001f600 thethe", "no", "mail the.elle@tion.com now"]


@pytest.mark.parametrize("strategy", ["generic", "custom", "competitor", "none"])
def test_same_as_rules(spark, strategy, monkeypatch):
    words = W.normalize_words(W.word_table(spark, **LISTS))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    own = [Rule(id="m", type="builtin", pattern="email", replacement="[EMAIL]"), Rule(id="l", type="literal", pattern="sta", replacement="!", case_sensitive=False)]
    want = sanitize(df, "text", W.with_custom_words(own, words, strategy), Options(include_context=True)).orderBy("id").collect()
    got = sanitize(df, "text", own, Options(include_context=True), words=words, strategy=strategy).orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0].detections_count >= 4
    monkeypatch.setattr(S, "PART_BYTES", 400)
    assert S.word_parts(words) > 2
    for key in ("id", None):
        again = sanitize(df, "text", own, Options(include_context=True), words=words, strategy=strategy, key=key).orderBy("id").collect()
        assert [tuple(r) for r in again] == [tuple(r) for r in want]


def test_empty_and_odd_lists(spark):
    df = spark.createDataFrame([(1, "the"), (2, None)], "id long, text string")
    empty = W.word_table(spark)
    assert [r.h for r in S.word_hits(df, "text", empty, out="h").collect()] == [[], []]
    odd = spark.createDataFrame([(None, "custom", 0), ("", "custom", 1), ("the", "other", 2), ("the", "custom", None), ("he", "custom", 3)],
                                "word string, word_category string, ordinal int")
    assert [[x.word for x in r.h] for r in S.word_hits(df, "text", odd, out="h").orderBy("id").collect()] == [["he"], []]
    assert S.word_hits(df.limit(0), "text", odd).collect() == []


def test_a_million_words(spark):
    """Far beyond MAX_RULES; the tokens that are words are known by a join."""
    n = 1_000_000
    words = spark.range(n).selectExpr("concat('w', lower(hex(id * 7919 + 13)), 'q') AS word", "'project' AS word_category", "CAST(id AS INT) AS ordinal")
    text = spark.range(2000).selectExpr("id", "concat_ws(' ', transform(sequence(0, 30), k -> concat('W', hex((id * 31 + k) * 7919 * (1 + k % 2) + 13), 'Q')), '-') AS text")
    hits = S.word_hits(text, "text", words, key="id").selectExpr("id", "explode(`__w`) AS h").selectExpr("id", "h.ord AS ord")
    want = text.selectExpr("id", "explode(split(lower(text), ' ')) AS word").join(words, "word").select("id", "ordinal")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    d = detect(text, "text", [], Options(generate_replacements=False), words=words, key="id")
    assert d.selectExpr("sum(size(detections)) AS n").first().n == want.count()


def test_short_texts_are_walked_together():
    """Small batches meet up to a size, in order; a large one stays alone; empty ones vanish."""
    import pyarrow as pa
    one = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], ["t", "n"])
    small, large = [one([f"a{i}", None]) for i in range(5)], one(["x" * S.WALK_BYTES])
    got = list(S._gathered([*small, large, one([]), small[0]]))
    assert [t.num_rows for t in got] == [11, 2]
    assert got[0].column(0).to_pylist()[:4] == ["a0", None, "a1", None] and list(S._gathered([one([])])) == []


def test_a_list_that_grows_with_the_parts_is_one_index(spark):
    """7,200,000 part numbers, as at 6 GB, are walked in one pass (13 lists of automata before)."""
    words = spark.range(7_200_000).selectExpr("concat('sku', id) AS word", "'custom' AS word_category", "CAST(id AS INT) AS ordinal")
    assert S.word_parts(words) == 1
    index = S.WordIndex([(f"sku{i}", 3, i) for i in range(700_000, 800_000)])
    assert index.nbytes() < 100_000 * 30 + S.OWN_BYTES


ODD_WORDS = [("aa", "custom", 0), ("AA", "custom", 1), ("aaa", "project", 0), ("É", "custom", 2), ("éa", "custom", 2), ("K", "project", 3), ("k", "project", 3),
             ("a b", "competitor", 5), ("b" * 70, "custom", 6), ("b" * 33, "custom", 7), ("\U0001f600x", "custom", 8), ("aab", "custom", 0), ("\0", "custom", 9)]
ODD_TEXTS = ["aaaaa AAab éaÉA kKK", None, "", "a", " b", "B" * 140 + "a b", "x\U0001f600X\U0001f600x", "a\0a\0\0", "aab" * 30, "nothing here"]


def test_a_list_too_large_for_an_index_walks_texts_once(spark):
    """The hits of plain scans, also by the join, with one pass over the texts and one over the words."""
    words = spark.createDataFrame(ODD_WORDS, "word string, word_category string, ordinal int")
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id long, text string")
    want = S.word_hits(df, "text", words, out="h").orderBy("id").collect()
    standing = [w for w, _, _ in ODD_WORDS if w != "AA"]  # which folds like "aa"
    for text, r in zip(ODD_TEXTS, want):
        assert sorted((h.start, h.end, h.word) for h in r.h) == sorted((a, b, standing[i]) for a, b, i in plain(text or "", standing))
    joined = S.word_hits(df, "text", words, key="id", out="h", part_bytes=1000)
    assert S.word_parts(words, 1000) > 100
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert joined.orderBy("id").collect() == want
    assert S.word_hits(df, "text", words, out="h", part_bytes=1000).orderBy("id").collect() == want


def test_full_bitmaps_and_small_blocks_change_no_hit(spark, monkeypatch):
    """Bitmaps that let everything through cost time only; windows across blocks are found."""
    words = spark.createDataFrame(ODD_WORDS, "word string, word_category string, ordinal int")
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id long, text string")
    rows = [(w, W.LISTS.index(c), o) for w, c, o in ODD_WORDS]
    want = S._batch_hits(S.WordIndex(rows), ODD_TEXTS)
    for block in (1, 3, 64):
        monkeypatch.setattr(S, "BLOCK", block)
        assert S._batch_hits(S.WordIndex(rows), ODD_TEXTS).equals(want)
    monkeypatch.undo()
    monkeypatch.setattr(S, "MOST_BITS", 1 << 2)
    assert S._batch_hits(S.WordIndex(rows), ODD_TEXTS).equals(want)
    got = S.word_hits(df, "text", words, key="id", out="h", part_bytes=1000).orderBy("id").collect()
    assert [[h.asDict() for h in r.h] for r in got] == want.to_pylist()


def test_keys_that_collide_keep_their_words(monkeypatch):
    """Hashes only lead to words: with one key for all, hits and first places stay."""
    rows = [("AB", 1, 5), ("cd", 1, 0), ("ab", 1, 2), ("ef", 0, 1), ("CD", 1, 3), ("Ab", 2, 0)]
    want = S._batch_hits(S.WordIndex(rows), ["abcdef EFab"]).to_pylist()
    assert [(h["word"], h["cat"], h["ord"]) for h in want[0]] == [("ab", 1, 2), ("cd", 1, 0), ("ef", 0, 1), ("ef", 0, 1), ("ab", 1, 2)]
    monkeypatch.setattr(S, "_key", lambda window, size: np.zeros(len(window), np.uint64))
    assert S._batch_hits(S.WordIndex(rows), ["abcdef EFab"]).to_pylist() == want


def test_words_listed_many_times_stand_once():
    """Of words that fold alike the first by category, place and word stands."""
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("aAbBéÉ") for _ in range(rnd.randint(1, 3))), rnd.randint(0, 1), rnd.randint(0, 2)) for _ in range(400)] + [("", 0, 0)]
    first = {}
    for w, c, o in sorted(rows[:-1], key=lambda r: (r[1], r[2], r[0])):
        first.setdefault((w.isascii(), S.fold(S.code_points(w), w.isascii()).tobytes()), (w, c, o))
    index = S.WordIndex(rows)
    got = S._batch_hits(index, [" ".join(sorted({w for w, _, _ in rows}))]).to_pylist()[0]
    assert {(h["word"], h["cat"], h["ord"]) for h in got} == set(first.values())
    assert len(index.spelled(np.arange(index.base[-1]))) == len(first)
