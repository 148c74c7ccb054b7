"""Nulls, empty and long texts, ties, repeated rows, empty tables and
clashing column names, for every operator and every pipeline stage."""

import numpy as np
import pytest

import corpus_pipeline
from scrubline.llm import (chat_format, embed_caps, exact_dedup, language_id, minhash_odd, mixing, page_diff, piece_wfst,
                           quality, suffix_repeats)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over a lazy dog " * 3000


def rows():
    words = [f"word{i} and" for i in range(60)]
    base = " ".join(words)
    out = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base.upper(), "en", "b", 1), (3, None, None, None, None),
           (4, "", "en", "a", 0), (None, base, "en", "a", 1), (None, None, None, None, None), (5, "   \n\t ", "de", "b", 6),
           (6, LONG, "en", "a", 1), (7, base + " tail", "en", "c", 1), (8, "123 456", "en", "a", 7), (9, "ein und der die das nicht", "de", "c", 2)]
    return out + [(20 + i, f"these are the words of text number {i} and that is all there is of it", "en", "a", 3) for i in range(12)] \
        + [(40 + i, f"dies sind die Worte von Text Nummer {i} und das ist alles was es gibt", "de", "b", 3) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, empty):
    r = exact_dedup.exact_dedup(docs).collect()
    assert len(r) == len(rows())
    group = [x for x in r if x.text and x.text.lower() == rows()[0][1].lower()]
    assert {x.keep_id for x in group} == {2} and {x.group_size for x in group} == {4}
    assert [x.doc_id for x in group if x.kept] == [2]
    nothing = [x for x in r if not x.text]  # null and empty are equal; the largest id stays
    assert {x.keep_id for x in nothing} == {4} and sum(x.kept for x in nothing) == 1
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_repeated_row_and_clash(spark):
    d = spark.createDataFrame([(1, "x", "old"), (1, "X", "old"), (None, "y", "old"), (None, "y", "old")], "doc_id long, text string, kept string")
    r = exact_dedup.exact_dedup(d).collect()
    assert sorted((x.doc_id or 0, x.kept) for x in r) == [(0, False), (0, True), (1, False), (1, True)]
    assert {x.keep_id for x in r if x.text == "y"} == {None}


def test_mixing(docs, empty):
    r = mixing.mix_sources(docs, weights={"a": 1.0, "b": 1.0, "c": 0.0}).collect()
    assert not [x for x in r if x.source in ("c", None)]
    keys = [x.shuffle_key for x in r]
    assert keys == sorted(keys)
    again = mixing.mix_sources(docs.repartition(7), weights={"a": 1.0, "b": 1.0, "c": 0.0}).collect()
    assert sorted(map(str, r)) == sorted(map(str, again))  # the same counts under another partitioning
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(docs.withColumnRenamed("n_chars", "copy_no")).columns.count("copy_no") == 1


def test_mixing_means(spark):
    from pyspark.sql import functions as F
    n = spark.range(20000).select(mixing.poisson_count(F.lit(2.5), F.col("id").cast("string")).alias("k"),
                                  mixing.poisson_count(F.lit(30.0), F.col("id").cast("string")).alias("m"))
    a = n.agg(F.avg("k"), F.variance("k"), F.avg("m"), F.variance("m")).first()
    assert abs(a[0] - 2.5) < 0.05 and abs(a[1] - 2.5) < 0.12 and abs(a[2] - 30) < 0.2 and abs(a[3] - 30) < 1.2


def test_language(docs, empty):
    r = {x.doc_id: x for x in language_id.identify_language(docs).collect() if x.doc_id}
    assert r[25].lang_id == "en" and r[45].lang_id == "de" and r[6].lang_id == "en"
    for k in (3, 4, 5, 8):
        assert r[k].lang_id == "und" and not r[k].lang_kept
    assert language_id.identify_language(docs).count() == len(rows())
    assert language_id.identify_language(empty).count() == 0


def test_language_evidence_fuses(spark):
    text = "these are the words and that is all"
    d = spark.createDataFrame([(i, f"{text} {i} of it", "en", "x.example.org") for i in range(30)]
                              + [(100 + i, f"dies sind die Worte und das ist alles {i}", "de", "y.example.org") for i in range(30)]
                              + [(200, "so la", "de", "y.example.org"), (201, "so la", "en", "x.example.org")],
                              "doc_id long, text string, lang string, source string")
    r = {x.doc_id: x for x in language_id.identify_language(d).collect()}
    assert r[200].lang_id == "de" and r[201].lang_id == "en"  # the same text, other evidence


def test_repeats_and_minhash(docs, empty):
    r = suffix_repeats.remove_repeats(docs).collect()
    assert len(r) == len(rows())
    by = {}
    for x in r:
        by.setdefault(x.id, []).append(x)
    assert by[3][0].n_bytes == 0 and by[4][0].n_removed == 0 and by[6][0].n_removed > 100_000
    assert {x.n_removed for x in by[1]} == {by[1][0].n_bytes}
    m = minhash_odd.near_duplicates(docs).collect()
    assert len(m) == len(rows())
    comp = {x.id: x.component_id for x in m}
    assert comp[2] == 1 and comp[7] == 1 and comp[3] == 3 and comp[5] == 5 and comp[None] is None
    for f in (suffix_repeats.remove_repeats, minhash_odd.near_duplicates):
        assert f(empty).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    v = [float(i % 7 + 1) for i in range(16)]
    data = [(1, v, 0), (2, v, 0), (3, [2 * x for x in v], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 16, 0), (8, [nan] * 16, 0),
            (9, [inf] + v[1:], 0), (10, [None] + v[1:], 0), (11, [], 0), (12, [-x for x in v], 0), (None, v, 0), (13, v[:8], 0), (2, v, 0)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    r = {}
    for x in embed_caps.near_duplicates(d).collect():
        r.setdefault(x.id, []).append((x.n_links, x.component_id))
    assert r[1] == [(3, 1)] and r[2] == [(3, 1)] * 2 and r[3] == [(3, 1)]
    for k in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
        assert r[k] == [(0, k)]
    assert r[None] == [(0, None)]
    assert embed_caps.near_duplicates(d.limit(0)).count() == 0


def test_pages(spark):
    page = ('<html><body><nav>Menu</nav><header>Top</header><div id="cookie-notice">We use cookies</div><main><h1>T &amp; U</h1><p>One <b>two</b>'
            '<br>three\n four<p>Five &lt;x&gt;<div class="comments"><p>Nice!</p></div></main><form><input value=1>Send</form>'
            '<aside>Side</aside><script>var a="<p>no</p>"</script><footer>End</footer></body></html>')
    soup = '<html><body><div>Shared top</div><p>Own text {}</p><div>Shared end</div></body></html>'
    data = [(1, "http://a.example.org/x/1", page), (2, None, page), (3, "http://a.example.org/x/2", None), (4, "", ""), (5, "nonsense", "plain &eacute; text"),
            (6, "http://b.example.org/p/1", soup.format(1)), (7, "http://b.example.org/p/2", soup.format(2)), (8, "http://b.example.org/p/10", soup.format(3)),
            (9, "http://c.example.org/", "<p>cut off <b"), (1, "http://a.example.org/x/1", page), (None, None, "<article>a" + "<p>b" * 20000)]
    d = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    r = page_diff.extract_pages(d).collect()
    assert len(r) == len(data) and all(x.n_chars == len(x.text) for x in r)
    by = {x.page_id: x.text for x in r}
    assert by[1] == by[2] == "T & U One two three four Five <x>"
    assert by[3] == by[4] == "" and by[5] == "plain é text" and by[9] == "cut off"
    assert (by[6], by[7], by[8]) == ("Own text 1", "Own text 2", "Own text 3")
    assert len(by[None]) == 1 + 2 * 20000
    assert page_diff.extract_pages(d.limit(0)).count() == 0


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(20, 1), (21, 1), (None, 1), (999, 0), (40, None)], "doc_id long, quality int")
    r = quality.score_quality(docs, labels).collect()
    assert len(r) == len(rows()) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in r)
    assert quality.score_quality(empty, labels).count() == 0
    assert {x.score for x in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_chats(spark):
    d = spark.createDataFrame([
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (3, 2, "user", "more"),
        (4, 0, "user", None), (5, 0, "user", ""), (6, 0, None, "x"), (None, 0, "user", "lost"), (None, None, "user", "no turn"), (7, 0, "user", "other")],
        "conv_id long, turn long, role string, text string")
    r = {x.conv_id: x for x in chat_format.format_chats(d.withColumn("n_turns", d.turn)).collect()}
    assert set(r) == {2, 4, 5, 6, 7, None}
    assert r[2].n_turns == 3 and r[2].n_copies == 2 and r[2].rendered.endswith("<|im_start|>user\nmore<|im_end|>\n")
    assert r[None].n_turns == 2 and r[6].rendered == "<|im_start|>\nx<|im_end|>\n"
    assert chat_format.format_chats(d.limit(0)).count() == 0


def test_pieces(docs, empty):
    r = piece_wfst.encode(docs).collect()
    assert len(r) == len(rows()) and all(x.round_trip and x.n_tokens == len(x.ids) for x in r)
    assert all(x.ids == [] for x in r if not x.text)
    back = piece_wfst.decode(piece_wfst.encode(docs)).collect()
    assert all(x.decoded == (x.text or "") for x in back)
    assert piece_wfst.encode(empty).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, empty, name, stage):
    for d in (docs, docs.withColumnRenamed("n_chars", "kept"), empty):
        out = stage(spark, d, "")
        n = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns
        assert n <= 3 * len(rows()) and (n > 0) == (d is not empty)


def test_parity_bound():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    x, y = (minhash_odd.parity(minhash_odd._mix(v)) for v in (a, b))
    assert 80 <= np.bitwise_count(x ^ y).sum() <= 100  # never above the symmetric difference
