"""A language with a small share of many rows is a language."""

import random

from scrubline.llm import language_id


def test_a_language_below_half_a_percent_is_a_class(spark):
    rnd = random.Random(5)
    say = lambda words, n: " ".join(rnd.choice(words.split()) for _ in range(n))
    en, fi = "the of and to in is that for it as was with be by on not", "ja on ei se että hän oli mutta kun niin kuin myös joka tämä ovat"
    rows = [(i, say(en, 25), "en", "a.example.org", "org") for i in range(6000)]
    rows += [(10_000 + i, say(fi, 25), "fi", "b.example.fi", "fi") for i in range(20)]  # 0.33 % of the rows
    rows += [(20_000 + i, say(fi, 25), None, None, None) for i in range(5)] + [(30_000 + i, say(fi, 25), "et", "c.example.ee", "ee") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, suffix string").repartition(4)
    r = {x.doc_id: x for x in language_id.identify_language(d, suffix_col="suffix").collect()}
    assert len(r) == len(rows) and all(r[i].lang_id == "en" for i in range(6000))
    assert all(r[k].lang_id == "fi" and r[k].lang_kept for k in r if k >= 10_000)


def test_rare_evidence_is_kept(spark):
    """Two rare suffixes of different languages are not one value."""
    rnd = random.Random(6)
    say = lambda words: " ".join(rnd.choice(words.split()) for _ in range(12))
    en, de = "the of and to in is that for it as was with", "der die und das in ist nicht zu den von mit sich"
    rows = [(i, say(w), lang, "org") for i in range(10, 3000) for lang, w in (("en", en), ("de", de))]
    rows += [(i, say(w), lang, suffix) for i in range(3000, 3012) for lang, w, suffix in (("en", en, "nz"), ("de", de, "at"))]
    rows += [(1, "in", None, "nz"), (2, "in", None, "at")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, suffix string")
    r = {x.doc_id: x for x in language_id.identify_language(d, host_col=None, suffix_col="suffix").where("doc_id < 10").collect()}
    top = language_id.MIN_POSTERIOR
    assert r[1].lang_posterior > top and r[2].lang_posterior > top and (r[1].lang_id, r[2].lang_id) == ("en", "de"), r
