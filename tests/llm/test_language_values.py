"""Declared values of many kinds, the bound on the model, and pages against what they hold."""

import random

import pytest

from scrubline.llm import language_id
from scrubline.llm import queries as L

SF = "/root/testdata/sf0.01"
SAID = {"en": "the house and the garden with that", "de": "das haus und der garten mit dem", "fr": "la maison et le jardin avec les"}


def docs(spark, values, each=12):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(SAID[lang].split()) for _ in range(30)), tag, f"s{i % 3}") for i, (lang, tag) in enumerate([v for v in values for _ in range(each)])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows


def test_tags_are_folded_to_their_language(spark):
    values = [("en", t) for t in ("en", "en-US", "EN_gb", " En ")] + [("de", "de-AT"), ("de", "DE"), ("fr", "fr"), ("fr", "french"), ("en", "x"), ("de", "")]
    d, rows = docs(spark, values)
    got = {r.doc_id: r.lang_id for r in language_id.identify_language(d).collect()}
    assert set(got.values()) == {"en", "de", "fr"}
    assert all(got[i] == next(k for k, v in SAID.items() if set(t.split()) <= set(v.split())) for i, t, _, _ in rows)


def test_thousands_of_junk_values(spark):
    values = [(lang, f"junk{i}") for i in range(5000) for lang in [("en", "de", "fr")[i % 3]]] + [(k, k) for k in SAID]
    d, rows = docs(spark, values, 10)
    assert language_id.languages(d, "text", "lang") == ["de", "en", "fr"]
    n = {r.lang_id: r["count"] for r in language_id.identify_language(d).groupBy("lang_id").count().collect()}
    assert n == {"en": 16_680, "de": 16_680, "fr": 16_670}


def test_many_classes_shrink_the_model(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL_CELLS", 1 << 14)
    codes = [a + b for a in "qwz" for b in "abcdefgh"]
    d, rows = docs(spark, [(k, k) for k in SAID] * 3 + [(("en", "de", "fr")[i % 3], c) for i, c in enumerate(codes)], 10)
    langs = language_id.languages(d, "text", "lang")
    assert len(langs) == 27 and language_id.fit_text_model(d, "text", "lang", langs).shape == (512, 28)
    assert language_id.identify_language(d).where("lang_posterior > 1.0001 OR lang_posterior IS NULL").count() == 0


def test_page_evidence(spark):
    rows = [(1, "HTTPS://user@De.Example.ORG:80/fr/x?y", '<HTML class=a LANG="de-AT"><body><p>Gr&uuml;&szlig;e</p><script>var eacute</script></body>'),
            (2, "//x.example.com/english/", "<html lang=en><body>caf&eacute; <b>ol</b>d</body></html>"), (3, None, None), (4, "not an address", "<p>lang=fr")]
    got = {r.page_id: tuple(r)[1:] for r in L.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("Grüße", "de-AT", "de.example.org", "org/fr"), 2: ("café old", "en", "x.example.com", "com/"), 3: ("", None, None, None), 4: ("lang=fr", None, None, None)}


def test_pages_against_their_declared_language(spark):
    got = {r.page_id: r for r in L.llm_language_id_pages(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    said = {r.page_id: r.declared for r in L.page_evidence(pages).collect()}
    assert got.keys() == said.keys() and len(got) == 250
    known = [i for i, v in said.items() if v]
    assert sum(got[i].lang_id == said[i] for i in known) >= 0.97 * len(known)
    assert all(0 <= r.lang_posterior <= 1 for r in got.values())
    # without the declared language the other evidence finds it too
    blind = L.page_evidence(pages).drop("declared")
    joined = blind.join(spark.createDataFrame(list(said.items()), "page_id long, lang string"), "page_id")
    r = {x.page_id: x.lang_id for x in language_id.identify_language(joined, "text", "lang", "host", "suffix", keep=["page_id"]).collect()}
    assert sum(r[i] == said[i] for i in known) >= 0.95 * len(known)


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_empty_pages(spark, rows):
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    r = language_id.identify_language(L.page_evidence(d), "text", "declared", "host", "suffix", keep=["page_id"]).collect()
    assert [x.lang_id for x in r] == ["und"] * len(rows)
