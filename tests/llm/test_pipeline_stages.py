"""Each stage of the pipeline on its own input, against an independent answer."""

import collections

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from scrubline.llm import mixing, piece_wfst, quality
from scrubline.llm import queries as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_keeps_clean_documents(spark, docs):
    """Documents with letters stay, whatever they declare; texts without go."""
    extra = [(-1, None, "en", "a", 0), (-2, "", "en", "a", 0), (-3, "12 34 !?", "de", "a", 0), (-4, "☃ ☃", None, None, 0)]
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = P.identify_language(spark, d.unionByName(spark.createDataFrame(extra, d.schema)), SF)
    assert got.columns == d.columns
    ids = collections.Counter(r.doc_id for r in got.select("doc_id").collect())
    letters = {r.doc_id for r in d.where(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 20).select("doc_id").collect()}
    assert not ids.keys() & {-1, -2, -3, -4} and max(ids.values()) == 1
    assert len(letters - ids.keys()) <= 0.002 * len(letters)


def test_mixing_repeats_as_the_sql_says(spark, docs):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = collections.Counter(r[0] for r in duckdb.sql(f"SELECT doc_id FROM ({mixing.ORACLE_SQL})").fetchall())
    rows = P.mix_to_weights(spark, docs, SF)
    assert rows.columns == docs.columns
    got = rows.select("doc_id", F.xxhash64("text").alias("t")).collect()
    assert collections.Counter(r.doc_id for r in got) == want and len(got) > 900
    text = {r.doc_id: r.t for r in docs.select("doc_id", F.xxhash64("text").alias("t")).collect()}
    assert all(text[r.doc_id] == r.t for r in got)


def test_exact_stage_keeps_one_of_each(spark, docs):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for r in docs.select("doc_id", "text").collect():
        last[fold(r.text)] = max(last.get(fold(r.text), -1), r.doc_id)
    got = sorted(r.doc_id for r in P.drop_exact_copies(spark, docs, SF).select("doc_id").collect())
    assert got == sorted(last.values())


def test_near_stage_keeps_one_of_each_group(spark, docs):
    """Links by full five-word shingle sets at 0.8, found through shared shingles."""
    import re
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {hash(tuple(w[i:i + 5])) for i in range(len(w) - min(5, len(w)) + 1)} if w else set()
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for h in s:
            holders[h].append(i)
    shared = collections.Counter((a, b) for v in holders.values() for k, a in enumerate(v) for b in v[k + 1:])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = sorted(r.doc_id for r in P.drop_near_copies(spark, docs, SF).select("doc_id").collect())
    assert got == sorted({root(i) for i in sets})


def test_whole_run(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_wfst.DEFAULT_MODEL)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = P.run(spark, SF).collect()
    assert len(rows) > 500 and all(r.ids == sp.encode(text[r.doc_id]) and r.round_trip for r in rows)
    folded = collections.defaultdict(set)
    for r in rows:
        folded[text[r.doc_id].lower()].add(r.doc_id)
    assert all(len(v) == 1 for v in folded.values())


def test_quality_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 50)
    d = spark.createDataFrame([(1 if i < 3000 else i, f"text number {i} of some words" if i % 2 else "x x x x") for i in range(3200)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in [1, *range(3000, 3200)]], "doc_id long, quality int")
    assert quality.score_quality(d, lab).where("score >= 0 AND score <= 1").count() == 3200
    assert L.op7_quality is not None
