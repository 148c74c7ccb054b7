"""Operators against brute force on small given tables."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from scrubline.llm import embed_caps, language_id, minhash_odd, piece_wfst, suffix_repeats
from scrubline.llm import queries as L

SF = "/root/testdata/sf0.001"


def brute_repeats(texts, n):
    seen = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[i:i + n] for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = True
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_repeats_given(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want = dict(zip(d.doc_id, brute_repeats(d.text, 400)))
    got = {r[0]: tuple(r)[1:] for r in L.op1_suffix_repeats(spark, SF).collect()}
    assert got == want and any(0 < v[1] < v[0] for v in want.values())


@pytest.mark.parametrize("block", [4096, 3])
def test_suffix_repeats_made(spark, block, monkeypatch):
    """Overlaps, periodic texts, a passage in many documents; block 3 splits every group."""
    monkeypatch.setattr(suffix_repeats, "BLOCK", block)
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    p, r = noise(700), noise(430)
    texts = [noise(50) + p + noise(60), p[100:] + noise(30), noise(300) + r + noise(10) + r, "ab " * 500, noise(10) + p[:390], p[:401], "x" * 399, "x" * 400, "x" * 401]
    texts += [p + noise(5 + i) for i in range(3)] + [noise(3) + p] * 2
    texts += [noise(rnd.randint(0, 200)) + p[rnd.randint(0, 200):rnd.randint(500, 700)] + noise(20) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - min(width, len(w)) + 1)} if w else set()


@pytest.mark.parametrize("block", [2048, 4])
def test_minhash(spark, block, monkeypatch):
    monkeypatch.setattr(minhash_odd, "BLOCK", block)
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for _ in range(12):
            t = list(base)
            for _ in range(rnd.randint(0, len(t) // 16)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            docs.append(" ".join(t))
    docs += ["", None, "one", "One", "two words", "a b c"]
    s = [shingles(t, 3) for t in docs]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash_odd.near_duplicates(df, width=3, num=85, den=100).collect()}
    comp = components(range(len(docs)), links)
    assert got == {i: (len(s[i]), comp[i]) for i in comp} and len(set(comp.values())) < len(docs)


@pytest.mark.parametrize("block", [2048, 8])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embed_caps, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    for i in range(100, 300):  # around the threshold
        x[i] = x[i % 100] + rng.normal(size=24) * rng.uniform(0.1, 0.5)
    x[250] = x[3]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, x[i].tolist(), i % 2) for i in range(300)], "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embed_caps.near_duplicates(df).collect()}
    comp = components(range(300), np.argwhere(near).tolist())
    assert got == {i: (int(near[i].sum()), comp[i]) for i in range(300)}


def test_pieces_match_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_wfst.DEFAULT_MODEL)
    m = piece_wfst.Machine(piece_wfst._model_bytes(piece_wfst.DEFAULT_MODEL))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rnd = random.Random(3)
    texts += ["".join(rnd.choice("aAbe th\n\t▁  é😀中.!\"<>{}()=;0123_-'²ß") for _ in range(rnd.randint(0, 80))) for _ in range(800)]
    got = m.encode_many(texts)
    assert [x.tolist() for x in got] == sp.encode(texts)
    assert [m.decode(x) for x in got] == [sp.decode(x.tolist()) for x in got]
    for t in (" " * 3000, "a" * 3000, "😀" * 500, "ab " * 200_000):
        assert m.encode(t).tolist() == sp.encode(t)


def test_pieces_query(spark):
    assert all(r.round_trip for r in L.op10_piece_encoding(spark, SF).collect())


def test_language_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = language_id.identify_language(d, host_col=None).collect()
    assert sum(x.lang_id == x.lang for x in r) >= 0.97 * len(r)


def test_quality_held_out(spark):
    """Rows that the classifier never saw, on a table large enough to fit it."""
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(f"{sf}/labels.parquet"):
        pytest.skip("needs sf0.1")
    r = L.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert ((r.score >= 0.7) == (r.quality == 1)).mean() > 0.97


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it should do to its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    steps = {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / f"{i}"))
        out = spark.read.parquet(str(tmp_path / f"{i}"))
        steps[name] = (docs, out)
        docs = out
    before, after = steps["exact_dedup"]
    text = collections.defaultdict(list)
    for r in before.collect():
        text[r.text.translate({c: c + 32 for c in range(65, 91)})].append(r.doc_id)
    assert ids(after) == collections.Counter(max(v) for v in text.values())
    before, after = steps["near_dedup"]
    rows = before.collect()
    s = {r.doc_id: shingles(r.text, 5) for r in rows}
    links = [(a, b) for a in s for b in s if a < b and s[a] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    comp = components(s, links)
    assert ids(after) == collections.Counter(i for i in s if comp[i] == i)
    before, after = steps["source_mixing"]
    assert set(ids(after)) <= set(ids(before))
    before, after = steps["piece_encoding"]
    assert ids(before) == ids(after) and after.where("not round_trip").count() == 0
