"""Token alignment against a plain walk over the tokens of each text."""

import hashlib
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer

from scrubline.llm import queries as L
from scrubline.llm import token_align as T

SF = "/root/testdata/sf0.001"
HARD = [None, "", " ", "a", "<|endoftext|> <s></s> <unk> <0x41>", "x▁y", "café \U0001f600\U0001f600 \u0000\u0001", "  two  spaces\n\n\tand tabs \r\n",
        "a" * 5000, "0123456789" * 500, "中文 ไทย א", "word " * 3000, "same text", "same text"]


def tokens(text):
    tok = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{T.TOKENIZERS}/piece_bpe_32k.model")
    alphabet = T._byte_alphabet()

    def one(text):
        if not text:
            return None
        a, b = tok.encode(" " + text, add_special_tokens=False), sp.encode(text)
        pa = [bytes(alphabet[c] for c in t) for t in a.tokens]
        pb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = b" " + text.encode()
        if b"".join(pa) != want or b"".join(pb) != want:
            return None
        return list(zip(a.ids, pa)), list(zip(b, pb))

    return [one(t) for t in text]


def groups(a, b):
    """Groups by walking both token lists."""
    out, i, j, ea, eb = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if ea <= eb and i < len(a):
            ea += len(a[i][1])
            out[-1][0].append(a[i][0])
            i += 1
        else:
            eb += len(b[j][1])
            out[-1][1].append(b[j][0])
            j += 1
        if ea == eb:
            out.append(([], []))
    return out[:-1]


def brute(texts):
    each = [groups(*t) if t else [] for t in tokens(texts)]
    links = [Counter((x, y) for g in gs for x in g[0] for y in g[1]) for gs in each]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for gs, c in zip(each, links):
        s = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in gs)
        yield (sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(c.values()),
               sum(m for p, m in c.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in c.items()),
               hashlib.sha256(s.encode()).hexdigest() if gs else "")


def test_hard_texts(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(HARD)], "doc_id long, text string, n_a int")
    want = dict(enumerate(brute(HARD)))
    assert {r[0]: tuple(r)[1:] for r in T.link_counts(df).collect()} == want
    assert want[0] == (0, 0, 0, 0, 0, 0, "") and want[5][0] == 0 and want[4][0] > 0
    monkeypatch.setattr(T, "HOT_PAIRS", 16)  # nearly all pairs take the shuffled way
    assert {r[0]: tuple(r)[1:] for r in T.link_counts(df.repartition(3)).collect()} == want


def test_links_in_blocks(monkeypatch):
    with open(f"{T.TOKENIZERS}/byte_bpe_50k.json") as f, open(f"{T.TOKENIZERS}/piece_bpe_32k.model", "rb") as g:
        a, b = T._sides(f.read(), g.read())
    m = T.Batch(HARD, a, b)
    def flat():
        return [(x, y, n) for d, k, c in m.links(a.size, b.size) for x, y, n in zip(d.tolist(), k.tolist(), c.tolist())]
    whole = flat()
    monkeypatch.setattr(T, "BLOCK", 5)
    assert sorted(flat()) == sorted(whole) and len({r[:2] for r in whole}) == len(whole)


def test_overlaps(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.id: r for r in T.align_tokens(df).collect()}
    for i, t in enumerate(tokens(HARD)):
        if not t:
            assert (got[i].a, got[i].b, got[i].overlaps, got[i].group_ends) == ([], [], [], [])
            continue
        spans = []
        for side in t:
            at, s = 0, []
            for _, p in side:
                s.append((at, at + len(p)))
                at += len(p)
            spans.append(s)
        owner = [[k for k, (x, y) in enumerate(s) for _ in range(x, y)] for s in spans]
        assert {(o.a, o.b) for o in got[i].overlaps} == set(zip(*owner))
        assert len(got[i].overlaps) == len(set(zip(*owner)))
        assert got[i].group_ends == sorted({y for _, y in spans[0]} & {y for _, y in spans[1]})


def test_given_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want = dict(zip(d.doc_id, brute(d.text)))
    assert {r[0]: tuple(r)[1:] for r in L.op12_token_alignment(spark, SF).collect()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.link_counts(none).collect() == [] and T.align_tokens(none).collect() == []


def test_chunks_change_no_token():
    """White space of all kinds: chunks encoded alone give the ids of the whole text."""
    import random
    with open(f"{T.TOKENIZERS}/byte_bpe_50k.json") as f, open(f"{T.TOKENIZERS}/piece_bpe_32k.model", "rb") as g:
        sides = T._sides(f.read(), g.read())
    rnd = random.Random(12)
    marks = [" ", "  ", "   ", "\n", "\t", " ", " ", "\x1c", "\r\n", "a", "Word", "don't", "'s", "12", "!?", "é", "\U0001f600", "中", "<s>", "▁"]
    for _ in range(3000):
        t = "".join(rnd.choice(marks) for _ in range(rnd.randint(1, 14)))
        parts = T.chunks(t)
        assert "".join(parts) == " " + t
        for side in sides:
            whole, each = side.encode([t])[0], side.encode([p[1:] for p in parts])
            assert "▁" in t or [i for ids in each for i in ids] == whole, t
