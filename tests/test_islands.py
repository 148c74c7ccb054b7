"""Conflict walk and overlap counts: against plain walks, and on one row with a million candidates."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.operators import islands as I
from scrubline.operators.detect import _pair_counts, resolve
from scrubline.plans import queries as Q

SF = "/root/testdata/sf0.01"  # the smallest with conflicts
COLS = "id long, start int, end int, rank int, sub int, seq int, prio int, note string"


def walk(cands):
    """The conflict walk over (start, end, rank, sub, seq, prio, note)."""
    keep, cur = [], None
    for c in sorted(cands, key=lambda c: (c[0], c[2], c[3], c[4], c[1])):
        if cur is None or c[0] >= cur[1]:
            keep.append(cur)
            cur = c
        elif c[5] < cur[5]:
            cur = c
    return sorted(k for k in [*keep, cur] if k)


def made(rnd, n, room):
    out = []
    for i in range(n):
        s = rnd.randrange(room)
        out.append((s, s + rnd.choice([1, 2, 3, 5, 30]), rnd.randrange(6), rnd.randrange(2), i, rnd.choice([1000, 2000, 3001, 4000]), f"c{i}"))
    return out


@pytest.mark.parametrize("chunk", [4, 50, 1 << 16])
def test_rows_against_a_plain_walk(spark, chunk):
    rnd = random.Random(chunk)
    texts = {i: made(rnd, n, room) for i, (n, room) in enumerate([(300, 200), (300, 5000), (1, 3), (0, 1), (700, 800)])}
    df = spark.createDataFrame([(i, *c) for i, cs in texts.items() for c in cs], COLS)
    got = I.resolve_islands(df.repartition(5), ["id"], chunk).collect()
    for i, cs in texts.items():
        assert sorted(tuple(r)[1:] for r in got if r.id == i) == walk(cs)
    assert I.resolve_islands(df.limit(0), ["id"]).collect() == []


def test_islands_are_apart(spark):
    rnd = random.Random(3)
    cs = made(rnd, 400, 3000)
    df = spark.createDataFrame([(1, *c) for c in cs], COLS)
    rows = I.islands(df, ["id"], 16).collect()
    spans = {}
    for r in rows:
        a, b = spans.get(r.island, (r.start, r.end))
        spans[r.island] = (min(a, r.start), max(b, r.end))
    ordered = sorted(spans.values())
    assert len(ordered) > 20 and all(x[1] <= y[0] for x, y in zip(ordered, ordered[1:])) and all(k == v[0] for k, v in spans.items())


def test_array_walk_against_a_plain_walk(spark):
    rnd = random.Random(9)
    texts = [made(rnd, n, room) for n, room in [(0, 1), (1, 1), (2, 4), (300, 400), (600, 90), (1500, 4000)]]
    df = spark.createDataFrame([(i, [list(c) for c in sorted(cs, key=lambda c: (c[0], c[2], c[3], c[4], c[1]))]) for i, cs in enumerate(texts)],
                               "id int, c array<struct<start:int,end:int,rank:int,sub:int,seq:int,prio:int,note:string>>")
    for r in df.selectExpr("id", f"{resolve('`c`')} AS k").collect():
        assert sorted(map(tuple, r.k)) == walk(texts[r.id])


def test_a_million_candidates_in_one_row(spark):
    """Chained candidates: one island, half of them survive."""
    one = "transform(sequence(0, {n} - 1), i -> named_struct('start', CAST(i * 9 AS INT), 'end', CAST(i * 9 + 10 AS INT), 'prio', 1, 'rank', 0, 'sub', 0, 'seq', CAST(i AS INT)))"
    took = {}
    for n in (250_000, 1_000_000):
        row = spark.range(1).selectExpr("id", f"{one.format(n=n)} AS c")
        t = time.time()
        assert row.selectExpr(f"size({resolve('`c`')}) AS k").first().k == n // 2
        took[n] = time.time() - t
    assert took[1_000_000] < 10 * took[250_000] + 5
    rows = spark.range(1_000_000).selectExpr("0 AS id", "CAST(id * 9 AS INT) AS start", "CAST(id * 9 + 7 + id % 3 AS INT) AS end", "0 AS rank", "0 AS sub", "CAST(id AS INT) AS seq", "1 AS prio")
    assert I.resolve_islands(rows, ["id"]).count() == 1_000_000


def test_pair_counts():
    rnd = random.Random(1)
    rows = [sorted(made(rnd, n, 60)) for n in (0, 1, 40, 90)]
    want = Counter()
    for cs in rows:
        for i, a in enumerate(cs):
            want.update((a[2], b[2]) for b in cs[i + 1:] if b[0] < a[1])
    flat = [(k, *c) for k, cs in enumerate(rows) for c in cs]
    col = lambda k: np.array([c[k] for c in flat], np.int64)
    assert _pair_counts(col(1), col(2), col(3), col(0)) == dict(want)
    n = 1_000_000  # every candidate overlaps all later ones
    start = np.arange(n)
    assert _pair_counts(start, np.full(n, n), start % 2, np.zeros(n, np.int64))[0, 0] == (n // 2) * (n // 2 - 1) // 2


def test_queries_agree(spark):
    a = sorted(map(tuple, Q.resolve_islands(spark, SF).collect()))
    assert a == sorted(map(tuple, Q.resolve_conflicts(spark, SF).collect())) and a
    plain = Q.candidate_rows(Q._docs(spark, SF), "text", Q.CONFLICT_RULES, ["doc_id"])
    b = plain.alias("x").join(plain.alias("y"), (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("y.start") < F.col("x.end")) & (
        F.struct("x.start", "x.rank", "x.sub", "x.seq") < F.struct("y.start", "y.rank", "y.sub", "y.seq")))
    want = {(r[0], r[1]): r[2] for r in b.groupBy("x.rule_id", "y.rule_id").count().collect()}
    assert {(r.rule_a, r.rule_b): r.n for r in Q.overlap_pairs(spark, SF).collect()} == want and want
