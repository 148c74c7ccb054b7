"""Rows of small groups are dealt out by key once; bitmaps that tell little change no result and no bound."""

import random
import string

from scrubline.functions import stored
from scrubline.llm import suffix_repeats
from test_brute_force import brute_repeats


def texts():
    rnd = random.Random(5)
    junk = lambda n: "".join(rnd.choice(string.ascii_lowercase + " ") for _ in range(n))
    heads, passage, rare = [junk(260) for _ in range(6)], junk(600), [junk(450) for _ in range(8)]
    once = junk(900)  # one context in very many rows
    return ([junk(20) + heads[i % 6] + passage + junk(40) for i in range(80)] + [junk(90) + rare[i % 8] + junk(70) for i in range(24)]
            + [junk(30) + once + junk(30) for _ in range(60)])


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    most, plain = [], suffix_repeats.map_runs

    def counted(df, keys, *args, **tasks):
        most.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0])
        return plain(df, keys, *args, **tasks)

    monkeypatch.setattr(stored, "BITMAP_BITS", 8)
    monkeypatch.setattr(suffix_repeats, "BLOCK", 32)
    monkeypatch.setattr(suffix_repeats, "map_runs", counted)
    some = texts()
    d = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(some)], "doc_id long, text string")
    got = {3 if r.id is None else r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.remove_repeats(d).collect()}
    assert got == dict(enumerate(brute_repeats(some, 400)))
    assert max(m or 0 for m in most) <= 32


def test_rows_of_small_groups_are_not_joined_by_key(spark, monkeypatch):
    plans, plain = [], suffix_repeats.map_runs

    def seen(df, *args, **tasks):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
        return plain(df, *args, **tasks)

    monkeypatch.setattr(suffix_repeats, "map_runs", seen)
    suffix_repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"))
    for plan in plans:
        joins = [line for line in plan if "Join " in line and "strategy=broadcast" not in line]
        assert plan[0].startswith("Union") and len(joins) == 1  # the one of rows that may be of a large group


def test_surely_out_is_what_maybe_in_leaves_out(spark):
    d = spark.range(1000).selectExpr("if(id = 7, null, id) AS k", "id AS v")
    for some in (d.where("v < 20"), d.where("false")):
        bits = stored.bitmap(some, ["k"])
        inside, out = ({r.v for r in f(d, bits, ["k"]).collect()} for f in (stored.maybe_in, stored.surely_out))
        assert inside | out == set(range(1000)) and not inside & out and {r.v for r in some.collect()} <= inside and len(out) > 900
