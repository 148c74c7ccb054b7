"""What a row is asked before the regexes of a rule set, and that it loses no match."""

import random

from scrubline.functions.sqlx import q
from scrubline.operators import detect as D
from scrubline.operators.patterns import BUILTINS, DIGITS, LONG_RUN
from scrubline.operators.rules import Rule, default_rules
from scrubline.plans.inputs import PLANTED, planted_text_sql


def test_a_test_that_guards_share_is_made_once():
    """All guards of the default rules: fewer walks over a text than literals."""
    guards = D._guards(D.compile_rules(default_rules()))
    hints = D._hints(guards)
    held = {h: f"`h{i}`" for i, h in enumerate(dict.fromkeys(hints.values()))}
    first = [D._hint_sql(h, "`t`", "`l`") for h in held]
    then = [D._guard_sql(g, "`t`", "`l`", hints, held) for g in guards.values()]
    assert len(set(first)) == len(first) and sum(s.count(f"RLIKE {q(LONG_RUN)}") for s in first + then) == 1
    free = [s for s in then if "`h" not in s]  # tests that no hint stands before
    assert sum(s.count("contains(") for s in first + free) < 40 < len({g for b in BUILTINS.values() for g in b.guard})
    assert not any("contains" in s for g, s in zip(guards.values(), then) if g[0] in (("key",), ("token",)) and not g[2])


def test_guards_hold_where_patterns_do(spark):
    """Every planted value, in its plain and in odd surroundings, passes the guard and the shape of its pattern."""
    docs = spark.range(40).withColumnRenamed("id", "doc_id")
    for name in PLANTED:
        b = BUILTINS[name]
        t = f"concat(element_at(array('', 'é', 'a.b ', '(', '\\n'), CAST(doc_id % 5 AS INT) + 1), {planted_text_sql(name)})"
        guard = D._guard_sql((b.guard, b.guard_lower, b.shape), "t", "lower(t)", {}, {}) if b.guard or b.shape else "true"
        row = docs.selectExpr(f"{t} AS t").selectExpr(f"count_if(t RLIKE {q(b.java)}) AS n", f"count_if(t RLIKE {q(b.java)} AND NOT {guard}) AS lost").first()
        assert row.n > 0 and row.lost == 0, name


def test_shapes(spark):
    """A run of 20 is found wherever it stands, 19 is none; long texts need no deep stack."""
    run = "aZ9/+_-" * 3
    texts = [run[:20], run[:19], f"é {run[:20]}", f"{run[:19]} {run[:19]}é", f"{'ab, ' * 300000}{run[:20]}", "ab, " * 300000, "", "x" * 400000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.f for r in df.selectExpr("i", f"t RLIKE {q(LONG_RUN)} AS f").collect()}
    assert [got[i] for i in range(8)] == [True, False, True, False, True, False, False, True]
    ips = spark.createDataFrame([("1.2.3.4",), ("10.0.0.1",), ("v1.2",), ("1 2. 3",)], "t string")
    assert [r.f for r in ips.selectExpr(f"t RLIKE {q(DIGITS)} AS f").collect()] == [True, True, True, False]


def test_prefixed_templates_run_for_prefixed_keys(spark):
    """Five of the fifteen templates are enough where no key has a prefix; the candidates stay the same."""
    rnd = random.Random(5)
    parts = ["token", "TOKEN", "my", "_", "API ", "https:", "ftp:", ":", " = ", "=", ": ", '"', "abcd", "value9", ",", "}", " ", "\n", '"token": "vvvv"', "é"]
    texts = ["token: abcd1", "mytoken=abcd1"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(2, 12))) for _ in range(1500)]
    comp = D.compile_rules([Rule(id="kv_token", type="kv", pattern="token", category="secrets")])
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    key, prefix = (("token",), True), "(?i)[a-zA-Z_]token"
    assert set(D._guards(comp)) == {key, prefix}
    gated, plain = {key: "true", prefix: f"t RLIKE {q(prefix)}"}, {key: "true"}
    rows = df.selectExpr("t", *[f"{D._all_candidates(comp, 't', g)} AS c{i}" for i, g in enumerate((gated, plain))],
                         *[f"size({D._spec_entries(comp, 't', g)}) AS n{i}" for i, g in enumerate((gated, plain))]).collect()
    where = lambda cs: [(c.start, c.end, c.bstart, c.bend, c.match, c.vstart, c.vend) for c in cs]
    assert all(where(r.c0) == where(r.c1) for r in rows) and sum(bool(r.c1) for r in rows) > 300
    n = {r.t: (r.n0, r.n1) for r in rows}
    assert n["token: abcd1"] == (1, 3) and n["mytoken=abcd1"][0] == n["mytoken=abcd1"][1]
