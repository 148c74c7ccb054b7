"""What the step that finds candidates does for a row, and what it finds."""

import re

from scrubline.functions import rng as R
from scrubline.functions.sqlx import q
from scrubline.operators import detect as D
from scrubline.operators.patterns import BUILTINS
from scrubline.operators.rules import Rule

KV = Rule(id="kv_token", type="kv", pattern="token", category="secrets")


def test_guards_look_for_their_rarest_end_first(spark):
    """A guard holds just where its literal stands, the rare end alone is not enough."""
    assert D._contains("`t`", "secret") == "(contains(`t`, 'cret') AND contains(`t`, 'secret'))"
    assert D._contains("`t`", "key") == "contains(`t`, 'key')"
    lits = sorted({g for b in BUILTINS.values() for g in b.guard} | {"client_secret", "a", "ab"})
    texts = ["", "plain", "cret", *lits, *[g[1:] for g in lits], *[f"x{g}y" for g in lits]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", *[f"{D._contains('`t`', g)} AS c{i}" for i, g in enumerate(lits)]).collect()
    assert all(r[i + 1] == (g in r.t) for r in got for i, g in enumerate(lits))


def test_templates_stand_behind_their_sign():
    """A row without '=' runs none of the nine templates that need one."""
    comp = D.compile_rules([KV])
    sql = D._spec_entries(comp, "`t`", {(("token",), True): "`g`"})
    assert sql.count("contains(`t`, ':')") == 1 and sql.count("contains(`t`, '=')") == 1
    assert [s.sign for s in comp.specs].count("=") == 9 and all(s.sign in s.java and q(s.java) in sql for s in comp.specs)


def test_equal_templates_give_one_candidate(spark, monkeypatch):
    """Entries that found what an earlier template found are not built; one that found other text is."""
    comp = D.compile_rules([KV])
    df = spark.createDataFrame([("token: abcd1",), ("mytoken=abcd1 token=abcd2,cd",), ('"token": "abcd1" x',)], "t string")
    entries = D._spec_entries(comp, "t", {(("token",), True): "true"})
    rows = df.selectExpr("t", f"{entries} AS e").selectExpr("t", f"{D._distinct_kv('e')} AS d", "size(e) AS n").collect()
    for r in rows:
        seen = [(s.rank, tuple(s.m), tuple(s.g)) for s in r.d]
        assert len(seen) == len(set(seen)) and len(seen) < r.n
    found = lambda: [r.c for r in D.candidate_columns(df, "t", comp).selectExpr("t", "`__cands` AS c").collect()]
    got = found()
    assert [[c.match for c in r] for r in got] == [["token: abcd1"], ["mytoken=abcd1", "token=abcd1", "token=abcd2,cd", "token=abcd2"], ['"token": "abcd1"']]
    monkeypatch.setattr(D, "_distinct_kv", lambda specs: specs)
    assert found() == got


def test_a_step_draws_its_word_once():
    assert R.rng_values("CAST(7 AS BIGINT)", 3).count("shiftleft(") == 2


def test_runs_looked_for_ahead(spark):
    """The patterns without a guard find what their plain spelling finds."""
    h = "0123456789abcdefABCDEF0123456789"
    texts = [h, h[1:], f"x{h}", f"/{h}{h[:8]}/", f"{h}{h[:8]}", f"a {h}{h[:7]}+ b", f"{h}{h}", f"+/{h}{h[:8]}+", f"é{h}é {h}"]
    for name in ("aws_secret_key", "hex_key"):
        java = BUILTINS[name].java
        plain = re.sub(r"^\(\?=[^)]*\)", "", java)
        assert plain != java
        got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(*[f"regexp_extract_all(t, {q(p)}, 0)" for p in (java, plain)]).collect()
        assert all(r[0] == r[1] for r in got) and any(r[0] for r in got)
