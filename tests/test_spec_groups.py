"""The regexes of a rule set behind their guards."""

from scrubline.functions.sqlx import q
from scrubline.operators import detect as D
from scrubline.operators.rules import Rule


def test_a_guard_is_tested_once_a_row():
    """The templates of a key-value rule stand behind one test of its key."""
    rules = [Rule(id=f"kv_{k}", type="kv", pattern=k, category="secrets", ordinal=i) for i, k in enumerate(("token", "pin"))]
    comp = D.compile_rules([*rules, Rule(id="any", type="regex", pattern="a+", flags="g")])
    guards = {(s.guard, s.guard_lower): f"`g_{s.guard[0]}`" for s in comp.specs if s.guard}
    sql = D._spec_entries(comp, "`t`", guards)
    assert len(comp.specs) == 31 and [sql.count(g) for g in guards.values()] == [1, 1]
    assert all(q(s.java) in sql for s in comp.specs)


def test_one_and_many_matches(spark):
    """Rows with no, one, a few and more matches than a fold's block."""
    rules = [Rule(id="kv_pin", type="kv", pattern="pin", category="secrets"), Rule(id="n", type="regex", pattern=r"<\d+>", flags="g", ordinal=1)]
    texts = [None, "", "nothing", "é <1>", "pin: abcd, <22>é<3>", "pin: true", "ü" + "<7> " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: [(d.rule_id, d.start, d.end, d.match) for d in sorted(r.detections, key=lambda d: d.start)] for r in D.detect(df, "t", rules, D.Options(generate_replacements=False)).collect()}
    assert got[0] == got[1] == got[2] == got[5] == []
    assert got[3] == [("n", 2, 5, "<1>")]
    assert got[4] == [("kv_pin", 0, 9, "pin: abcd"), ("n", 11, 15, "<22>"), ("n", 16, 19, "<3>")]
    assert got[6] == [("n", 1 + 4 * k, 4 + 4 * k, "<7>") for k in range(200)]
