"""JSON text of any shape: leaves against a walk over the parsed value, escapes, depth, other text."""

import json
import random

from scrubline import fixed as FX
from scrubline.operators.json_text import sanitize_json
from scrubline.operators.rules import Rule
from scrubline.plans.queries import FIXED_RULES

RULES = [*FIXED_RULES, Rule(id="q", type="regex", pattern='z+"', flags="g", replacement='a"\\\n\u0001é', category="custom")]


def leaf(s):
    import re
    out = re.sub(r"\b[a-z]\w*@\w+\.com\b", "[EMAIL]", s)
    out = re.sub(r"\b10\.0\.0\.\d\b", "[IP]", out)
    return re.sub('z+"', 'a"\\\\\n\u0001é', out)


def walk(v, depth=0):
    """The reference walk: keys stay, strings of an object are its own, all
    else is entered one level deeper."""
    if depth > FX.MAX_JSON_DEPTH:
        return FX.MAX_DEPTH_MARKER
    if isinstance(v, list):
        return [walk(x, depth + 1) for x in v]
    if isinstance(v, dict):
        return {k: leaf(x) if isinstance(x, str) else walk(x, depth + 1) for k, x in v.items()}
    return leaf(v) if isinstance(v, str) else v


def value(rnd, depth):
    kind = rnd.random()
    if depth and kind < 0.35:
        return [value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    if depth and kind < 0.7:
        return {rnd.choice(["a@b.com", "k", "é", 'q"q', "x y", ""]) + str(i): value(rnd, depth - 1) for i in range(rnd.randint(0, 4))}
    return rnd.choice([1, -2.5, True, None, "", "plain", "mail u1@x.com, 10.0.0.7", 'say zz" \\ / \t', "é \U0001f600 u@y.com", ": {[", '"', "\\"])


def results(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, sanitized string")
    return {r.id: r for r in sanitize_json(df, "sanitized", RULES).collect()}


def test_shapes(spark):
    rnd = random.Random(4)
    vals = [v for v in (value(rnd, 6) for _ in range(400)) if isinstance(v, (list, dict))]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None, separators=(",", ":") if i % 5 == 0 else None) for i, v in enumerate(vals)]
    got = results(spark, texts)
    for i, (v, t) in enumerate(zip(vals, texts)):
        assert json.loads(got[i].sanitized) == walk(v), t
        assert got[i].output_valid_json
        if walk(v) == v:
            assert got[i].sanitized == t  # untouched text stays byte by byte


def nested(depth, inner, kinds):
    for k in range(depth):
        inner = [inner, 1, "u@x.com"] if kinds[k % len(kinds)] == "[" else {"k": inner, "n": None, "s": "u@x.com"}
    return inner


def test_depth(spark):
    vals = [nested(d, x, k) for d in (49, 50, 51, 52, 53, 90) for k in ("[", "{", "[{", "{{[") for x in ("u@x.com", 7, [], {"a": "u@x.com"})]
    wide = [["u@x.com"]] * 200  # many brackets, not deep
    got = results(spark, [*map(json.dumps, vals), json.dumps(wide), json.dumps(nested(60, [1] * 3000, "["))])
    for i, v in enumerate([*vals, wide]):
        assert json.loads(got[i].sanitized) == walk(v)
    assert all(r.output_valid_json for r in got.values())


def test_other_text_and_hostile(spark):
    long_ = json.dumps({"k": 'x\\"' * 100_000 + " u@x.com"})
    texts = [None, "", "u@x.com", '{"a": "u@x.com"', "[1] u@x.com", ' {"a@b.com" \n: "a@b.com"} ', '"u@x.com"', "{}", "[]", long_, '{"a":"\\ud800 u@x.com"}']
    got = results(spark, texts)
    assert [got[i].sanitized for i in range(9)] == [None, "", "[EMAIL]", '{"a": "[EMAIL]"', "[1] [EMAIL]", ' {"a@b.com" \n: "[EMAIL]"} ', '"[EMAIL]"', "{}", "[]"]
    assert [got[i].output_valid_json for i in range(9)] == [None] * 5 + [True, None, True, True]
    assert json.loads(got[9].sanitized)["k"].endswith(" [EMAIL]") and got[10].output_valid_json
