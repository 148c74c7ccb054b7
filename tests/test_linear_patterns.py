"""Linear spellings of patterns find what the plain translation finds, and
hostile or dense rows finish in time proportional to their length."""

import random
import time

import pytest

from scrubline import fixed as FX
from scrubline.functions import regex as RX
from scrubline.functions.sqlx import q
from scrubline.operators.detect import Options, _kv_specs, detect
from scrubline.operators.patterns import _JAVA_OVERRIDES
from scrubline.operators.rules import default_rules
from scrubline.operators.sanitize import sanitize

SOURCE = {n: (js, flags) for n, js, flags in FX.BUILTIN_PATTERNS}


def agree(spark, texts, plain, linear):
    df = spark.createDataFrame([(t,) for t in texts], "x string").repartition(4)
    cols = [c for i, p in enumerate((plain, linear)) for c in (f"regexp_extract_all(x, {q(p)}, 0) AS m{i}", f"split(x, {q(p)}, -1) AS g{i}")]
    rows = df.selectExpr("x", *cols).collect()
    bad = [r for r in rows if r.m0 != r.m1 or r.g0 != r.g1]
    assert not bad, (bad[0].x, bad[0].m0, bad[0].m1)
    return sum(bool(r.m0) for r in rows)


PARTS = {
    "internal_hostname": ["local", "stage", "staging", "corp", "a", "b1", "_", "-", "--", ".", "..", ":80", ":", " ", "LAN", "x.local", "é", "lan.x"],
    "internal_url": ["http://", "https://", "HTTP://", "dev", "test", "a", "_b", "-", ".", "..", ":8", "/", "/x.y", " ", "api.", "com", "qa"],
    "basic_auth": ["ab", "1a", "a", "+", "-", ".", "://", ":", "@", "u:p@h", " ", "_", "é", "x://u:p@", "A9"],
    "gcp_service_key": ["a", "B", "9", "-", "--", "_", "@", "a-b", "@x.iam.gserviceaccount.com", ".iam.gserviceaccount.com", " ", "Aa-", "."],
}


@pytest.mark.parametrize("name", sorted(_JAVA_OVERRIDES))
def test_same_matches(spark, name):
    rnd = random.Random(name)
    texts = ["".join(rnd.choice(PARTS[name]) for _ in range(rnd.randint(1, 14))) for _ in range(6000)]
    assert agree(spark, texts, RX.to_java(*SOURCE[name]).pattern, _JAVA_OVERRIDES[name]) > 50


@pytest.mark.parametrize("key", ["token", "api_key", "secret"])
def test_same_key_value_matches(spark, key):
    rnd = random.Random(key)
    parts = [key, key.upper(), "my", "x_", "_", "API ", "api ", "https:", "ftp:", "http:", ":", "=", " = ", ": ", "\"", "ab12", "value", ",", "}", " ", "\n", "\"" + key + "\": \"v\"", "é", "9"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    specs = _kv_specs(0, key)
    plain = []
    for v in (FX.KV_KEY_VARIATIONS[0], FX.KV_KEY_VARIATIONS[2], FX.KV_KEY_VARIATIONS[4]):
        k = v.format(key=key, Key=key)
        plain += [RX.to_java(t.format(k=k, K=k.upper()), "gi").pattern for t in FX.KV_TEMPLATES]
    if key == "secret":
        plain.append(RX.to_java(FX.KV_SECRET_LOG_TEMPLATE, "gi").pattern)
    assert len(plain) == len(specs)
    assert sum(agree(spark, texts, p, s.java) for p, s in zip(plain, specs)) > 100


HOSTILE = {
    "dotted labels": lambda n: "a." * n + "local",
    "dotted labels, no match": lambda n: "a." * n + "localx_" + " lan",
    "url labels": lambda n: "http://" + "a." * n + "dev.x",
    "letters": lambda n: "x" * n + " token=abcdefgh",
    "hyphens": lambda n: "a-" * n + " local x.iam.gserviceaccount.com",
    "plus": lambda n: "a+" * n + " ://",
    "underscores": lambda n: "secret a" + "_" * n,
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_hostile_rows(spark, kind):
    """100,000 units in one row under all default rules."""
    t = time.time()
    df = spark.createDataFrame([(HOSTILE[kind](100_000),)], "text string")
    detect(df, "text", default_rules(), Options(generate_replacements=False)).select("detections").collect()
    assert time.time() - t < 60


def test_dense_row(spark):
    """More than 10,000 matches in one row: all found, all replaced."""
    n = 12_000
    df = spark.createDataFrame([(" ".join(f"u{i}@example.com" for i in range(n)),)], "text string")
    rules = [r for r in default_rules() if r.pattern == "email"]
    t = time.time()
    r = sanitize(df, "text", rules).collect()[0]
    assert r.detections_count == r.patterns_replaced == n and r.status == "ok"
    assert [d.match for d in r.detections] == [f"u{i}@example.com" for i in range(n)]
    assert "u11999@" not in r.sanitized and time.time() - t < 60


def test_long_values(spark):
    """Values beyond 1,000 characters keep their length and differ by their tails."""
    rules = [r for r in default_rules() if r.pattern == "hex_key"]
    a, b = "ab" * 600, "ab" * 599 + "cd"
    out = [r.sanitized for r in sanitize(spark.createDataFrame([(a,), (b,)], "text string"), "text", rules).collect()]
    assert all(len(x) == 1200 for x in out) and out[0] != out[1] and a not in out
