import random

from pyspark.sql import functions as F

import jsmodel as J
from scrubline.functions import rng as R
from scrubline.functions.sqlx import ident


def _strings(n=60, seed=7):
    rnd = random.Random(seed)
    alphabet = "abcXYZ019 -_@.éüß😀日本"
    out = ["john@company.com", "a@b.co", "", "x" * 1200, "😀" * 600]
    for _ in range(n):
        out.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))))
    return out


def test_hash_rng_shape_match_model(spark):
    words = _strings()
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, s string")
    v = R.rng_values(R.js_hash("s"), 6)
    rows = df.selectExpr("i", "s", f"{R.js_hash('s')} AS h", f"{v} AS v", f"{R.preserve_shape('s')} AS shape",
                         f"{R.alnum(v, 1, 5)} AS an").collect()
    for r in rows:
        s = r["s"]
        assert r["h"] == J.js_hash(s)
        rng = J.Rng(J.js_hash(s))
        vals = [rng.next() for _ in range(6)]
        assert [round(x, 12) for x in r["v"]] == [round(x, 12) for x in vals]
        if s:
            assert r["shape"] == J.preserve_shape(s)
        rng2 = J.Rng(J.js_hash(s))
        rng2.next()
        assert r["an"] == rng2.alnum(5)


def test_golden_fakes(spark):
    from scrubline.functions.generators import builtin_fake_col
    df = spark.createDataFrame([("john@company.com",), ("a@b.co",)], "m string")
    got = [r[0] for r in df.select(builtin_fake_col("m", "email")).collect()]
    assert got == ["user6552@example.com", "user7694@example.com"]
