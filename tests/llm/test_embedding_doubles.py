"""Vectors of doubles: extreme components, pairs that floats would confuse, one dimension."""

import numpy as np

from scrubline.llm import embed_caps


def result(spark, vectors, kind="double"):
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, label int")
    return {r.id: (r.n_links, r.component_id) for r in embed_caps.near_duplicates(df).collect()}


def test_extreme_components(spark):
    got = result(spark, [[1e300, 0], [1e300, 1], [1e-300, 0], [0, 1e-300], [-1e300, 0], [5e-324, 5e-324], [1e308, 1e308]])
    assert [got[i] for i in range(7)] == [(2, 0), (2, 0), (2, 0), (0, 3), (0, 4), (1, 5), (1, 5)]


def test_the_threshold_in_double_precision(spark):
    """Pairs a hair above and below 0.93, closer than floats can tell."""
    vectors, want = [], []
    for k, gap in enumerate((1e-12, -1e-12)):
        c = 0.93 + gap
        e = np.zeros(16)
        e[2 * k] = 1.0
        f = np.zeros(16)
        f[2 * k], f[2 * k + 1] = c, np.sqrt(1 - c * c)
        vectors += [e * 1e5, f * 3e-7]
        want.append(gap > 0)
    got = result(spark, vectors)
    assert [got[2 * k][0] == 1 for k in range(2)] == want


def test_one_dimension(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    x[7] = 0.0
    for kind in ("double", "float"):
        got = result(spark, x[:, None], kind)
        for sign in (-1, 1):
            ids = [i for i in range(400) if np.sign(x[i]) == sign]
            assert {got[i] for i in ids} == {(len(ids) - 1, ids[0])}
        assert got[7] == (0, 7)
