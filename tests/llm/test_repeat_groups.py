"""One passage behind few headings in many documents: groups of few contexts and many rows."""

import random
import string

from pyspark.sql import functions as F

from scrubline.llm import suffix_repeats
from test_brute_force import brute_repeats


def test_rows_of_a_group_are_bounded(spark, monkeypatch):
    rnd = random.Random(8)
    junk = lambda n: "".join(rnd.choice(string.ascii_lowercase + " ") for _ in range(n))
    heads, passage = [junk(260) for _ in range(12)], junk(600)
    texts = [junk(20) + heads[i % 12] + passage + junk(40) for i in range(500)]
    most, plain = [], suffix_repeats.map_runs

    def counted(df, keys, *args, **tasks):
        most.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return plain(df, keys, *args, **tasks)

    monkeypatch.setattr(suffix_repeats, "BLOCK", 16)
    monkeypatch.setattr(suffix_repeats, "map_runs", counted)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_repeats.remove_repeats(d).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))
    assert max(m or 0 for m in most) <= 16
