"""The registered E10 query, against the detections of every document."""

import collections
import re

import __spark_entry__ as E
from conftest import SF
from scrubline.operators.detect import detect
from scrubline.operators.rules import default_rules


def test_replacement_map_default(spark):
    got = collections.Counter(tuple(r) for r in E.queries()["replacement_map_default"](spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = detect(docs, "text", default_rules()).collect()
    want = {(d.rule_id, d.match, d.replacement) for r in rows for d in r.detections}
    assert want and set(got) == want and set(got.values()) == {1}
    # found by another engine: whatever Python finds as an e-mail address is a value of the map
    found = {m for r in docs.collect() for m in re.findall(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r.text or "")}
    assert found and found <= {m for rule, m, _ in got if rule == "builtin_email"}
