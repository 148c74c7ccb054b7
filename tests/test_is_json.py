"""E4 against the standard JSON parser, trailing text among the cases."""

import json

from pyspark.sql import functions as F

from scrubline.operators.sanitize import is_json, output_valid_json

TEXTS = ["{}", "[]", " [1] ", "[1] x", "[1],[2]", "[1],null", '{"a":1}{', '{"a":1},"b":2', "{}]", "[}", "[", "1", '"x"', "", None, "\n{\"a\": [1, {\"b\": null}]}\t", "[1", "[01]", "{a:1}", "[1,]"]


def valid(t, container):
    try:
        return isinstance(json.loads(t), (dict, list) if container else object)
    except (ValueError, TypeError):
        return False


def test_is_json(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    for r in df.select("id", is_json(F.col("t")).alias("a"), output_valid_json(F.col("t")).alias("b")).collect():
        assert r.a == valid(TEXTS[r.id], True) and r.b == valid(TEXTS[r.id], False), TEXTS[r.id]
