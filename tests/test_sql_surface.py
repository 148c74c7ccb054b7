"""Detections as rows in SQL: the same rows as the DataFrame operator, on the calling row, without a join."""

from scrubline.functions.sql_surface import register_detections
from scrubline.operators.detect import detect
from scrubline.operators.hits import explode_detections
from scrubline.operators.rules import default_rules

TEXTS = ["mail a@b.co, again a@b.co and 10.0.0.1", None, "", "nothing", "token: abcdef99 x@y.co", "mail a@b.co, again a@b.co and 10.0.0.1"]


def test_lateral_detections(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    df.createOrReplaceTempView("lateral_texts")
    f = register_detections(spark, default_rules(), prefix="lateral")
    got = spark.sql(f"SELECT d.id, x.* FROM lateral_texts d, LATERAL {f}(d.t) x")
    want = explode_detections(detect(df, "t", default_rules()), ["id"]).select(*got.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) == 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan
