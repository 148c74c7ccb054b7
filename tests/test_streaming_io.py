"""Streaming audit (H2) and result / audit export."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from conftest import SF
from scrubline.operators import audit as A
from scrubline.plans.queries import FIXED_RULES
from scrubline.session import checkpoint_dir
from scrubline.sources import io as IO
from scrubline.streaming.stream import audit_stream


def test_audit_stream_available_now(spark):
    schema = spark.read.option("pathGlobFilter", "conversations.parquet").parquet(SF).schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "conversations.parquet").parquet(SF)
           .withColumn("id", F.concat_ws("-", "conv_id", "turn"))
           .withColumn("ts", F.lit(dt.datetime(2024, 1, 1))))
    path = checkpoint_dir(spark).rstrip("/") + "/audit-stream-test"
    q = audit_stream(spark, src, "text", "id", "ts", FIXED_RULES, path, "audit-test", available_now=True)
    q.awaitTermination()
    audit = spark.read.parquet(path)
    n = spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert audit.count() == n
    assert set(A.AUDIT_SCHEMA.fieldNames()) <= set(audit.columns)


def test_restart(spark, tmp_path):
    """Stop, new files, start again: every row once, in both streams."""
    from scrubline.streaming.stream import run_file_stream
    src, path = str(tmp_path / "in"), str(tmp_path / "audit")
    rows = lambda a, b: spark.createDataFrame([(i, f"mail u{i}@b.co", dt.datetime(2024, 1, 1)) for i in range(a, b)], "id long, text string, ts timestamp")
    for a, b in ((0, 3), (3, 5)):
        rows(a, b).coalesce(1).write.mode("append").parquet(src)
        out = run_file_stream(spark, src, "text", FIXED_RULES, ["id"], "restart-" + tmp_path.name)
        stream = spark.readStream.schema(rows(0, 1).schema).parquet(src).withColumn("id", F.col("id").cast("string"))
        audit_stream(spark, stream, "text", "id", "ts", FIXED_RULES, path, "restart-audit-" + tmp_path.name, available_now=True).awaitTermination()
        assert sorted(r.id for r in out.collect()) == list(range(b))
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [str(i) for i in range(b)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.co", "[EMAIL]")], "id int, text string, sanitized string").withColumn(
        "detections", F.array(F.struct(F.lit("fx_email").alias("rule_id"))))
    IO.export_results(df, str(tmp_path / "csv"), "csv")
    IO.export_results(df, str(tmp_path / "txt"), "text")
    txt = [l for f in os.listdir(tmp_path / "txt") if f.startswith("part") for l in open(tmp_path / "txt" / f)]
    assert txt == ["[EMAIL]\n"]
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0]
    assert json.loads(csv["detections"])[0]["rule_id"] == "fx_email"
    empty = df.limit(0)
    try:
        IO.export_audit(empty, str(tmp_path / "audit"))
        raise AssertionError("empty export must be refused")
    except ValueError:
        pass


def test_sql_functions(spark):
    from scrubline.functions.sql_surface import register_sql_functions
    from scrubline.plans.queries import FIXED_RULES
    names = register_sql_functions(spark, FIXED_RULES, prefix="t")
    assert names == ["t_text", "t_mask", "t_hash"]
    r = spark.sql("SELECT t_text('mail a@b.co from 10.0.0.1') AS s, t_mask('Azure365!') AS m, "
                  "t_hash('john@company.com') AS h, t_text(NULL) AS n").collect()[0]
    assert r["s"] == "mail [EMAIL] from [IP]" and r["m"] == "Xxxxx000!" and r["n"] is None
    assert r["h"] == 2127814104


def _folder_tables(spark, tmp_path):
    """Conversations as a folder of files, as large tables come."""
    rows = [(f"c{i}", i % 3, "user", None if i % 5 == 0 else f"mail u{i}@b.co from 10.0.0.{i}") for i in range(20)]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_stream_sanitize_reads_a_folder(spark, tmp_path):
    from scrubline.plans.queries import stream_sanitize
    out = {r.conv_id: r.sanitized for r in stream_sanitize(spark, _folder_tables(spark, tmp_path)).collect()}
    assert len(out) == 20 and out["c0"] is None and out["c7"] == "mail [EMAIL] from [IP]"


def test_audit_streams_read_a_folder(spark, tmp_path):
    from scrubline.plans.table_queries import stream_audit, stream_trigger
    src = _folder_tables(spark, tmp_path)
    for q in (stream_audit, stream_trigger):
        out = {r.id: (r.sanitized_text, r.detections_count) for r in q(spark, src).collect()}
        assert len(out) == 20 and out["c0-0"] == (None, 0) and out["c7-1"] == ("mail [EMAIL] from [IP]", 2)
