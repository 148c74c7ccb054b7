"""Rule-table, custom-word and audit operators."""

import datetime as dt

from pyspark.sql import functions as F

from scrubline.operators import audit as A
from scrubline.operators import rules as RL
from scrubline.operators import words as W
from scrubline.operators.rules import Rule


def test_default_rules_and_stats(spark):
    df = RL.default_rules_df(spark)
    assert df.count() == 60
    s = RL.rule_stats(df).collect()[0].asDict()
    assert s == {"total": 60, "enabled": 60, "disabled": 0, "builtin": 45, "custom": 15}
    cats = {r["category"]: r["n"] for r in df.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert cats == {"secrets": 50, "pii": 5, "company": 4, "network": 1}


def test_validate_rules(spark):
    rules = RL.default_rules() + [
        Rule(id="bad1", type="nope", pattern="x", category="custom"),
        Rule(id="bad2", type="regex", pattern="(unclosed", category="custom"),
        Rule(id="bad3", type="literal", pattern="", category="weird", enabled=None),
    ]
    v = {r["id"]: r["validation"] for r in RL.validate_rules(RL.rules_df(spark, rules)).collect()}
    assert not v["builtin_ipv6"]["is_valid"]           # category 'network' fails its own check
    assert v["builtin_email"]["is_valid"]
    assert len(v["bad1"]["errors"]) == 1
    assert any("regex" in e for e in v["bad2"]["errors"])
    assert len(v["bad3"]["errors"]) == 3


def test_filter_and_rank(spark):
    df = RL.default_rules_df(spark)
    assert RL.filter_rules(df, category="pii").count() == 5
    assert RL.filter_rules(df, rule_type="kv").count() == 15
    assert RL.filter_rules(df, search="GITHUB").count() == 8   # 7 tokens + repository URL
    ranked = [r["id"] for r in RL.rank_rules(df).orderBy("rank").collect()]
    assert ranked[0] == "kv_password" and ranked[15] == "builtin_ssn" and ranked[16] == "builtin_credit_card"
    assert [r.id for r in RL.rank_rule_list(RL.default_rules())] == ranked


def test_crud(spark):
    df = RL.default_rules_df(spark)
    new = Rule(id="x1", type="literal", pattern="acme", category="company")
    df2 = RL.upsert_rule(df, new)
    assert df2.count() == 61
    df3 = RL.toggle_rule(df2, "x1")
    assert df3.where("id = 'x1'").collect()[0]["enabled"] is False
    assert RL.delete_rule(df3, "x1").count() == 60


def test_words(spark):
    none = W.word_table(spark)
    one = lambda word, cat: spark.createDataFrame([(word, cat, 0)], "word string, word_category string, ordinal int")
    t = W.add_words(none, one("  Acme ", "company"))
    t = W.add_words(t, one("Rival", "competitor"))
    t = W.add_words(t, one("rival", "competitor"))
    t = W.add_words(t, one("Zeus9", "custom"))
    t = W.add_words(t, one(None, "custom"))
    assert sorted((r.word, r.word_category) for r in t.collect()) == [("acme", "company"), ("rival", "competitor"), ("zeus9", "custom")]
    assert tuple(W.word_stats(t).first()) == (1, 1, 0, 1, 3)
    rules = RL.collect_rules(W.word_rules(t))
    assert [r.id for r in rules] == ["custom_company_name", "custom_competitor_0", "custom_word_0"]
    assert [r.replacement for r in rules] == ["CompanyName", "CompetitorName", "[REDACTED]"]
    custom = RL.collect_rules(W.word_rules(W.word_table(spark, custom=["Azure365!"]), "custom"))
    assert custom[0].replacement == "Xxxxx000!"
    comp = RL.collect_rules(W.word_rules(W.word_table(spark, company=["acme"], project=["p"]), "competitor"))
    assert comp[0].replacement in ("TechCorp", "InnovateCo", "GlobalTech", "FutureSoft", "NextGen")
    assert comp[1].replacement == "[PROJECT_REDACTED]"
    assert {r.word for r in W.remove_words(t, one("RIVAL", "competitor")).collect()} == {"acme", "zeus9"}
    assert {r.word for r in W.add_words(t, one("Other", "company")).collect()} == {"other", "rival", "zeus9"}
    both = W.rules_with_words(RL.default_rules_df(spark), t)
    assert both.count() == 63


def test_profiles(spark):
    rules = RL.default_rules_df(spark)
    at = dt.datetime(2024, 5, 1)
    profiles = spark.createDataFrame([("default", at, at, True)], RL.PROFILE_SCHEMA)
    rules2, profiles = RL.save_profile(rules, profiles, "team", rules.limit(2), at)
    assert RL.profile_rules(rules2, "team").count() == 2 and RL.profile_rules(rules2).count() == 60
    profiles = RL.select_profile(profiles, "team")
    assert RL.current_profile(profiles).first().profile == "team"
    rules3, profiles = RL.delete_profile(rules2, profiles, "team")
    assert rules3.count() == 60 and RL.current_profile(profiles).first().profile == "default"


def test_rule_files(spark, tmp_path):
    """Two files, no ordinals: file order, no overflow; export keeps the order."""
    from scrubline.sources import io as IO
    for i, name in enumerate(("a.json", "b.json")):
        (tmp_path / name).write_text("".join('{"id": "r%d%d", "type": "literal", "pattern": "x"}\n' % (i, k) for k in range(3)))
    r = IO.read_rules(spark, str(tmp_path / "*.json"))
    assert [(x.id, x.ordinal) for x in r.orderBy("ordinal").collect()] == [(f"r{i}{k}", 3 * i + k) for i in range(2) for k in range(3)]
    IO.export_rules(RL.default_rules_df(spark).repartition(7), str(tmp_path / "out"))
    back = IO.import_rules(spark, str(tmp_path / "out")).orderBy("ordinal").collect()
    assert [x.id for x in back] == [x.id for x in RL.default_rules()]


def test_table_with_status_column(spark):
    from scrubline.operators.sanitize import run_statistics, sanitize, sanitize_table
    df = spark.createDataFrame([("a@b.co", "call 10.0.0.1", 1), (None, "", 2)], "status string, detections string, n int")
    rules = [r for r in RL.default_rules() if r.pattern in ("email", "ip")]
    rows = sanitize_table(df, None, rules).collect()
    assert rows[0].status != "a@b.co" and rows[0].status.endswith("@example.com") and "10.0.0.1" not in rows[0].detections
    assert tuple(rows[1]) == (None, "", 2)
    try:
        sanitize(df, "status", rules)
        raise AssertionError("a clash must be refused")
    except ValueError:
        pass
    s = run_statistics(sanitize(df.select(F.col("status").alias("text")), "text", rules)).first()
    assert (s.rows, s.rows_with_detections, s.replacements) == (2, 1, 1)


def test_replacement_map(spark):
    from conftest import SF
    from scrubline.operators.sanitize import apply_replacements, replacement_map, sanitize
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rules = RL.default_rules()
    mapping = replacement_map(docs, "text", rules)
    got = {r.doc_id: r.sanitized for r in apply_replacements(docs, "text", "doc_id", rules, mapping).collect()}
    want = {r.doc_id: r.sanitized for r in sanitize(docs, "text", rules).collect()}
    assert got == want


def _audit(spark):
    rows = [(str(i), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"t{i} a@b.co" if i % 2 else f"t{i}",
             f"t{i} [EMAIL]" if i % 2 else f"t{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, original_text string, sanitized_text string")
    det = F.when(F.col("original_text").contains("@"), F.array(F.struct(
        F.lit("fx_email").alias("rule_id"), F.lit("Email").alias("rule_name"), F.lit("pii").alias("category"),
        F.lit("email").alias("pattern"), F.lit("a@b.co").alias("match"), F.lit(0).alias("start"), F.lit(6).alias("end"),
        F.lit("[EMAIL]").alias("replacement"), F.lit(True).alias("selected")))).otherwise(F.array().cast(A.DETECTION_TYPE))
    return df.withColumn("detections", det)


def test_audit_ops(spark):
    a = _audit(spark)
    s = A.audit_stats(a).collect()[0]
    assert (s["entries"], s["total_detections"], s["modified_entries"], s["avg_detections"]) == (30, 15, 15, 0.5)
    assert [r["id"] for r in A.retain(a, 3).collect()] == ["29", "28", "27"]
    assert [r["id"] for r in A.page(a, 2, 10).collect()][0] == "19"
    assert A.search(a, "EMAIL").count() == 15
    assert A.date_filter(a, "today", dt.datetime(2024, 1, 2, 5)).count() == 6
    assert A.delete(a, spark.createDataFrame([("1",), ("2",)], "id string")).count() == 28
    assert A.by_category(a).collect()[0]["n"] == 15
    assert A.clear(a).count() == 0


def test_rule_io_roundtrip(spark, tmp_path):
    from scrubline.sources import io as IO
    df = RL.default_rules_df(spark)
    IO.export_rules(df, str(tmp_path / "export"))
    imported = IO.import_rules(spark, str(tmp_path / "export"))
    assert imported.count() == 60
    assert imported.where("NOT validation.is_valid").count() == 1     # builtin_ipv6 ('network')
    IO.backup(str(tmp_path / "bk"), rules=df)
    parts = IO.restore(spark, str(tmp_path / "bk"))
    assert set(parts) == {"rules"} and parts["rules"].count() == 60


def test_export_of_many_rules(spark, tmp_path):
    """More rules than one document holds: all come back, in order."""
    from scrubline.sources import io as IO
    n = 2 * IO.EXPORT_RULES + 3
    rules = spark.range(n).selectExpr("concat('r', id) AS id", "'literal' AS type", "concat('p', id) AS pattern", "cast(NULL AS string) AS flags", "'x' AS replacement",
                                      "'custom' AS category", "true AS enabled", "cast(NULL AS int) AS priority", "cast(NULL AS string) AS name",
                                      "cast(NULL AS string) AS description", "false AS case_sensitive", f"cast({n} - id AS int) AS ordinal", "cast(NULL AS string) AS profile")
    IO.export_rules(rules, str(tmp_path / "many"))
    back = IO.import_rules(spark, str(tmp_path / "many")).orderBy("ordinal").collect()
    assert [r.ordinal for r in back] == list(range(n))
    assert [r.id for r in back] == [f"r{k}" for k in reversed(range(n))] and all(r.validation.is_valid for r in back)
