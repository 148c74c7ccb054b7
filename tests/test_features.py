"""Audit index, differences, pseudonym versions, rule history, run statistics, retention streams, committed exports."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scrubline.operators import audit as A
from scrubline.operators import audit_index as X
from scrubline.operators import history as H
from scrubline.operators import pseudonyms as P
from scrubline.operators import reprocess as R
from scrubline.operators import runstats as S
from scrubline.operators.rules import Rule, default_rules
from scrubline.operators.sanitize import replacement_map, run_statistics, sanitize
from scrubline.plans.queries import FIXED_RULES
from scrubline.sources import committed as C
from scrubline.streaming import retention as N

T0 = dt.datetime(2024, 3, 1)


def log(spark, texts, start=0):
    df = spark.createDataFrame([(str(i), T0 + dt.timedelta(hours=i), t) for i, t in enumerate(texts, start)], "id string, ts timestamp, text string")
    return A.audit_entries(sanitize(df, "text", FIXED_RULES), F.col("id"), F.col("ts"), "text")


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rnd = random.Random(2)
    words = ["alpha", "bravo", "Über", "u7@mail.com", "10.0.0.8", "x\U0001f600y", "%_'", "ab"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for _ in range(120)] + [None, ""]
    texts[60] = "needle in here"
    entries = log(spark, texts)
    path = str(tmp_path / "log")
    X.append_indexed(entries.where("id < '5'").coalesce(1), path, 10)
    X.append_indexed(entries.where("id >= '5'").coalesce(2), path, 10)
    assert X.read_log(spark, path).count() == 122
    for term in ("needle", "ALPHA bravo", "über", "\U0001f600", "x\U0001f600Y", "ip", "[EMAIL]", "email", "%_'", "nothing like it", "ab", "", "u7@mail.com u7"):
        want = sorted(r.id for r in A.search(entries, term).collect())
        assert sorted(r.id for r in X.search_indexed(spark, path, term).collect()) == want, term
    blocks = X._log(spark, path).select("block").distinct().count()
    assert X.candidate_blocks(spark, path, "needle").count() == 1 and blocks >= 12
    assert X.candidate_blocks(spark, path, "ab") is None
    files = X._log(spark, path).select("block", F.col("_metadata.file_path").alias("f"))
    assert files.join(X.candidate_blocks(spark, path, "needle"), "block", "left_semi").select("f").distinct().count() == 1 < files.select("f").distinct().count()


def merged(old, new):
    """Islands of two detection lists, by a plain sweep."""
    out, cur = [], None
    for s, e, r, side in sorted([(*d, 0) for d in set(old)] + [(*d, 1) for d in set(new)]):
        if cur is None or s >= cur[1]:
            cur = [s, e, [[], []]]
            out.append(cur)
        cur[1] = max(cur[1], e)
        cur[2][side].append((s, e, r))
    for s, e, (o, n) in out:
        if sorted(o) != sorted(n):
            yield s, e, "added" if not o else "removed" if not n else "changed", sorted(o), sorted(n)


def test_changes_against_a_plain_sweep(spark):
    rnd = random.Random(6)

    def side():
        at, out = 0, []
        while at < 60:
            s = at + rnd.randint(0, 9)
            at = s + rnd.randint(1, 6)
            out.append((s, at, rnd.choice("ab")))
        return out
    texts = {f"t{i}": (side(), side()) for i in range(30)}
    texts["same"], texts["none"] = (texts["t1"][0], texts["t1"][0]), ([], [])
    df = [spark.createDataFrame([(k, s, e, r, "m", "x") for k, v in texts.items() for s, e, r in v[n]], "id string, start int, end int, rule_id string, match string, replacement string") for n in (0, 1)]
    got = {}
    for r in R.detection_changes(df[0], df[1], ["id"]).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.change, [(d[0], d[1], d[2]) for d in r.old], [(d[0], d[1], d[2]) for d in r.new]))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, v in texts.items() if (w := sorted(merged(*v)))}
    assert R.detection_changes(df[0].limit(0), df[1].limit(0), ["id"]).collect() == []


def test_reprocess(spark):
    a = log(spark, ["mail u1@x.com at 10.0.0.7", "plain", None, "u2@x.com"])
    rules = [FIXED_RULES[0], Rule(id="new", type="literal", pattern="plain", replacement="!")]
    c = {(r.id, r.change) for r in R.reprocess_changes(a, rules).collect()}
    assert c == {("0", "removed"), ("1", "added")}
    assert {(r.change, r.entries, r.places) for r in R.change_counts(R.reprocess_changes(a, rules)).collect()} == {("removed", 1, 1), ("added", 1, 1)}


def test_pseudonyms_grow_by_what_is_new(spark, tmp_path):
    path = str(tmp_path / "p")
    rules = default_rules()
    df = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    one, two = df("a@b.co and c@d.co", "token: abcdef99", None, ""), df("a@b.co then e@f.co", "token: abcdef99 10.0.0.1")
    first = P.update_pseudonyms(one, "text", rules, path)
    assert first.count() == 3 and {r.version for r in first.collect()} == {1}
    assert P.update_pseudonyms(one, "text", rules, path).collect() == []
    second = P.update_pseudonyms(two, "text", rules, path)
    assert {r.match for r in second.collect()} == {"e@f.co", "10.0.0.1"}
    cols = ["rule_id", "match", "vstart", "vend", "replacement"]
    want = replacement_map(one.unionByName(two), "text", rules).select(*cols)
    assert sorted(map(tuple, P.read_pseudonyms(spark, path).select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_rule_history(spark):
    rnd = random.Random(4)
    changes = [(r, T0 + dt.timedelta(hours=rnd.randint(0, 400)), rnd.choice(["set", "set", "delete"]), f"v{k}") for k in range(40) for r in [rnd.choice("abc")]]
    rows = [(k, rnd.choice(["a", "b", "c", "z", None]), T0 + dt.timedelta(hours=rnd.randint(-30, 500))) for k in range(200)] + [(900, "a", None)]
    c = spark.createDataFrame(changes, "rule_id string, changed_at timestamp, op string, label string")
    d = spark.createDataFrame(rows, "k int, rule_id string, timestamp timestamp")
    v = H.rule_versions(c, ["rule_id"])

    def valid(rule, at):
        past = [x for x in changes if at is not None and x[0] == rule and x[1] <= at]
        last = max(past, key=lambda x: (x[1], x[2], x[3])) if past else None
        return last[3] if last and last[2] == "set" else None
    got = {r.k: r.label for r in H.with_valid_rule(d, v, ["rule_id"]).collect()}
    assert got == {k: valid(r, at) for k, r, at in rows} and len({x for x in got.values()}) > 5
    when = T0 + dt.timedelta(hours=200)
    assert {(r.rule_id, r.label) for r in H.rules_at(v, when).collect()} == {(r, valid(r, when)) for r in "abc" if valid(r, when)}
    assert H.with_valid_rule(d.limit(0), v, ["rule_id"]).collect() == []


def test_statistics_in_passing(spark, tmp_path):
    texts = [f"u{i}@x.com " + "y" * (i % 97) for i in range(3000)] + ["same"] * 500 + [None, "", '{"a": 1}']
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    rows = []
    for name, part in (("one", df), ("two", df.limit(100))):
        s, seen = S.observed(sanitize(part, "text", FIXED_RULES), "text", name)
        s.select("sanitized").write.parquet(str(tmp_path / name))
        rows.append(S.run_row(spark, seen, name))
    first = rows[0].first()
    want = run_statistics(sanitize(df, "text", FIXED_RULES)).first()
    assert (first.rows, first.rows_with_detections, first.json_rows, first.detections, first.input_chars) == (want.rows, 3000, 1, want.detections, want.input_chars)
    both = S.summed(rows[0].unionByName(rows[1])).first()
    assert both.runs == 2 and both.rows == len(texts) + 100
    distinct = len({t or "" for t in texts})
    assert abs(both.distinct_texts - distinct) < 0.06 * distinct
    sizes = sorted(len(t or "") for t in texts)
    for x, got in zip((0.5, 0.9, 0.99), both.size_quantiles):
        assert abs(sum(s <= got for s in sizes) / len(sizes) - x) < 0.06


def test_retention_goes_on_after_a_restart(spark, tmp_path):
    path, rnd = str(tmp_path / "in"), random.Random(1)
    everything = []
    for k in range(4):
        part = log(spark, [f"t{rnd.random()}" for _ in range(40)], 40 * k).withColumn("profile_name", F.when(F.col("id") % 3 == 0, F.lit("a")).when(F.col("id") % 3 == 1, F.lit("b")))
        part.repartition(2).write.mode("append").parquet(path)
        everything.append(part)
        src = spark.readStream.schema(A.AUDIT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        N.retain_stream(spark, src, "retention-test", 7).awaitTermination()
        all_ = everything[0]
        for p in everything[1:]:
            all_ = all_.unionByName(p)
        want = {}
        for r in all_.select("id", "timestamp", "profile_name").collect():
            want.setdefault(r.profile_name, []).append((r.timestamp, r.id))
        got = {}
        for r in N.kept(spark, "retention-test").collect():
            got.setdefault(r.profile_name, []).append((r.timestamp, r.id))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[-7:] for k, v in want.items()}


def test_exports_are_visible_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "x")
    with pytest.raises(FileNotFoundError):
        C.read_committed(spark, path)
    df = spark.range(100).selectExpr("id", "concat('line ', id, ' \"q\", x') AS t")
    for fmt in ("json", "csv", "parquet"):
        C.export_committed(df.repartition(3), path, fmt)
        assert sorted(map(tuple, C.read_committed(spark, path).collect())) == sorted(map(tuple, df.collect()))
        assert C.manifest(spark, path).agg(F.sum("rows")).first()[0] == 100
    with pytest.raises(Exception, match="(?i)boom"):
        C.export_committed(df.withColumn("t", F.when(F.col("id") == 77, F.raise_error(F.lit("boom"))).otherwise(F.col("t"))).repartition(3), path)
    assert C.read_committed(spark, path).count() == 100 and C.manifest(spark, path).first().format == "parquet"
    C.export_committed(df.limit(0), path, "json")
    assert C.read_committed(spark, path).collect() == []
    C.export_committed(df.select("t"), path, "text")
    assert C.read_committed(spark, path).count() == 100


def test_trigrams_of_a_block():
    """Distinct, none across two strings, also by sorting when the alphabet is large."""
    plain = lambda texts: {t[i:i + 3] for t in texts for i in range(len(t) - 2)}
    wide = "".join(chr(0x4E00 + 7 * i % 900) for i in range(3000))  # 900^3 trigrams are possible
    for texts in ([], ["ab", "", "c"], ["abcabc", "bcd", "x\U0001f600yz", "\x00\x00\x00"], [wide, "abc"]):
        got = X._trigrams(texts)
        assert len(got) == len(set(got)) and set(got) == plain(texts)
