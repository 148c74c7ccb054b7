"""Registered queries over rule tables, word tables, the audit log, exports
and streams, each with DuckDB SQL.  Rule and word tables are derived from
``part`` and ``supplier``, so they grow with the data."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from scrubline import fixed as FX
from scrubline.functions.stored import stored
from scrubline.operators import audit as A
from scrubline.operators import audit_index, history, pseudonyms, reprocess, runstats
from scrubline.operators import rules as RL
from scrubline.operators import words as W
from scrubline.operators.detect import Options, detect
from scrubline.operators.hits import explode_detections
from scrubline.operators.rules import Rule, default_rules
from scrubline.operators.sanitize import sanitize, sanitize_table
from scrubline.plans import oracles as O
from scrubline.plans import queries as Q
from scrubline.plans.inputs import stream_path, table
from scrubline.session import checkpoint_dir
from scrubline.sources import committed
from scrubline.sources import io as IO
from scrubline.streaming import retention
from scrubline.streaming.stream import audit_stream


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- rule tables

#: A rule for every part, in SQL that both engines run; some are invalid.
_RULE_COLUMNS = {
    "id": "'r'||cast(p_partkey as string)",
    "type": "CASE p_partkey % 6 WHEN 0 THEN 'literal' WHEN 1 THEN 'regex' WHEN 2 THEN 'builtin' WHEN 3 THEN 'kv' WHEN 4 THEN 'other' END",
    "pattern": ("CASE WHEN p_partkey % 11 = 10 THEN NULL WHEN p_partkey % 13 = 12 THEN '' WHEN p_partkey % 6 = 2 THEN "
                "CASE p_partkey % 4 WHEN 0 THEN 'ssn' WHEN 2 THEN 'email' ELSE 'npm_token' END "
                "WHEN p_partkey % 6 = 1 AND p_partkey % 5 = 0 THEN '('||p_name ELSE p_name END"),
    "flags": "'g'", "replacement": "cast(NULL as string)",
    "category": "CASE p_partkey % 5 WHEN 0 THEN 'secrets' WHEN 1 THEN 'pii' WHEN 2 THEN 'company' WHEN 3 THEN 'custom' ELSE 'network' END",
    "enabled": "CASE WHEN p_partkey % 7 = 6 THEN NULL ELSE p_partkey % 3 <> 0 END",
    "priority": "cast(NULL as int)",
    "name": "CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 9 = 8 THEN NULL ELSE p_brand END",
    "description": "p_type", "case_sensitive": "p_partkey % 2 = 0", "ordinal": "cast(p_partkey as int)",
    "profile": "CASE p_partkey % 3 WHEN 0 THEN 'team' WHEN 1 THEN 'default' END",
}
_RULES_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _RULE_COLUMNS.items()) + " FROM part)"


def _part_rules(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in _RULE_COLUMNS.items()])


def rules_validated(spark, sf_dir):
    """B1: every rule's errors."""
    v = RL.validate_rules(_part_rules(spark, sf_dir))
    return v.select("id", F.col("validation.is_valid").alias("is_valid"), F.array_join("validation.errors", "; ").alias("errors"))


def rules_validated_sql():
    kinds = ", ".join(O.lit(t) for t in FX.RULE_TYPES)
    cats = ", ".join(O.lit(c) for c in FX.RULE_CATEGORIES)
    errors = (f"concat_ws('; ', CASE WHEN type IS NULL OR type NOT IN ({kinds}) THEN {O.lit(FX.ERR_TYPE)} END, CASE WHEN coalesce(pattern, '') = '' THEN {O.lit(FX.ERR_PATTERN)} END, "
              f"CASE WHEN category NOT IN ({cats}) THEN {O.lit(FX.ERR_CATEGORY)} END, CASE WHEN enabled IS NULL THEN {O.lit(FX.ERR_ENABLED)} END, "
              f"CASE WHEN type = 'regex' AND (pattern IS NULL OR starts_with(pattern, '(')) THEN {O.lit(FX.ERR_REGEX + 'does not compile')} END)")
    return f"SELECT id, e = '' AS is_valid, e AS errors FROM (SELECT id, {errors} AS e FROM {_RULES_SQL})"


def rules_ranked(spark, sf_dir):
    """The rank and priority of every rule."""
    return RL.rank_rules(_part_rules(spark, sf_dir)).select("id", "rank", "global_priority")


def rules_ranked_sql():
    kind = "CASE type " + " ".join(f"WHEN {O.lit(k)} THEN {v}" for k, v in FX.TYPE_PRIORITY.items()) + f" ELSE {FX.UNKNOWN_PRIORITY} END"
    own = ("CASE WHEN type = 'builtin' THEN CASE pattern " + " ".join(f"WHEN {O.lit(k)} THEN {v}" for k, v in FX.BUILTIN_PRIORITY.items()) + f" ELSE {FX.UNKNOWN_PRIORITY} END ELSE 0 END")
    return (f"SELECT id, CAST(row_number() OVER (ORDER BY k, o, ordinal, id) - 1 AS INTEGER) AS rank, CAST(k * 1000 + o AS INTEGER) AS global_priority "
            f"FROM (SELECT *, {kind} AS k, {own} AS o FROM {_RULES_SQL})")


def rules_filtered(spark, sf_dir):
    """Enabled company rules that mention a term, with their display name."""
    r = RL.enabled_rules(RL.filter_rules(_part_rules(spark, sf_dir), category="company", search="RI"))
    return r.select("id", RL.display_name(F.col("name"), F.col("pattern")).alias("shown"))


def rules_filtered_sql():
    hit = " OR ".join(f"coalesce(contains(lower({c}), 'ri'), FALSE)" for c in ("name", "pattern", "description"))
    return f"SELECT id, coalesce(nullif(name, ''), pattern) AS shown FROM {_RULES_SQL} WHERE category = 'company' AND ({hit}) AND coalesce(enabled, FALSE)"


def rules_counted(spark, sf_dir):
    """The statistics of a rule table."""
    return RL.rule_stats(_part_rules(spark, sf_dir))


def rules_counted_sql():
    return (f"SELECT count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE NOT coalesce(enabled, FALSE)) AS disabled, "
            f"count(*) FILTER (WHERE type = 'builtin') AS builtin, count(*) FILTER (WHERE type IS DISTINCT FROM 'builtin') AS custom FROM {_RULES_SQL}")


def rules_changed(spark, sf_dir):
    """One rule replaced, one added, one toggled, one deleted."""
    r = RL.upsert_rule(_part_rules(spark, sf_dir), Rule(id="r5", type="literal", pattern="acme", category="company"))
    r = RL.upsert_rule(r, Rule(id="new", type="kv", pattern="pin", category="secrets"))
    return RL.delete_rule(RL.toggle_rule(r, "r8"), "r9").select("id", "type", "pattern", "category", "enabled", "ordinal")


def rules_changed_sql():
    cols = "id, type, pattern, category"
    return (f"SELECT {cols}, CASE WHEN id = 'r8' THEN NOT coalesce(enabled, FALSE) ELSE enabled END AS enabled, ordinal FROM {_RULES_SQL} WHERE id NOT IN ('r5', 'r9') "
            f"UNION ALL SELECT 'r5', 'literal', 'acme', 'company', TRUE, 5 UNION ALL SELECT 'new', 'kv', 'pin', 'secrets', TRUE, max(ordinal) + 1 FROM {_RULES_SQL}")


def rules_profiles(spark, sf_dir):
    """A profile saved under a new name, another deleted: rules by profile."""
    rules, at = _part_rules(spark, sf_dir), dt.datetime(2024, 5, 1)
    profiles = rules.select(F.coalesce("profile", F.lit("default")).alias("profile")).distinct().select(
        "profile", F.lit(at).alias("created"), F.lit(at).alias("last_modified"), (F.col("profile") == "team").alias("current"))
    rules, profiles = RL.save_profile(rules, profiles, "copy", RL.profile_rules(rules, "team").where("type = 'literal'"), at + dt.timedelta(days=1))
    rules, profiles = RL.delete_profile(rules, profiles, "team")
    n = rules.groupBy(F.coalesce("profile", F.lit("default")).alias("profile")).agg(F.count("*").alias("n"))
    return profiles.join(n, "profile").select("profile", "n", "current", "last_modified")


def rules_profiles_sql():
    return (f"WITH r AS (SELECT coalesce(profile, 'default') AS profile, type FROM {_RULES_SQL}) "
            "SELECT profile, count(*) AS n, TRUE AS current, TIMESTAMP '2024-05-01 00:00:00' AS last_modified FROM r WHERE profile = 'default' GROUP BY 1 "
            "UNION ALL SELECT 'copy', count(*), FALSE, TIMESTAMP '2024-05-02 00:00:00' FROM r WHERE profile = 'team' AND type = 'literal'")


def rules_read(spark, sf_dir):
    """A2: a rule table written as JSON lines and read back."""
    path = _folder(spark, "rules")
    _part_rules(spark, sf_dir).write.json(path)
    return IO.read_rules(spark, path).select("id", "type", "pattern", "enabled", "ordinal", "profile")


def rules_read_sql():
    return f"SELECT id, type, pattern, enabled, ordinal, profile FROM {_RULES_SQL}"


def rules_imported(spark, sf_dir):
    """A3, A4: supplier names as literal rules, exported as one document and
    imported with their validation."""
    path = _folder(spark, "export")
    s = table(spark, sf_dir, "supplier").selectExpr("'s'||cast(s_suppkey as string) AS id", "'literal' AS type", "s_name AS pattern", "cast(NULL as string) AS flags", "'[SUPPLIER]' AS replacement",
                                                    "'company' AS category", "true AS enabled", "cast(NULL as int) AS priority", "s_name AS name", "cast(NULL as string) AS description",
                                                    "false AS case_sensitive", "cast(s_suppkey as int) AS ordinal", "cast(NULL as string) AS profile")
    IO.export_rules(s, path, dt.datetime(2024, 1, 1))
    return IO.import_rules(spark, path).select("id", "pattern", "replacement", "ordinal", F.col("validation.is_valid").alias("is_valid"))


def rules_imported_sql():
    return ("SELECT 's' || s_suppkey AS id, s_name AS pattern, '[SUPPLIER]' AS replacement, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS ordinal, TRUE AS is_valid FROM supplier")


# ---------------------------------------------------------------- words

_WORDS_SQL = """(SELECT lower(n_name) AS word, 'competitor' AS word_category, n_nationkey AS ordinal FROM nation
   UNION ALL SELECT lower(p_name), 'project', CAST(min(p_partkey) AS INTEGER) FROM part GROUP BY p_name UNION ALL SELECT 'sku' || p_partkey, 'custom', CAST(p_partkey AS INTEGER) FROM part)"""


def words_counted(spark, sf_dir):
    """B12."""
    return W.word_stats(Q._part_words(spark, sf_dir))


def words_counted_sql():
    return f"""SELECT 0::BIGINT AS company, count(*) FILTER (WHERE word_category = 'competitor') AS competitors, count(*) FILTER (WHERE word_category = 'project') AS projects,
      count(*) FILTER (WHERE word_category = 'custom') AS custom, count(*) AS total FROM {_WORDS_SQL}"""


def words_changed(spark, sf_dir):
    """Part names (some known) and market segments added, nations removed."""
    words = Q._part_words(spark, sf_dir)
    row = lambda c, cat: [F.concat(F.lit(" "), F.upper(c), F.lit(" ")).alias("word"), F.lit(cat).alias("word_category"), F.lit(0).alias("ordinal")]
    new = table(spark, sf_dir, "part").select(*row(F.col("p_name"), "project")).unionByName(table(spark, sf_dir, "customer").select(*row(F.col("c_mktsegment"), "project")))
    gone = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(*row(F.col("n_name"), "competitor"))
    return W.remove_words(W.add_words(words, new), gone).select("word", "word_category", "ordinal")


def words_changed_sql():
    return f"""WITH w AS (SELECT * FROM {_WORDS_SQL}), n AS (SELECT DISTINCT lower(trim(c_mktsegment)) AS word FROM customer),
      last AS (SELECT max(ordinal) AS o FROM w WHERE word_category = 'project')
      SELECT word, word_category, ordinal FROM w WHERE NOT (word_category = 'competitor' AND word IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 5))
      UNION ALL SELECT word, 'project', CAST((SELECT o FROM last) + row_number() OVER (ORDER BY word) AS INTEGER) FROM n
      WHERE word NOT IN (SELECT word FROM w WHERE word_category = 'project')"""


def words_replaced(spark, sf_dir):
    """The replacement of every word by each strategy (the competitor
    strategy hashes company names only; the list has none)."""
    w = Q._part_words(spark, sf_dir)
    return w.select("word", "word_category", *[W.word_replacement(F.col("word"), F.col("word_category"), s).alias(s) for s in ("generic", "custom", "competitor", "other")])


def words_replaced_sql():
    generic = "CASE word_category " + " ".join(f"WHEN '{k}' THEN {O.lit(v)}" for k, v in FX.GENERIC_WORD_REPLACEMENT.items()) + " END"
    return (f"SELECT word, word_category, {generic} AS generic, {O.mask_word_sql('word')} AS custom, '[' || upper(word_category) || '_REDACTED]' AS competitor, '[REDACTED]' AS other FROM {_WORDS_SQL}")


# ---------------------------------------------------------------- detection details and sanitize options

_DOCS = "SELECT doc_id, text FROM documents"


def _kept(source: str = _DOCS, keys: tuple = ("doc_id",)) -> str:
    return O.resolved(O.candidates(source, Q._rule_tuples(Q.FIXED_RULES), list(keys)), list(keys))


def detection_context(spark, sf_dir):
    """15 characters around every detection."""
    d = detect(Q._docs(spark, sf_dir), "text", Q.FIXED_RULES, Options(include_context=True, context_length=15))
    return explode_detections(d, ["doc_id"]).select("doc_id", "start", F.col("context.before").alias("before"), F.col("context.after").alias("after"), F.col("context.full").alias("full"))


def detection_context_sql():
    lo = "greatest(start - 15, 0)"
    before, after = f"substr(text, {lo} + 1, start - {lo})", 'substr(text, "end" + 1, 15)'
    return f"SELECT doc_id, start, {before} AS before, {after} AS after, {before} || match || {after} AS full FROM ({_kept()}) k JOIN documents USING (doc_id)"


def detection_order(spark, sf_dir):
    """The place of each detection in its text's list, by priority and start."""
    d = detect(Q._docs(spark, sf_dir), "text", Q.FIXED_RULES, Q.SPANS_ONLY)
    return d.selectExpr("doc_id", "posexplode_outer(detections) AS (pos, d)").where("pos IS NOT NULL").selectExpr("doc_id", "pos", "d.rule_id AS rule_id", "d.start AS start")


def detection_order_sql():
    return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY prio, start) - 1 AS INTEGER) AS pos, rule_id, start FROM ({_kept()}) k"


def sanitize_selected(spark, sf_dir):
    """All rules detect, one is replaced."""
    s = sanitize(Q._docs(spark, sf_dir), "text", Q.FIXED_RULES, Options(selected_rule_ids=["fx_ip"]))
    return s.select("doc_id", "sanitized", "detections_count", "patterns_replaced")


def sanitize_selected_sql():
    spliced = O.spliced(_DOCS, "SELECT * FROM found WHERE rule_id = 'fx_ip'", ["doc_id"], "'[IP]'")
    return f"""WITH found AS MATERIALIZED ({_kept()}), s AS ({spliced}),
      n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE rule_id = 'fx_ip') AS ip FROM found GROUP BY doc_id)
      SELECT doc_id, sanitized, CAST(coalesce(n, 0) AS INTEGER) AS detections_count, CAST(coalesce(ip, 0) AS INTEGER) AS patterns_replaced FROM s LEFT JOIN n USING (doc_id)"""


def sanitize_report(spark, sf_dir):
    """Status, kind, sizes and validity of text and JSON input."""
    made = Q._docs(spark, sf_dir).where("text IS NOT NULL").selectExpr("'json' AS src", "doc_id AS id", f"{Q._MADE_JSON} AS text")
    s = sanitize(made.unionByName(Q._docs(spark, sf_dir).selectExpr("'text' AS src", "doc_id AS id", "text")), "text", Q.FIXED_RULES)
    return s.select("src", "id", "status", "input_type", "input_size", "output_size", "output_valid_json")


def sanitize_report_sql():
    src = f"SELECT 'json' AS src, doc_id AS id, {Q._MADE_JSON} AS text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'text', doc_id, text FROM documents"
    t = "trim(text, ' \t\n\r')"
    j = f"coalesce((starts_with({t}, '{{') OR starts_with({t}, '[')) AND json_valid({t}), FALSE)"
    return f"""WITH docs AS MATERIALIZED ({src}), s AS ({Q._fixed_sanitized_sql('SELECT * FROM docs', ['src', 'id'])})
      SELECT src, id, CASE WHEN text IS NULL THEN 'null' WHEN text = '' THEN 'empty' ELSE 'ok' END AS status, CASE WHEN {j} THEN 'json' ELSE 'text' END AS input_type,
        CAST(length(text) AS INTEGER) AS input_size, CAST(length(sanitized) AS INTEGER) AS output_size, CASE WHEN {j} THEN json_valid(sanitized) END AS output_valid_json
      FROM docs JOIN s USING (src, id)"""


_CONTACT = "'call 10.1.'||cast(c_custkey % 200 as string)||'.9 or c'||cast(c_custkey as string)||'@shop.example.com'"


def sanitize_customers(spark, sf_dir):
    """All string columns of a table at once."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", f"{_CONTACT} AS contact", "c_acctbal")
    return sanitize_table(c, None, Q.FIXED_RULES)


def sanitize_customers_sql():
    part = {c: Q._fixed_sanitized_sql(f"SELECT c_custkey, {e} AS text FROM customer", ["c_custkey"]) for c, e in (("c_name", "c_name"), ("c_mktsegment", "c_mktsegment"), ("contact", _CONTACT))}
    joins = " ".join(f"JOIN ({s}) {c}_s USING (c_custkey)" for c, s in part.items())
    return f"SELECT c_custkey, {', '.join(f'{c}_s.sanitized AS {c}' for c in part)}, c_acctbal FROM customer {joins}"


# ---------------------------------------------------------------- audit

_AS_OF = dt.datetime(2024, 2, 5, 10, 0)


def audit_emergency(spark, sf_dir):
    """the ten newest entries."""
    return A.retain(Q._audit(spark, sf_dir), 10).select("id", "timestamp")


def audit_emergency_sql():
    return f'SELECT id, ts AS "timestamp" FROM ({Q._audit_sql()}) a ORDER BY ts DESC, id DESC LIMIT 10'


def audit_date_today(spark, sf_dir):
    """F5 'today'."""
    return A.date_filter(Q._audit(spark, sf_dir), "today", _AS_OF).select("id")


def audit_date_today_sql():
    return f"SELECT id FROM ({Q._audit_sql()}) a WHERE ts >= TIMESTAMP '2024-02-05 00:00:00'"


def audit_date_month(spark, sf_dir):
    """F5 'month'."""
    return A.date_filter(Q._audit(spark, sf_dir), "month", _AS_OF).select("id")


def audit_date_month_sql():
    return f"SELECT id FROM ({Q._audit_sql()}) a WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'"


def audit_filtered(spark, sf_dir):
    """date, term and changed entries together."""
    a = A.search(A.date_filter(Q._audit(spark, sf_dir), "month", _AS_OF), "example")
    return a.where(A.changed(a)).select("id", "detections_count")


def audit_filtered_sql():
    return f"""SELECT id, CAST(detections_count AS INTEGER) AS detections_count FROM ({Q._audit_sql()}) a WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'
      AND original_text IS DISTINCT FROM sanitized_text AND id IN ({Q.audit_search_sql()})"""


def audit_search_indexed(spark, sf_dir):
    """F6 by the trigram index: the rows of audit_search, from the blocks that can hold them."""
    path = _folder(spark, "log")
    audit_index.append_indexed(Q._audit(spark, sf_dir), path, 500)
    return audit_index.search_indexed(spark, path, "Example").select("id")


def audit_search_indexed_sql():
    return Q.audit_search_sql()


def audit_exported(spark, sf_dir):
    """The log exported as JSON and read back."""
    path = _folder(spark, "audit-json")
    IO.export_audit(Q._audit(spark, sf_dir), path)
    return spark.read.schema(A.AUDIT_SCHEMA).json(path).select("id", "detections_count", "sanitized_text")


def audit_exported_sql():
    return f"SELECT id, CAST(detections_count AS INTEGER) AS detections_count, sanitized_text FROM ({Q._audit_sql()}) a"


def backup_restored(spark, sf_dir):
    """Rules, words and log backed up, restored and counted."""
    path = _folder(spark, "backup")
    IO.backup(path, rules=_part_rules(spark, sf_dir), words=Q._part_words(spark, sf_dir), audit=Q._audit(spark, sf_dir))
    back = IO.restore(spark, path)
    one = [back[p].agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p in ("rules", "words", "history")]
    valid = back["rules"].where("validation.is_valid").agg(F.count("*").alias("n")).select(F.lit("valid rules").alias("part"), "n")
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(valid)


def backup_restored_sql():
    return f"""SELECT 'rules' AS part, count(*) AS n FROM part UNION ALL SELECT 'words', count(*) FROM {_WORDS_SQL} UNION ALL SELECT 'history', count(*) FROM documents
      UNION ALL SELECT 'valid rules', count(*) FROM ({rules_validated_sql()}) WHERE is_valid"""


NEW_RULES = [Q.FIXED_RULES[0], Q.CONFLICT_RULES[2], Rule(id="half_ip", type="regex", pattern=r"\b\d{1,3}\.\d{1,3}\b", flags="g", replacement="[N]", category="custom"),
             Rule(id="site", type="literal", pattern="example.com", replacement="[SITE]", category="custom", case_sensitive=False)]


def reprocess_changes(spark, sf_dir):
    """what changes in the log's detections under other rules."""
    c = reprocess.reprocess_changes(Q._audit(spark, sf_dir), NEW_RULES)
    names = lambda side: F.array_join(F.transform(side, lambda d: F.concat_ws(":", d["start"], d["end"], d["rule_id"])), ",").alias(side)
    return c.select("id", "start", "end", "change", names("old"), names("new"))


def reprocess_changes_sql():
    new = O.resolved(O.candidates(_DOCS, Q._rule_tuples(NEW_RULES), ["doc_id"]), ["doc_id"])
    # of overlapping detections replacements differ only where the rule or the place does: fakes are functions of the match
    side = lambda n: f"coalesce(string_agg(start || ':' || \"end\" || ':' || rule_id, ',' ORDER BY start) FILTER (WHERE side = {n}), '')"
    return f"""WITH d AS (SELECT 0 AS side, doc_id, start, "end", rule_id FROM ({_kept()}) o UNION ALL SELECT 1, doc_id, start, "end", rule_id FROM ({new}) n),
      f AS (SELECT *, start >= coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, side, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM d),
      g AS (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY start, side, "end") AS island FROM f),
      i AS (SELECT doc_id, island, min(start) AS start, max("end") AS "end", {side(0)} AS old, {side(1)} AS new FROM g GROUP BY doc_id, island)
      SELECT CAST(doc_id AS VARCHAR) AS id, start, "end", CASE WHEN old = '' THEN 'added' WHEN new = '' THEN 'removed' ELSE 'changed' END AS change, old, new FROM i WHERE old <> new"""


# a rule's text changes when its nation comes up: 2 days a nation, three rules in turn
_CHANGES = {"rule_id": "CASE n_nationkey % 3 WHEN 0 THEN 'fx_email' WHEN 1 THEN 'fx_ip' ELSE 'fx_card' END",
            "op": "CASE WHEN n_nationkey % 7 = 6 THEN 'delete' ELSE 'set' END", "label": "'as of '||n_name"}


def audit_rules_asof(spark, sf_dir):
    """B10/B15 over time: every detection of the log with the rule version that was valid then."""
    at = F.lit(Q.AUDIT_BASE) + F.make_dt_interval(days=(F.col("n_nationkey") * 2).cast("int"), hours=F.lit(5))
    changes = table(spark, sf_dir, "nation").select(*[F.expr(e).alias(c) for c, e in _CHANGES.items()], at.alias("changed_at"))
    found = Q._audit(spark, sf_dir).selectExpr("id", "timestamp", "inline_outer(detections)").where("start IS NOT NULL").select("id", "timestamp", "rule_id", "start")
    out = history.with_valid_rule(found, history.rule_versions(changes, ["rule_id"]), ["rule_id"])
    return out.select("id", "start", "rule_id", "label", "valid_from")


def audit_rules_asof_sql():
    changes = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _CHANGES.items()) + ", TIMESTAMP '2024-01-01 05:00:00' + to_days(CAST(n_nationkey * 2 AS INTEGER)) AS since FROM nation"
    return f"""WITH c AS ({changes}), d AS (SELECT CAST(doc_id AS VARCHAR) AS id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS ts, start, rule_id FROM ({_kept()}) k)
      SELECT d.id, d.start, d.rule_id, CASE WHEN op = 'set' THEN label END AS label, CASE WHEN op = 'set' THEN since END AS valid_from
      FROM d ASOF LEFT JOIN c ON d.rule_id = c.rule_id AND d.ts >= c.since"""


# ---------------------------------------------------------------- pseudonyms, statistics, exports

def replacement_map_incremental(spark, sf_dir):
    """E10 in runs: documents, then conversations, then documents again, with
    the version that each value came with."""
    path = _folder(spark, "pseudonyms")
    for name in ("documents", "conversations", "documents"):
        pseudonyms.update_pseudonyms(table(spark, sf_dir, name).select("text"), "text", default_rules(), path)
    return pseudonyms.read_pseudonyms(spark, path).select("rule_id", "match", "replacement", "version")


def replacement_map_incremental_sql():
    found = {k: f"SELECT DISTINCT rule_id, match, grp, tq FROM ({O.resolved(O.candidates(s, Q._rule_tuples(default_rules()), ks), ks)}) f"
             for k, s, ks in ((1, _DOCS, ["doc_id"]), (2, "SELECT conv_id, turn, text FROM conversations", ["conv_id", "turn"]))}
    first = "SELECT rule_id, match, grp, tq, min(version) AS version FROM (" + " UNION ALL ".join(f"SELECT *, {k} AS version FROM ({s}) z{k}" for k, s in found.items()) + ") GROUP BY ALL"
    return f"SELECT rule_id, match, repl AS replacement, CAST(version AS INTEGER) AS version FROM ({O.replaced(first, default_rules(), Q.key_branch)}) r"


def run_statistics(spark, sf_dir):
    """The statistics of two runs, taken while their results are written, added up."""
    runs = None
    for name, key in (("documents", "doc_id"), ("conversations", "turn")):
        s, seen = runstats.observed(sanitize(table(spark, sf_dir, name).select(key, "text"), "text", Q.FIXED_RULES), "text", name)
        stored(s.select(key, "sanitized"), "results")  # the run's own write is the only pass
        row = runstats.run_row(spark, seen, name)
        runs = row if runs is None else runs.unionByName(row)
    return runstats.summed(runs).select("runs", *runstats.COUNTS)


def run_statistics_sql():
    def one(source, keys):
        k = ", ".join(keys)
        return f"""SELECT text, sanitized, coalesce(n, 0) AS n FROM ({source}) s JOIN ({Q._fixed_sanitized_sql(source, keys)}) z USING ({k})
          LEFT JOIN (SELECT {k}, count(*) AS n FROM ({_kept(source, tuple(keys))}) f GROUP BY {k}) c USING ({k})"""
    t = "trim(text, ' \t\n\r')"
    j = f"coalesce((starts_with({t}, '{{') OR starts_with({t}, '[')) AND json_valid({t}), FALSE)"
    both = f"{one(_DOCS, ['doc_id'])} UNION ALL {one('SELECT conv_id, turn, text FROM conversations', ['conv_id', 'turn'])}"
    return f"""SELECT 2::BIGINT AS runs, count(*) AS rows, count(*) FILTER (WHERE n > 0) AS rows_with_detections, count(*) FILTER (WHERE text IS DISTINCT FROM sanitized) AS changed_rows,
      count(*) FILTER (WHERE {j}) AS json_rows, CAST(sum(n) AS BIGINT) AS detections, CAST(sum(n) AS BIGINT) AS replacements, CAST(sum(length(text)) AS BIGINT) AS input_chars,
      CAST(sum(length(sanitized)) AS BIGINT) AS output_chars FROM ({both}) b"""


def results_committed(spark, sf_dir):
    """Results exported with a commit, twice; the second is what readers see."""
    path = _folder(spark, "export")
    s = sanitize(Q._docs(spark, sf_dir), "text", Q.FIXED_RULES)
    committed.export_committed(s.select("doc_id", "sanitized").where("detections_count > 0"), path, "parquet")
    committed.export_committed(s.select("doc_id", "sanitized"), path, "json")
    return committed.read_committed(spark, path)


def results_committed_sql():
    return Q.sanitize_fixed_sql()


def results_exported(spark, sf_dir):
    """Results with their detections as JSON, and as csv with detections as text."""
    path = _folder(spark, "results")
    s = sanitize(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_CONTACT} AS text"), "text", Q.FIXED_RULES)
    IO.export_results(s.select("c_custkey", "sanitized", "detections"), f"{path}/json")
    IO.export_results(s.select("c_custkey", "sanitized", "detections"), f"{path}/csv", "csv")
    j = spark.read.json(f"{path}/json").selectExpr("c_custkey", "sanitized", "size(detections) AS n", "'json' AS format")
    c = spark.read.option("header", True).option("escape", "\\").schema("c_custkey long, sanitized string, detections string").csv(f"{path}/csv")
    return j.unionByName(c.selectExpr("c_custkey", "sanitized", "json_array_length(detections) AS n", "'csv' AS format"))


def results_exported_sql():
    src = f"SELECT c_custkey, {_CONTACT} AS text FROM customer"
    return f"""SELECT c_custkey, sanitized, CAST(coalesce(n, 0) AS INTEGER) AS n, format FROM ({Q._fixed_sanitized_sql(src, ['c_custkey'])}) s
      LEFT JOIN (SELECT c_custkey, count(*) AS n FROM ({_kept(src, ('c_custkey',))}) k GROUP BY c_custkey) c USING (c_custkey), (VALUES ('json'), ('csv')) f(format)"""


# ---------------------------------------------------------------- streams (H2, H3, F2 on a stream)

def _conversation_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    src = spark.readStream.schema(schema).parquet(stream_path(sf_dir, "conversations"))
    return src.withColumn("id", F.concat_ws("-", "conv_id", "turn")).withColumn("ts", F.lit(Q.AUDIT_BASE))


def stream_audit(spark, sf_dir):
    """H2: conversations streamed into an audit log."""
    path = _folder(spark, "audit-stream")
    audit_stream(spark, _conversation_stream(spark, sf_dir), "text", "id", "ts", Q.FIXED_RULES, path, f"query-{uuid.uuid4().hex}", available_now=True).awaitTermination()
    return A.read(spark, path).select("id", "sanitized_text", "detections_count")


def stream_trigger(spark, sf_dir):
    """H3: the same under the processing-time trigger that stands for the debounce."""
    path = _folder(spark, "audit-stream")
    q = audit_stream(spark, _conversation_stream(spark, sf_dir), "text", "id", "ts", Q.FIXED_RULES, path, f"query-{uuid.uuid4().hex}", trigger="200 milliseconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return A.read(spark, path).select("id", "sanitized_text", "detections_count")


def stream_trigger_sql():
    return stream_audit_sql()


def stream_audit_sql():
    keys = ["conv_id", "turn"]
    src = "SELECT conv_id, turn, text FROM conversations"
    return f"""SELECT concat_ws('-', conv_id, turn) AS id, sanitized AS sanitized_text, CAST(coalesce(n, 0) AS INTEGER) AS detections_count FROM ({Q._fixed_sanitized_sql(src, keys)}) s
      LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM ({_kept(src, tuple(keys))}) k GROUP BY ALL) c USING (conv_id, turn)"""


def stream_retain(spark, sf_dir):
    """F2 on a stream: the newest 100 entries of each profile, after two runs."""
    path, name = _folder(spark, "entries"), f"query-{uuid.uuid4().hex}"
    audit = Q._audit(spark, sf_dir).withColumn("profile_name", F.when(F.col("detections_count") > 0, F.lit("hits")).otherwise(F.lit("default")))
    for part in (F.pmod(F.xxhash64("id"), F.lit(2)) == 0, F.pmod(F.xxhash64("id"), F.lit(2)) == 1):
        audit.where(part).write.mode("append").parquet(path)
        src = spark.readStream.schema(A.AUDIT_SCHEMA).option("maxFilesPerTrigger", 3).parquet(path)
        retention.retain_stream(spark, src, name).awaitTermination()
    return retention.kept(spark, name).select("profile_name", "id", "timestamp")


def stream_retain_sql():
    return f"""SELECT profile_name, id, ts AS "timestamp" FROM (SELECT *, row_number() OVER (PARTITION BY profile_name ORDER BY ts DESC, id DESC) AS k FROM (
        SELECT CASE WHEN detections_count > 0 THEN 'hits' ELSE 'default' END AS profile_name, id, ts FROM ({Q._audit_sql()}) a)) WHERE k <= {FX.DEFAULT_MAX_HISTORY}"""


def registry():
    g = globals()
    names = [n[:-4] for n in g if n.endswith("_sql") and not n.startswith("_")]
    return {n: (g[n], g[n + "_sql"]()) for n in names}
