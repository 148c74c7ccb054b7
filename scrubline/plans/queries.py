"""Registered queries: each reads the given tables (or text Spark derives
from them), runs library operators over whole tables and whole texts, and
has -- where SQL can express it -- an independent DuckDB oracle.

Naming: ``detect_<pattern>`` (one per builtin, over documents plus planted
text), rule-engine queries (literal, regex, key-value, conflicts,
sanitize), scalar functions (hash, mask, JSON test, pseudonyms), audit
queries over an audit table derived from documents, nested columns, and a
Structured Streaming query.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline import fixed as FX
from scrubline.functions import rng as R
from scrubline.functions.generators import key_branch, mask_word_col
from scrubline.functions.sql_surface import register_detections
from scrubline.operators import audit as A
from scrubline.operators import islands
from scrubline.operators.detect import Options, candidate_rows, detect
from scrubline.operators.hits import explode_detections, js_regex_hits, pattern_hits
from scrubline.operators.json_text import sanitize_json
from scrubline.operators.nested import sanitize_nested
from scrubline.operators.patterns import BUILTIN_NAMES
from scrubline.operators.rules import Rule, default_rules
from scrubline.operators.sanitize import is_json, replacement_map, sanitize
from scrubline.operators.words import with_custom_words, words_from
from scrubline.plans import oracles as O
from scrubline.plans.inputs import documents_with_planted, oracle_documents_with_planted, stream_path, table

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------- rule sets
# Fixed-replacement rules (their output is exactly checkable in SQL).
FIXED_RULES = [
    Rule(id="fx_email", type="builtin", pattern="email", replacement="[EMAIL]", category="pii", ordinal=0),
    Rule(id="fx_ip", type="builtin", pattern="ip", replacement="[IP]", category="company", ordinal=1),
    Rule(id="fx_card", type="builtin", pattern="credit_card", replacement="[CARD]", category="pii", ordinal=2),
]
# token = "<40 hex>" in documents is hit by four rules of different priority.
CONFLICT_RULES = [
    Rule(id="kv_token", type="kv", pattern="token", replacement="REDACTED_TOKEN", category="secrets", ordinal=0),
    Rule(id="builtin_aws_secret_key", type="builtin", pattern="aws_secret_key", category="secrets", ordinal=1),
    Rule(id="builtin_hex_key", type="builtin", pattern="hex_key", category="secrets", ordinal=2),
    Rule(id="builtin_log_key_value", type="builtin", pattern="log_key_value", category="secrets", ordinal=3),
]
WORDS = {"company": ["elle"], "project": ["the"], "custom": ["tion"]}
# the rules that the oracle expects of these words
WORD_RULES = [
    Rule(id="custom_company_name", type="literal", pattern="elle", replacement="CompanyName", category="company", case_sensitive=False),
    Rule(id="custom_project_0", type="literal", pattern="the", replacement="ProjectName", category="company", case_sensitive=False),
    Rule(id="custom_word_0", type="literal", pattern="tion", replacement="[REDACTED]", category="custom", case_sensitive=False),
]
CUSTOM_REGEX = r"\b[A-Z][a-z]+tion\b"
AUDIT_BASE = dt.datetime(2024, 1, 1)
# queries that report spans or counts do not plan or run the generators
SPANS_ONLY = Options(generate_replacements=False)
AUDIT_AS_OF = dt.datetime(2024, 1, 21, 15, 30)


def _rule_tuples(rules: list[Rule]) -> list[tuple]:
    from scrubline.operators.rules import rank_rule_list
    out = []
    for rank, r in enumerate(rank_rule_list(rules)):
        extra = r.case_sensitive if r.type == "literal" else (r.flags if r.type == "regex" else None)
        out.append((rank, r.id, r.type, r.pattern, extra))
    return out


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# ---------------------------------------------------------------- builtins

def _detect_builtin(name: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Hits of one builtin detector over documents plus planted text."""
        return pattern_hits(documents_with_planted(spark, sf_dir, name), "text", name, ["src", "doc_id"])
    return q


def _detect_builtin_sql(name: str) -> str:
    return O.builtin_hits(oracle_documents_with_planted(name), name, ["src", "doc_id"])


# ---------------------------------------------------------------- rule engine

def detect_literal_ci(spark, sf_dir):
    """Custom words (company, project, word) as case-insensitive literal
    rules over documents; resolved detections, one row per detection."""
    d = detect(_docs(spark, sf_dir), "text", with_custom_words([], WORDS))
    return explode_detections(d, ["doc_id"]).select("doc_id", "rule_id", "start", "end", "match", "replacement")


def detect_literal_ci_sql():
    keys = ["doc_id"]
    kept = O.resolved(O.candidates("SELECT doc_id, text FROM documents", _rule_tuples(WORD_RULES), keys), keys)
    repl = {r.id: r.replacement for r in WORD_RULES}
    case = "CASE " + " ".join(f"WHEN rule_id = {O.lit(k)} THEN {O.lit(v)}" for k, v in repl.items()) + " END"
    return f'SELECT doc_id, rule_id, start, "end", match, {case} AS replacement FROM ({kept}) k'


def detect_words_nation(spark, sf_dir):
    """Custom words taken from a table (nation names), detected in documents
    and in a line about every nation: hits by word."""
    words = words_from(table(spark, sf_dir, "nation"), "n_name", "project")
    text = _docs(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "nation").select(
        F.concat_ws(" ", F.lit("from"), "n_name", F.lit("and"), F.initcap("n_name")).alias("text")))
    d = detect(text, "text", with_custom_words([], words), SPANS_ONLY)
    return explode_detections(d, ["text"]).groupBy(F.lower("match").alias("word")).agg(F.count("*").alias("hits"))


def detect_words_nation_sql():
    return """WITH t AS (SELECT text FROM documents UNION ALL SELECT 'from ' || n_name || ' and ' || upper(n_name[1]) || lower(n_name[2:]) FROM nation),
      p AS (SELECT '(?i)' || string_agg(lower(n_name), '|' ORDER BY lower(n_name)) AS re FROM nation),
      h AS (SELECT unnest(regexp_extract_all(t.text, p.re)) AS m FROM t, p)
      SELECT lower(m) AS word, count(*) AS hits FROM h GROUP BY 1"""


def _part_words(spark, sf_dir):
    """A word table that grows with ``part``: nations, part names, one word a part."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    row = lambda word, cat, place: [F.lower(word).alias("word"), F.lit(cat).alias("word_category"), F.col(place).cast("int").alias("ordinal")]
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("p"))
    return (nation.select(*row(F.col("n_name"), "competitor", "n_nationkey")).unionByName(names.select(*row(F.col("p_name"), "project", "p")))
            .unionByName(part.select(*row(F.concat(F.lit("sku"), F.col("p_partkey").cast("string")), "custom", "p_partkey"))))


_PART_LINE = "'SKU'||cast(p_partkey as string)||' is a '||upper(p_name)||' from Nation_'||cast(p_partkey % 25 as string)"


def detect_words_part(spark, sf_dir):
    """A word list that grows with the data (past MAX_RULES at larger
    scales), found by the automaton in documents and in a line about each
    part; resolved detections with their replacements."""
    text = _docs(spark, sf_dir).select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text").unionByName(
        table(spark, sf_dir, "part").selectExpr("'part' AS src", "p_partkey AS id", f"{_PART_LINE} AS text"))
    d = detect(text, "text", [], words=_part_words(spark, sf_dir))
    return explode_detections(d, ["src", "id"]).select("src", "id", "rule_id", "start", "end", "match", "replacement")


def detect_words_part_sql():
    keys = ["src", "id"]
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cands = f"""
      SELECT src, id, rank, sub, CAST(i - 1 AS INTEGER) AS seq, start, start + n AS "end", 2000 AS prio, substr(text, start + 1, n) AS match, rule_id FROM (
        SELECT *, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + (i - 1) * n AS INTEGER) AS start FROM (
          SELECT *, unnest(range(1, len(gs))) AS i FROM (
            SELECT t.*, w.*, length(w.word) AS n, string_split(t.low, w.word) AS gs FROM part_text t JOIN part_words w ON contains(t.low, w.word))))"""
    kept = O.resolved(cands, keys)
    return f"""WITH part_text AS MATERIALIZED (SELECT *, {low.format('text')} AS low FROM (
        SELECT 'doc' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'part', p_partkey, {_PART_LINE} FROM part)),
      part_words AS MATERIALIZED (SELECT word, rank, CAST(o AS INTEGER) AS sub, prefix || o AS rule_id FROM (
        SELECT lower(n_name) AS word, 1 AS rank, n_nationkey AS o, 'custom_competitor_' AS prefix FROM nation
        UNION ALL SELECT lower(p_name), 2, min(p_partkey), 'custom_project_' FROM part GROUP BY p_name
        UNION ALL SELECT 'sku' || p_partkey, 3, p_partkey, 'custom_word_' FROM part))
      SELECT src, id, rule_id, start, "end", match,
        CASE rank WHEN 1 THEN 'CompetitorName' WHEN 2 THEN 'ProjectName' ELSE '[REDACTED]' END AS replacement FROM ({kept}) k"""


def detect_regex_custom(spark, sf_dir):
    """A user regex rule (global) over documents: every match."""
    return js_regex_hits(_docs(spark, sf_dir), "text", CUSTOM_REGEX, "g", ["doc_id"])


def detect_regex_custom_sql():
    return O.hits("SELECT doc_id, text FROM documents", RX_re2(CUSTOM_REGEX, "g"), ["doc_id"])


def detect_regex_first(spark, sf_dir):
    """The same regex without the g flag: the first match only."""
    return js_regex_hits(_docs(spark, sf_dir), "text", CUSTOM_REGEX, "m", ["doc_id"])


def detect_regex_first_sql():
    return O.hits("SELECT doc_id, text FROM documents", RX_re2(CUSTOM_REGEX, "m"), ["doc_id"], first_only=True)


def RX_re2(p, f):
    from scrubline.functions.regex import to_re2
    return to_re2(p, f).pattern


def detect_kv_token(spark, sf_dir):
    """The key-value rule for 'token' (15 templates, de-duplicated, value
    filters) over documents; resolved spans."""
    rules = [CONFLICT_RULES[0]]
    d = detect(_docs(spark, sf_dir), "text", rules, SPANS_ONLY)
    return explode_detections(d, ["doc_id"]).select("doc_id", "start", "end", "match")


def detect_kv_token_sql():
    keys = ["doc_id"]
    kept = O.resolved(O.candidates("SELECT doc_id, text FROM documents", _rule_tuples([CONFLICT_RULES[0]]), keys), keys)
    return f'SELECT doc_id, start, "end", match FROM ({kept}) k'


def sanitize_kv_token(spark, sf_dir):
    """Documents sanitized by the 'token' key-value rule: each value is
    swapped (by its span) for a fake seeded by the value."""
    return sanitize(_docs(spark, sf_dir), "text", [CONFLICT_RULES[0]]).select("doc_id", "sanitized")


def sanitize_kv_token_sql():
    keys = ["doc_id"]
    src = "SELECT doc_id, text FROM documents"
    kept = O.resolved(O.candidates(src, _rule_tuples([CONFLICT_RULES[0]]), keys), keys)
    return O.spliced(src, kept, keys, O.kv_secret_token_replacement())


def resolve_conflicts(spark, sf_dir):
    """Four overlapping rules (kv 1000, aws_secret_key 3014, hex_key 3017,
    log_key_value 3999): the surviving detection per span."""
    d = detect(_docs(spark, sf_dir), "text", CONFLICT_RULES, SPANS_ONLY)
    return explode_detections(d, ["doc_id"]).select("doc_id", "rule_id", "start", "end", "match")


def resolve_conflicts_sql():
    keys = ["doc_id"]
    kept = O.resolved(O.candidates("SELECT doc_id, text FROM documents", _rule_tuples(CONFLICT_RULES), keys), keys)
    return f'SELECT doc_id, rule_id, start, "end", match FROM ({kept}) k'


def resolve_islands(spark, sf_dir):
    """The same conflicts resolved on candidate rows, island by island."""
    rows = candidate_rows(_docs(spark, sf_dir), "text", CONFLICT_RULES, ["doc_id"])
    return islands.resolve_islands(rows, ["doc_id"]).select("doc_id", "rule_id", "start", "end", "match")


resolve_islands_sql = resolve_conflicts_sql


def overlap_pairs(spark, sf_dir):
    """How often the four conflicting rules' candidates overlap."""
    from scrubline.operators.detect import overlap_pairs as op
    return op(_docs(spark, sf_dir), "text", CONFLICT_RULES)


def overlap_pairs_sql():
    keys = ["doc_id"]
    return O.overlap_pairs(O.candidates("SELECT doc_id, text FROM documents", _rule_tuples(CONFLICT_RULES), keys), keys)


def _fixed_repl_case():
    return "CASE " + " ".join(f"WHEN rule_id = {O.lit(r.id)} THEN {O.lit(r.replacement)}" for r in FIXED_RULES) + " END"


def _fixed_sanitized_sql(source_sql: str, keys: list[str], text: str = "text") -> str:
    kept = O.resolved(O.candidates(source_sql, _rule_tuples(FIXED_RULES), keys), keys)
    return O.spliced(source_sql, kept, keys, _fixed_repl_case(), text)


def sanitize_fixed(spark, sf_dir):
    """Documents sanitized with fixed replacements for email, IP and card."""
    return sanitize(_docs(spark, sf_dir), "text", FIXED_RULES).select("doc_id", "sanitized")


def sanitize_fixed_sql():
    return _fixed_sanitized_sql("SELECT doc_id, text FROM documents", ["doc_id"])


def sanitize_fixed_pages(spark, sf_dir):
    """Raw web pages sanitized with the fixed-replacement rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return sanitize(pages, "text", FIXED_RULES).select("page_id", "sanitized")


def sanitize_fixed_pages_sql():
    return _fixed_sanitized_sql("SELECT page_id, html AS text FROM pages", ["page_id"])


def sanitize_words(spark, sf_dir):
    """Custom words (generic strategy) sanitized out of documents."""
    return sanitize(_docs(spark, sf_dir), "text", with_custom_words([], WORDS)).select("doc_id", "sanitized")


def sanitize_words_sql():
    keys = ["doc_id"]
    src = "SELECT doc_id, text FROM documents"
    rules = WORD_RULES
    kept = O.resolved(O.candidates(src, _rule_tuples(rules), keys), keys)
    case = "CASE " + " ".join(f"WHEN rule_id = {O.lit(r.id)} THEN {O.lit(r.replacement)}" for r in rules) + " END"
    return O.spliced(src, kept, keys, case)


def sanitize_default(spark, sf_dir):
    """Documents under the 60 default rules: sanitized text and counts."""
    return sanitize(_docs(spark, sf_dir), "text", default_rules()).select(
        "doc_id", "sanitized", "detections_count", "patterns_replaced", "status", "input_type")


def sanitize_default_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return sanitize(pages, "html", default_rules()).select("page_id", "sanitized", "detections_count")


def sanitize_default_conversations(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return sanitize(conv, "text", default_rules()).select("conv_id", "turn", "sanitized", "detections_count")


def sanitize_default_sql():
    keys = ["doc_id"]
    src = "SELECT doc_id, text FROM documents"
    kept = O.resolved(O.candidates(src, _rule_tuples(default_rules()), keys), keys)
    spliced = O.spliced(src, O.replaced("SELECT * FROM found", default_rules(), key_branch), keys, "repl")
    t = "trim(text, ' \t\n\r')"
    return f"""WITH found AS MATERIALIZED ({kept}), s AS ({spliced}),
      n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM found GROUP BY doc_id)
      SELECT d.doc_id, s.sanitized, coalesce(n.n, 0) AS detections_count, coalesce(n.n, 0) AS patterns_replaced,
        CASE WHEN text IS NULL THEN 'null' WHEN text = '' THEN 'empty' ELSE 'ok' END AS status,
        CASE WHEN coalesce((starts_with({t}, '{{') OR starts_with({t}, '[')) AND json_valid({t}), FALSE) THEN 'json' ELSE 'text' END AS input_type
      FROM documents d JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)"""


def detect_default(spark, sf_dir):
    """All 60 default rules over documents: every resolved detection."""
    d = detect(_docs(spark, sf_dir), "text", default_rules(), SPANS_ONLY)
    return explode_detections(d, ["doc_id"]).select("doc_id", "rule_id", "start", "end", "match")


def detect_default_sql():
    keys = ["doc_id"]
    kept = O.resolved(O.candidates("SELECT doc_id, text FROM documents", _rule_tuples(default_rules()), keys), keys)
    return f'SELECT doc_id, rule_id, start, "end", match FROM ({kept}) k'


def detect_default_planted(spark, sf_dir):
    """All 60 default rules over the planted text of every builtin: the
    resolved detections, including cross-pattern conflicts."""
    from scrubline.plans.inputs import all_planted
    d = detect(all_planted(spark, sf_dir), "text", default_rules(), SPANS_ONLY)
    return explode_detections(d, ["src", "doc_id"]).select("src", "doc_id", "rule_id", "start", "end", "match")


def detect_default_planted_sql():
    from scrubline.plans.inputs import oracle_all_planted
    keys = ["src", "doc_id"]
    kept = O.resolved(O.candidates("SELECT * FROM planted_src", _rule_tuples(default_rules()), keys), keys)
    return (f"WITH planted_src AS MATERIALIZED ({oracle_all_planted()}) "
            f'SELECT src, doc_id, rule_id, start, "end", match FROM ({kept}) k')


def sql_detections(spark, sf_dir):
    """The detections of all documents under the default rules, asked for
    in SQL alone."""
    register_detections(spark, default_rules(), SPANS_ONLY)
    _docs(spark, sf_dir).createOrReplaceTempView("scrub_documents")
    return spark.sql("SELECT d.doc_id, t.rule_id, t.start, t.`end`, t.match FROM scrub_documents d, LATERAL scrub_detections(d.text) t")


sql_detections_sql = detect_default_sql


def rule_hit_counts(spark, sf_dir):
    """B16 over a table: resolved detections per rule under the default
    rules (a partial aggregate on a handful of keys)."""
    d = detect(_docs(spark, sf_dir), "text", default_rules(), SPANS_ONLY)
    return explode_detections(d, ["doc_id"]).groupBy("rule_id", "category").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- functions

def pseudonym_email(spark, sf_dir):
    """Distinct e-mail values in documents and their fakes."""
    h = pattern_hits(_docs(spark, sf_dir), "text", "email", ["doc_id"]).select("match").distinct()
    from scrubline.functions.generators import builtin_fake_col
    return h.select("match", builtin_fake_col("match", "email").alias("fake"))


def pseudonym_email_sql():
    hits = O.builtin_hits("SELECT doc_id, text FROM documents", "email", ["doc_id"])
    v = O.rng_first_values_sql(O.js_hash_sql("match"), 1)
    return (f"SELECT match, 'user' || CAST(CAST(floor({v}[1] * 9000) + 1000 AS BIGINT) AS VARCHAR) || '@example.com' AS fake "
            f"FROM (SELECT DISTINCT match FROM ({hits}) h) d")


FAKE_PATTERNS = [p for p in BUILTIN_NAMES if p != "email"]  # email has a query of its own


def _pseudonym(pattern: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        """E10 for one builtin: distinct values in documents plus planted
        text and their format-preserving fakes."""
        from scrubline.functions.generators import builtin_fake_col
        h = pattern_hits(documents_with_planted(spark, sf_dir, pattern), "text", pattern, ["src", "doc_id"])
        return h.select("match").distinct().select("match", builtin_fake_col("match", pattern).alias("fake"))
    return q


KV_RULES = [r for r in default_rules() if r.type == "kv"]
# a key-value pair of every key and document, in one of five forms with one of three values
_KV_VALUE = "(CASE doc_id % 3 WHEN 0 THEN md5(cast(doc_id as string)) WHEN 1 THEN 'sk_'||md5(cast(doc_id as string)) ELSE 'Pw9x'||cast(doc_id as string)||'z' END)"
_KV_TEXT = (f"CASE doc_id % 5 WHEN 0 THEN 'x \"'||k||'\": \"'||{_KV_VALUE}||'\" y' WHEN 1 THEN 'x '||k||': '||{_KV_VALUE}||', y' "
            f"WHEN 2 THEN 'x '||upper(k)||'='||{_KV_VALUE}||' y' WHEN 3 THEN 'x my'||k||' = '||{_KV_VALUE}||'; y' "
            f"ELSE 'x '||k||'=\"'||{_KV_VALUE}||'\" y' END")
_KV_KEYS = ", ".join(f"'{r.pattern}'" for r in KV_RULES)


def sanitize_kv_keys(spark, sf_dir):
    """Pairs of all 15 keys, planted for each document in five
    forms, sanitized by the 15 key-value rules."""
    pairs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"explode(array({_KV_KEYS})) AS k").selectExpr("k", "doc_id", f"{_KV_TEXT} AS text")
    return sanitize(pairs, "text", KV_RULES).select("k", "doc_id", "sanitized")


def _sanitized_by(source: str, rules: list[Rule], keys: list[str]) -> str:
    """The source's texts sanitized by builtin and key-value rules, in DuckDB."""
    kept = O.resolved(O.candidates(source, _rule_tuples(rules), keys), keys)
    return O.spliced(source, O.replaced(kept, rules, key_branch), keys, "repl")


def sanitize_kv_keys_sql():
    return (f"WITH kv_pairs AS MATERIALIZED (SELECT k, doc_id, {_KV_TEXT} AS text FROM (SELECT doc_id, unnest([{_KV_KEYS}]) AS k FROM documents)) "
            f"SELECT k, doc_id, sanitized FROM ({_sanitized_by('SELECT * FROM kv_pairs', KV_RULES, ['k', 'doc_id'])}) z")


_PATHS = "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/a/./b' WHEN 3 THEN '/a/../b/..' WHEN 4 THEN '/..' WHEN 5 THEN '/x/%2e%2E/y/.' WHEN 6 THEN '/.../a.b/' WHEN 7 THEN '/../../q' ELSE '/d'||doc_id END"
_URLS = {"internal_url": "'https://api.dev.acme'||doc_id||'.com:80'", "database_connection": "'postgresql://u:p@db'||doc_id||':5432'", "redis_url": "'redis://cache'||doc_id", "rabbitmq_url": "'amqps://u:p@mq'||doc_id"}


def pseudonym_url_paths(spark, sf_dir):
    """Fakes of URLs whose paths hold dot segments, one of each kind a document."""
    from scrubline.functions.generators import builtin_fake_col
    docs = table(spark, sf_dir, "documents")
    out = None
    for kind, head in _URLS.items():
        one = docs.selectExpr(f"{head}||{_PATHS} AS match").select(F.lit(kind).alias("kind"), "match", builtin_fake_col("match", kind).alias("fake"))
        out = one if out is None else out.unionByName(one)
    return out


def pseudonym_url_paths_sql():
    parts = []
    for kind, head in _URLS.items():
        n, expr = O.fake_sql(kind)
        v = O.rng_first_values_sql(O.js_hash_sql("match"), n)
        parts.append(f"SELECT '{kind}' AS kind, match, {expr} AS fake FROM (SELECT match, {v} AS v FROM (SELECT {head}||{_PATHS} AS match FROM documents) a) b")
    return " UNION ALL ".join(parts)


def preserve_shape(spark, sf_dir):
    """The shape-preserving fakes of part names, customer names and
    document starts."""
    words = (table(spark, sf_dir, "part").select(F.col("p_name").alias("s")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("s")))
             .unionByName(_docs(spark, sf_dir).select(F.substring("text", 1, 60).alias("s"))))
    return words.where("s IS NOT NULL").distinct().select("s", R.preserve_shape_col("s").alias("shaped"))


def preserve_shape_sql():
    return ("WITH src0 AS (SELECT DISTINCT s FROM (SELECT p_name AS s FROM part UNION ALL SELECT c_name FROM customer UNION ALL "
            f"SELECT substr(text, 1, 60) FROM documents) w WHERE s IS NOT NULL) SELECT s, shaped FROM ({O.preserve_shape_sql()}) z")


def safe_hash(spark, sf_dir):
    """G1 over whole document texts."""
    return _docs(spark, sf_dir).select("doc_id", R.js_hash_col("text").alias("h"))


def safe_hash_sql():
    return f"SELECT doc_id, {O.js_hash_sql('text')} AS h FROM documents"


def mask_word(spark, sf_dir):
    """G11 over customer names."""
    return table(spark, sf_dir, "customer").select("c_custkey", mask_word_col("c_name").alias("masked"))


def mask_word_sql():
    return f"SELECT c_custkey, {O.mask_word_sql('c_name')} AS masked FROM customer"


def is_json_events(spark, sf_dir):
    """E4 over event properties."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", is_json(F.col("props")).alias("is_json"))


def is_json_events_sql():
    ws = "' \t\n\r'"
    t = f"trim(props, {ws})"
    return (f"SELECT event_id, coalesce((starts_with({t}, '{{') OR starts_with({t}, '[')) AND json_valid({t}), FALSE) "
            f"AS is_json FROM events")


# JSON text with keys, nested values, escapes and a whole document in it
_BS, _NL = "chr(92)", "chr(10)"
_ESCAPED = (f"replace(replace(replace(replace(replace(text, {_BS}, {_BS}||{_BS}), '\"', {_BS}||'\"'), {_NL}, {_BS}||'n'), chr(9), {_BS}||'t'), chr(13), {_BS}||'r')")
_MADE_JSON = (f"""'{{"id": '||cast(doc_id as string)||', "who@key.example.com": "u'||cast(doc_id as string)||'@mail.example.com", "n": [1.50, null, """
              f"""{{"ip" : "10.0.'||cast(doc_id % 256 as string)||'.7", "say": "to '||{_BS}||'"b'||cast(doc_id as string)||'@c.de'||{_BS}||'" '||{_BS}||'u0021"}}], """
              f""""text": "'||{_ESCAPED}||'"}}'""")


def sanitize_json_text(spark, sf_dir):
    """JSON text of no known shape, the event properties and an object
    made of each document, with its string values sanitized."""
    made = _docs(spark, sf_dir).where("text IS NOT NULL").selectExpr("'doc' AS src", "doc_id AS id", f"{_MADE_JSON} AS json")
    props = table(spark, sf_dir, "events").selectExpr("'event' AS src", "event_id AS id", "props AS json")
    return sanitize_json(made.unionByName(props), "json", FIXED_RULES).select("src", "id", "sanitized", "output_valid_json")


def sanitize_json_text_sql():
    string = r"""'"(?:[^"\\]|\\.)*"'"""
    keys = ["src", "id", "pos"]
    return f"""WITH j AS MATERIALIZED (SELECT *, regexp_extract_all(x, {string}) AS m, regexp_split_to_array(x, {string}) AS g FROM (
        SELECT 'doc' AS src, doc_id AS id, {_MADE_JSON} AS x FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'event', event_id, props FROM events)),
      l AS MATERIALIZED (SELECT src, id, pos, m[pos] AS lit, g[pos] AS gap, starts_with(ltrim(g[pos + 1]), ':') AS is_key
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS pos FROM j)),
      leaf AS MATERIALIZED (SELECT src, id, pos, json_extract_string('[' || lit || ']', '$[0]') AS text FROM l WHERE NOT is_key),
      s AS ({_fixed_sanitized_sql('SELECT * FROM leaf', keys)}),
      p AS (SELECT l.src, l.id, string_agg(gap || CASE WHEN is_key OR s.sanitized = leaf.text THEN lit ELSE CAST(to_json(s.sanitized) AS VARCHAR) END, '' ORDER BY pos) AS head
        FROM l LEFT JOIN leaf USING (src, id, pos) LEFT JOIN s USING (src, id, pos) GROUP BY l.src, l.id)
      SELECT src, id, coalesce(p.head || j.g[len(j.g)], j.x) AS sanitized, TRUE AS output_valid_json FROM j LEFT JOIN p USING (src, id)"""


# ---------------------------------------------------------------- audit

def _audit(spark, sf_dir) -> DataFrame:
    """The audit table: documents sanitized with the fixed rules, one entry
    per document (timestamp = base + doc_id hours), appended to a table
    under the shared checkpoint folder and read back like a stored log."""
    import uuid
    from scrubline.session import checkpoint_dir
    docs = _docs(spark, sf_dir)
    s = sanitize(docs, "text", FIXED_RULES)
    ts = F.lit(AUDIT_BASE) + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    path = checkpoint_dir(spark).rstrip("/") + f"/audit-{uuid.uuid4().hex}"
    A.append(A.audit_entries(s, F.col("doc_id"), ts, "text"), path)
    return A.read(spark, path)


def _audit_sql() -> str:
    keys = ["doc_id"]
    src = "SELECT doc_id, text FROM documents"
    kept = O.resolved(O.candidates(src, _rule_tuples(FIXED_RULES), keys), keys)
    san = O.spliced(src, kept, keys, _fixed_repl_case())
    return f"""
    SELECT CAST(d.doc_id AS VARCHAR) AS id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INTEGER)) AS ts,
           d.text AS original_text, s.sanitized AS sanitized_text, coalesce(n.cnt, 0) AS detections_count
    FROM documents d JOIN ({san}) s USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS cnt FROM ({kept}) k GROUP BY doc_id) n USING (doc_id)"""


def audit_stats(spark, sf_dir):
    return A.audit_stats(_audit(spark, sf_dir))


def audit_stats_sql():
    return f"""SELECT count(*) AS entries, coalesce(sum(detections_count), 0) AS total_detections,
      count(*) FILTER (WHERE original_text IS DISTINCT FROM sanitized_text) AS modified_entries,
      CASE WHEN count(*) > 0 THEN round(sum(detections_count) / count(*), 1) ELSE 0.0 END AS avg_detections,
      min(ts) AS first_ts, max(ts) AS last_ts FROM ({_audit_sql()}) a"""


def audit_search(spark, sf_dir):
    """entries mentioning 'example' (text, sanitized text or detections)."""
    return A.search(_audit(spark, sf_dir), "example").select("id")


def audit_search_sql():
    keys = ["doc_id"]
    src = "SELECT doc_id, text FROM documents"
    kept = O.resolved(O.candidates(src, _rule_tuples(FIXED_RULES), keys), keys)
    names = "CASE " + " ".join(f"WHEN rule_id = {O.lit(r.id)} THEN {O.lit(r.name or r.pattern)}" for r in FIXED_RULES) + " END"
    return f"""SELECT a.id FROM ({_audit_sql()}) a
      WHERE contains(lower(a.original_text), 'example') OR contains(lower(a.sanitized_text), 'example')
         OR a.id IN (SELECT CAST(doc_id AS VARCHAR) FROM ({kept}) k
                     WHERE contains(lower({names}), 'example') OR contains(lower(match), 'example'))"""


def audit_page(spark, sf_dir):
    """page 3 (10 per page) of the newest-first history."""
    return A.page(_audit(spark, sf_dir), 3).select("id", "timestamp")


def audit_page_sql():
    return f'SELECT id, ts AS "timestamp" FROM ({_audit_sql()}) a ORDER BY ts DESC, id DESC LIMIT 10 OFFSET 20'


def audit_retain(spark, sf_dir):
    """the newest 100 entries."""
    return A.retain(_audit(spark, sf_dir), FX.DEFAULT_MAX_HISTORY).select("id", "timestamp")


def audit_retain_sql():
    return f'SELECT id, ts AS "timestamp" FROM ({_audit_sql()}) a ORDER BY ts DESC, id DESC LIMIT {FX.DEFAULT_MAX_HISTORY}'


def audit_date_week(spark, sf_dir):
    """F5 'week' relative to a fixed as-of time."""
    return A.date_filter(_audit(spark, sf_dir), "week", AUDIT_AS_OF).select("id")


def audit_date_week_sql():
    as_of = AUDIT_AS_OF
    midnight = dt.datetime(as_of.year, as_of.month, as_of.day) - dt.timedelta(days=7)
    return f"SELECT id FROM ({_audit_sql()}) a WHERE ts >= TIMESTAMP '{midnight:%Y-%m-%d %H:%M:%S}'"


def audit_delete(spark, sf_dir):
    """delete by id -- the ids of entries without detections, as a
    table, removed with a left-anti join."""
    audit = _audit(spark, sf_dir)
    ids = audit.where(F.col("detections_count") == 0).select("id")
    return A.delete(audit, ids).select("id", "detections_count")


def audit_delete_sql():
    return f"SELECT id, detections_count FROM ({_audit_sql()}) a WHERE detections_count > 0"


def audit_by_category(spark, sf_dir):
    """detections per (category, rule) over the audit table."""
    return A.by_category(_audit(spark, sf_dir))


def audit_by_category_sql():
    keys = ["doc_id"]
    kept = O.resolved(O.candidates("SELECT doc_id, text FROM documents", _rule_tuples(FIXED_RULES), keys), keys)
    cat = "CASE " + " ".join(f"WHEN rule_id = {O.lit(r.id)} THEN {O.lit(r.category)}" for r in FIXED_RULES) + " END"
    return f"SELECT {cat} AS category, rule_id, count(*) AS n FROM ({kept}) k GROUP BY ALL"


# ---------------------------------------------------------------- nested / streaming

def sanitize_nested_customer(spark, sf_dir):
    """String leaves of a struct column sanitized in place."""
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"),
                              F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal")).alias("seg"))
        .alias("info"))
    out = sanitize_nested(cust, "info", FIXED_RULES)
    return out.select("c_custkey", F.col("info.name").alias("name"), F.col("info.seg.segment").alias("segment"),
                      F.col("info.seg.bal").alias("bal"))


def sanitize_nested_customer_sql():
    name = _fixed_sanitized_sql("SELECT c_custkey, c_name AS text FROM customer", ["c_custkey"])
    seg = _fixed_sanitized_sql("SELECT c_custkey, c_mktsegment AS text FROM customer", ["c_custkey"])
    return f"""SELECT c.c_custkey, n.sanitized AS name, s.sanitized AS segment, c.c_acctbal AS bal
      FROM customer c JOIN ({name}) n USING (c_custkey) JOIN ({seg}) s USING (c_custkey)"""


def stream_sanitize(spark, sf_dir):
    """H1: conversations read as a file stream, sanitized per micro-batch
    (stateless), written with an exactly-once file sink; returns the sink."""
    import uuid
    from scrubline.streaming.stream import run_file_stream
    return run_file_stream(spark, stream_path(sf_dir, "conversations"), "text", FIXED_RULES, keys=["conv_id", "turn"],
                           name=f"query-{uuid.uuid4().hex}").select("conv_id", "turn", "sanitized")


def stream_sanitize_sql():
    return _fixed_sanitized_sql("SELECT conv_id, turn, text FROM conversations", ["conv_id", "turn"])


def replacement_map_default(spark, sf_dir):
    """Every distinct value that the default rules find in documents,
    with its replacement."""
    return replacement_map(_docs(spark, sf_dir), "text", default_rules()).select("rule_id", "match", "replacement")


def _default_found(source: str, keys: list[str]) -> str:
    return O.resolved(O.candidates(source, _rule_tuples(default_rules()), keys), keys)


def _sanitize_default_sql(table_: str, keys: list[str], text: str) -> str:
    src = f"SELECT {', '.join(keys)}, {text} AS text FROM {table_}"
    k = ", ".join(keys)
    spliced = O.spliced(src, O.replaced("SELECT * FROM found", default_rules(), key_branch), keys, "repl")
    return f"""WITH found AS MATERIALIZED ({_default_found(src, keys)}), s AS ({spliced})
      SELECT {k}, s.sanitized, CAST(coalesce(n.n, 0) AS INTEGER) AS detections_count
      FROM s LEFT JOIN (SELECT {k}, count(*) AS n FROM found GROUP BY {k}) n USING ({k})"""


def sanitize_default_pages_sql():
    return _sanitize_default_sql("pages", ["page_id"], "html")


def sanitize_default_conversations_sql():
    return _sanitize_default_sql("conversations", ["conv_id", "turn"], "text")


def rule_hit_counts_sql():
    cat = "CASE rule_id " + " ".join(f"WHEN {O.lit(r.id)} THEN {O.lit(r.category)}" for r in default_rules()) + " END"
    return f"SELECT rule_id, {cat} AS category, count(*) AS n FROM ({_default_found('SELECT doc_id, text FROM documents', ['doc_id'])}) k GROUP BY ALL"


def replacement_map_default_sql():
    found = _default_found("SELECT doc_id, text FROM documents", ["doc_id"])
    distinct = f"SELECT DISTINCT rule_id, match, grp, tq FROM ({found}) f"
    return f"SELECT rule_id, match, repl AS replacement FROM ({O.replaced(distinct, default_rules(), key_branch)}) r"


# ---------------------------------------------------------------- registry

def registry() -> dict[str, tuple[Query, str | None]]:
    reg: dict[str, tuple[Query, str | None]] = {}
    for name in BUILTIN_NAMES:
        reg[f"detect_{name}"] = (_detect_builtin(name), _detect_builtin_sql(name))
    g = globals()
    for qn in ("detect_literal_ci", "detect_words_nation", "detect_words_part", "detect_regex_custom", "detect_regex_first", "detect_kv_token",
               "sanitize_kv_token", "resolve_conflicts", "resolve_islands", "overlap_pairs", "detect_default", "sql_detections", "detect_default_planted", "sanitize_default", "sanitize_kv_keys", "pseudonym_url_paths", "preserve_shape", "sanitize_fixed", "sanitize_fixed_pages", "sanitize_words", "pseudonym_email",
               "safe_hash", "mask_word", "is_json_events", "sanitize_json_text", "audit_stats", "audit_search", "audit_page",
               "audit_retain", "audit_date_week", "audit_delete", "audit_by_category", "sanitize_nested_customer",
               "stream_sanitize", "sanitize_default_pages", "sanitize_default_conversations", "rule_hit_counts", "replacement_map_default"):
        reg[qn] = (g[qn], g[qn + "_sql"]())
    for p in FAKE_PATTERNS:
        reg[f"pseudonym_{p}"] = (_pseudonym(p), O.pseudonyms(oracle_documents_with_planted(p), p, ["src", "doc_id"]))
    return reg
