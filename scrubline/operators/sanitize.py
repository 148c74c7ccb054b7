"""Sanitizing operators.

``sanitize`` = detect -> keep selected rules' detections (after conflict
resolution) -> splice replacements into the text.  The splice cuts the
UTF-8 bytes of the text at the detections' byte offsets and joins gaps and
replacements in one ``array_join``: linear in the text, whatever the number
of detections.  JSON text takes the same path (its pairs are found as
text); ``input_type`` and ``output_valid_json`` report on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline import fixed as FX
from scrubline.functions.generators import builtin_generator
from scrubline.functions.sqlx import ident, name, q
from scrubline.operators.detect import (Options, balanced, candidate_columns, compile_rules, detection_columns, replacement_sql, resolve,
                                        sanitized_sql, splice_sql, word_candidates)
from scrubline.operators.rules import Rule

# JavaScript's String.prototype.trim removes these (ECMAScript WhiteSpace +
# LineTerminator).
_JS_WS = ("\t\n\u000b\u000c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(s: Column) -> Column:
    return F.trim(s, F.lit(_JS_WS))


def _parses(t: Column) -> Column:
    """Whether the whole text is one JSON value.  The parser stops behind the
    first value, so the text is parsed as the first of two elements; the
    second is the text's hash, which the text cannot hold."""
    two = F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), F.md5(t), F.lit('"]'))).cast("array<variant>")
    return (F.size(two) == 2) & (F.get(two, F.lit(1)).cast("string") == F.md5(t))


def is_json(s: Column) -> Column:
    """Trimmed text starts with '{' or '[' and parses as JSON."""
    t = js_trim(s)
    starts = t.startswith("{") | t.startswith("[")
    return F.coalesce(F.when(starts, _parses(t)), F.lit(False))


def input_status(s: Column) -> Column:
    """E1: 'null' / 'empty' / 'ok' (null and empty text stays as is; every
    other text is sanitized, whatever its length)."""
    return F.when(s.isNull(), F.lit("null")).when(s == "", F.lit("empty")).otherwise(F.lit("ok"))


def _selected(dets: str, selected: list[str] | None) -> str:
    """Detections of the listed rule ids (empty/None keeps all)."""
    if not selected:
        return dets
    return f"filter({dets}, d -> array_contains(array({', '.join(q(i) for i in selected)}), d.rule_id))"


#: Columns that ``sanitize`` adds besides its output text.
REPORT = ["detections", "detections_count", "patterns_replaced", "status", "input_type", "input_size", "output_size", "output_valid_json"]


def sanitize(df: DataFrame, text: str, rules: list[Rule], opts: Options | None = None,
             out: str = "sanitized", balance: bool = False, words: DataFrame | None = None, strategy: str = "generic",
             key: str | None = None) -> DataFrame:
    """E2 + E1 + E3 + E4/E5 on column ``text``; ``words``, ``strategy`` and
    ``key`` as in ``detect``.

    Adds ``out`` (sanitized text), ``detections`` (all resolved detections,
    by priority), ``detections_count``, ``patterns_replaced`` (selected),
    ``status`` (E1), ``input_type`` ('json' / 'text'), ``input_size`` and
    ``output_size`` (characters) and ``output_valid_json`` (E5: whether the
    sanitized JSON text still parses; null for other text).  An input column
    with one of these names is rejected: rename it first.
    """
    clash = {c.lower() for c in df.columns} & {c.lower() for c in [out, *REPORT]}
    if clash:
        raise ValueError(f"input columns clash with the result: {sorted(clash)}")
    opts = opts or Options()
    comp = compile_rules(rules, df.sparkSession, words is not None, strategy)
    if balance:
        df = balanced(df)
    det = detection_columns(word_candidates(df, text, comp, words, key), text, comp, opts)
    x, base = ident(text), [ident(c) for c in df.columns]
    spliced = det.selectExpr(*base, "detections", f"{_selected('`__dets`', opts.selected_rule_ids)} AS `__chosen`")
    spliced = spliced.selectExpr(*base, "detections", "size(`__chosen`) AS patterns_replaced", f"{splice_sql(x, '`__chosen`')} AS `__out`")
    t, o = F.col(x), F.col("__out")
    json = is_json(t)
    return spliced.select(
        *[F.col(c) for c in base],
        o.alias(out),
        F.col("detections"),
        F.size(F.col("detections")).alias("detections_count"),
        F.col("patterns_replaced"),
        input_status(t).alias("status"),
        F.when(json, F.lit("json")).otherwise(F.lit("text")).alias("input_type"),
        F.length(t).alias("input_size"),
        F.length(o).alias("output_size"),
        F.when(json, output_valid_json(o)).alias("output_valid_json"),
    )


_FOUND = ["rule_id", "match", "vstart", "vend"]


def _found(df: DataFrame, text: str, comp, keep: list[str]) -> DataFrame:
    """Resolved candidates as rows: ``keep``, rule_id, the candidate ``c``."""
    res = candidate_columns(df, text, comp).selectExpr(*keep, f"{resolve('`__cands`')} AS `__res`")
    ids = "CAST(array(" + ", ".join(q(r.id) for r in comp.ranked) + ") AS ARRAY<STRING>)"
    rows = res.selectExpr(*keep, "explode_outer(`__res`) AS c").where("c.start IS NOT NULL")
    return rows.selectExpr(*keep, f"element_at({ids}, c.rank + 1) AS rule_id", "c.match AS match", "c.vstart AS vstart", "c.vend AS vend", "c")


def replacement_map(df: DataFrame, text: str, rules: list[Rule], opts: Options | None = None) -> DataFrame:
    """(rule_id, match, vstart, vend, replacement), one row for every
    distinct value that the rules find in ``text``; ``vstart``/``vend`` give
    the part of a key-value match that is swapped (-1 otherwise).  Values
    are made distinct map-side first and each replacement is generated once.
    """
    opts = opts or Options()
    comp = compile_rules(rules, df.sparkSession)
    one = _found(df.selectExpr(ident(text)), text, comp, []).selectExpr(
        *_FOUND, "c.rank AS rank").distinct()
    c = one.selectExpr("*", "named_struct('rank', rank, 'match', match, 'vstart', vstart, 'vend', vend) AS c")
    return c.selectExpr(*_FOUND, f"{replacement_sql(comp, 'c', opts)} AS replacement")


def apply_replacements(df: DataFrame, text: str, key: str, rules: list[Rule], mapping: DataFrame, out: str = "sanitized") -> DataFrame:
    """E10 joined back: (key, out) with the replacements of ``mapping``
    spliced into every text.  ``key`` must identify a row.  The join is on
    the value; Spark chooses it, and adaptive execution splits a value that
    is very frequent."""
    comp = compile_rules(rules, df.sparkSession)
    k, x = ident(key), ident(text)
    found = _found(df.selectExpr(k, x), text, comp, [k])
    joined = found.join(mapping, _FOUND).selectExpr(
        k, "named_struct('bstart', c.bstart, 'bend', c.bend, 'replacement', replacement) AS d")
    per_row = joined.groupBy(key).agg(F.collect_list("d").alias("__d"))
    both = df.selectExpr(k, x).join(per_row, key, "left")
    return both.selectExpr(k, f"CASE WHEN `__d` IS NULL THEN {x} ELSE {splice_sql(x, '`__d`')} END AS {ident(out)}")


def run_statistics(sanitized: DataFrame) -> DataFrame:
    """One row for a whole run: rows, rows with detections, rows changed
    by type, detections, replacements, characters in and out."""
    return sanitized.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("detections_count") > 0).alias("rows_with_detections"),
        F.count_if(F.col("input_type") == "json").alias("json_rows"),
        F.coalesce(F.sum("detections_count"), F.lit(0)).alias("detections"),
        F.coalesce(F.sum("patterns_replaced"), F.lit(0)).alias("replacements"),
        F.coalesce(F.sum("input_size"), F.lit(0)).alias("input_chars"),
        F.coalesce(F.sum("output_size"), F.lit(0)).alias("output_chars"))


def sanitize_table(df: DataFrame, columns: list[str] | None, rules: list[Rule], opts: Options | None = None) -> DataFrame:
    """Sanitize the chosen (default: all string) columns in place; the
    columns may have any names."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    comp = compile_rules(rules, df.sparkSession)
    opts = opts or Options()
    if not cols:
        return df
    # one pipeline for all of them: the texts of a row form one array
    texts = "array(" + ", ".join(ident(c) for c in cols) + ")"
    v = name("v")
    done = df.selectExpr(*[ident(c) for c in df.columns], f"transform({texts}, {v} -> {sanitized_sql(v, comp, opts)}) AS `__done`")
    return done.selectExpr(*[f"get(`__done`, {cols.index(c)}) AS {ident(c)}" if c in cols else ident(c) for c in df.columns])


def output_valid_json(s: Column) -> Column:
    """E5 report: does the sanitized JSON text still parse?"""
    return F.coalesce(_parses(js_trim(s)), F.lit(False))


def replacement_for(match: Column, pattern: str, jwt_epoch: int = FX.DEFAULT_JWT_EPOCH) -> Column:
    """E8/E10 helper: the builtin fake for a matched value."""
    gen = builtin_generator(pattern, jwt_epoch)
    if gen is None:
        raise ValueError(f"unknown builtin pattern {pattern}")
    return gen(match)
