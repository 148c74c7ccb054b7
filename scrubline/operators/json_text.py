"""E5/E6 for JSON text of any shape: string leaves are sanitized, all else
stays as it is, and the text stays valid JSON.

In valid JSON a quote outside a string begins one, so one linear pattern
finds every string literal, and the text between them holds the structure:
a literal is a key if a colon follows it.  Values are unescaped, run through
the sanitize pipeline and, where that changed them, escaped again.  Nothing
is parsed into a schema and nothing leaves the row: a narrow projection.

Containers nested deeper than MAX_JSON_DEPTH, and what else stands that
deep, become the depth marker.  Only rows with that many open brackets pay
for the search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline import fixed as FX
from scrubline.functions.spans import spans_from
from scrubline.functions.sqlx import ident, let, name, q
from scrubline.operators.detect import WALK_BLOCK, Options, compile_rules, sanitized_sql, splice_sql
from scrubline.operators.rules import Rule
from scrubline.operators.sanitize import is_json, output_valid_json

#: A JSON string literal; possessive, so long literals need no stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
TOKEN = STRING + r'|[\[\]{}]|[^\s\[\]{}",:]++'
#: Brackets around a value that the walk still enters.
LEVELS = FX.MAX_JSON_DEPTH + 1
MARKER = '"' + FX.MAX_DEPTH_MARKER + '"'


def _unquoted(m: str) -> str:
    """The string a literal stands for."""
    return (f"CASE WHEN contains({m}, '\\\\') THEN get(from_json(concat('[', {m}, ']'), 'ARRAY<STRING>'), 0) "
            f"ELSE substr({m}, 2, length({m}) - 2) END")


def _quoted(s: str) -> str:
    """The literal of a string."""
    special = r'["\\\x00-\x1f]'
    cut = let(f"to_json(array({s}))", lambda j: f"substr({j}, 2, length({j}) - 2)")
    return f"CASE WHEN {s} RLIKE {q(special)} THEN {cut} ELSE concat('\"', {s}, '\"') END"


def leaves_sql(x: str, leaf) -> str:
    """JSON text ``x`` with ``leaf(value)`` in place of each string value."""
    a, i = name("a"), name("i")

    def body(m):
        def with_gaps(g):
            def changed(value):
                return let(leaf(value), lambda new: f"CASE WHEN {new} IS NULL OR {new} = {value} THEN {a} ELSE {_quoted(new)} END")
            is_key = f"startswith(trim(LEADING ' \t\r\n' FROM get({g}, {i} + 1)), ':')"
            keep = f"{is_key} OR {a} = '\"\"' OR {a} = {q(MARKER)}"
            piece = f"CASE WHEN {keep} THEN {a} ELSE coalesce({let(_unquoted(a), changed)}, {a}) END"
            # the gap before each literal, then the literal, then the last gap
            return f"concat(array_join(transform({m}, ({a}, {i}) -> concat(get({g}, {i}), {piece})), ''), element_at({g}, -1))"
        return f"CASE WHEN size({m}) = 0 THEN {x} ELSE {let(f'split({x}, {q(STRING)}, -1)', with_gaps)} END"
    return let(f"regexp_extract_all({x}, {q(STRING)}, 0)", body)


def _too_deep(x: str) -> str:
    """Spans of ``x`` that the walk does not enter, with the marker as their
    replacement: containers inside LEVELS others; in the innermost container
    it does enter, scalars, and in an array strings too."""
    t, acc, o, b, v = (name(n) for n in ("t", "acc", "o", "b", "v"))
    opens, closes = f"{t}.match IN ('[', '{{')", f"{t}.match IN (']', '}}')"
    text = f"startswith({t}.match, '\"')"
    at_rim = f"{acc}.lvl = {LEVELS}"
    span = f"array(named_struct('bstart', {{}}, 'bend', {t}.bend, 'replacement', {q(MARKER)}))"
    none = "CAST(array() AS ARRAY<STRUCT<bstart: INT, bend: INT, replacement: STRING>>)"
    item = (f"CASE WHEN {closes} AND {acc}.lvl = {LEVELS + 1} THEN {span.format(f'{acc}.at')} "
            f"WHEN {at_rim} AND NOT ({opens}) AND NOT ({closes}) AND (NOT {text} OR {acc}.arr) THEN {span.format(f'{t}.bstart')} ELSE {none} END")
    step = (f"named_struct('lvl', {acc}.lvl + CASE WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END, "
            f"'arr', CASE WHEN {acc}.lvl = {LEVELS - 1} AND {opens} THEN {t}.match = '[' ELSE {acc}.arr END, "
            f"'at', CASE WHEN {at_rim} AND {opens} THEN {t}.bstart ELSE {acc}.at END, 'out', concat({acc}.out, {item}))")

    def blocks(tokens):
        cut = (f"transform(sequence(0, greatest(CAST(ceil(size({tokens}) / {WALK_BLOCK}.0D) AS INT), 1) - 1), "
               f"{b} -> slice({tokens}, {b} * {WALK_BLOCK} + 1, {WALK_BLOCK}))")
        inner = (f"aggregate({b}, named_struct('lvl', {o}.lvl, 'arr', {o}.arr, 'at', {o}.at, 'out', {none}), ({acc}, {t}) -> {step})")
        outer = let(inner, lambda w: f"named_struct('lvl', {w}.lvl, 'arr', {w}.arr, 'at', {w}.at, 'outs', concat({o}.outs, array({w}.out)))")
        init = "named_struct('lvl', 0, 'arr', false, 'at', 0, 'outs', CAST(array() AS ARRAY<ARRAY<STRUCT<bstart: INT, bend: INT, replacement: STRING>>>))"
        return f"aggregate({cut}, {init}, ({o}, {b}) -> {outer}, {v} -> flatten({v}.outs))"
    return let(let(f"regexp_extract_all({x}, {q(TOKEN)}, 0)", lambda m: spans_from(x, m, TOKEN)), blocks)


def bounded_sql(x: str) -> str:
    """JSON text ``x`` with everything nested too deep replaced by the marker."""
    structure = f"regexp_replace({x}, {q(STRING)}, '')"
    opens = f"length(regexp_replace({structure}, '[^\\\\[{{]', ''))"
    return f"CASE WHEN {opens} < {LEVELS} THEN {x} ELSE {let(_too_deep(x), lambda d: splice_sql(x, d))} END"


def sanitize_json(df: DataFrame, col: str, rules: list[Rule], opts: Options | None = None, out: str = "sanitized") -> DataFrame:
    """``df`` with ``out``: column ``col`` with the string values of JSON text
    sanitized one by one, keys, numbers, order and white space untouched; and
    ``output_valid_json`` (true wherever the input is JSON, else null).

    Text that is no JSON object or array is sanitized as text.  Null and
    empty text stays.  Repeated keys stay repeated.  Long literals and deep
    nesting need no stack.  Columns called like the two results are replaced.
    """
    comp = compile_rules(rules, df.sparkSession)
    opts = opts or Options()
    x, base = ident(col), [ident(c) for c in df.columns if c not in (out, "output_valid_json")]
    mid = df.select("*", is_json(F.col(x)).alias("__json"))
    mid = mid.selectExpr(*[ident(c) for c in df.columns], "`__json`", f"CASE WHEN `__json` THEN {bounded_sql(x)} ELSE {x} END AS `__x`")
    # one pipeline for both kinds: a text that is no JSON is its own only leaf
    leaf = lambda s: sanitized_sql(s, comp, opts)
    both = mid.selectExpr(*base, "`__json`", f"CASE WHEN `__json` THEN {leaves_sql('`__x`', leaf)} ELSE {leaf('`__x`')} END AS {ident(out)}")
    return both.select(*[F.col(c) for c in base], ident(out), F.when(F.col("__json"), output_valid_json(F.col(out))).alias("output_valid_json"))
