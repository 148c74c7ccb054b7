"""Table-shaped detection jobs: one output row per hit.

``pattern_hits`` runs a single builtin detector (P01-P51) over a text
column and returns (keys..., seq, start, end, match): the span primitive,
exploded.  ``explode_detections`` (D11) turns the per-row detection arrays
of ``detect``/``sanitize`` into one row per detection.  Both are narrow
(no shuffle): a ``Generate`` after a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from scrubline.functions import regex as RX
from scrubline.functions.spans import matches, spans_from
from scrubline.functions.sqlx import ident, q
from scrubline.operators.patterns import BUILTINS


def regex_hits(df: DataFrame, text: str, java_pattern: str, keys: list[str], first_only: bool = False,
               guard: tuple[str, ...] = (), guard_lower: bool = False) -> DataFrame:
    """Every match of a (Java) regex with code-point offsets."""
    x = ident(text)
    k = [ident(c) for c in keys]
    g = None
    if guard:
        base = f"lower({x})" if guard_lower else x
        g = "(" + " OR ".join(f"contains({base}, {q(s)})" for s in guard) + ")"
    m1 = df.selectExpr(*k, x, f"{matches(x, java_pattern, 0, first_only, g)} AS `__m`")
    m2 = m1.selectExpr(*k, f"{spans_from(x, '`__m`', java_pattern)} AS `__sp`")
    return _inline(m2, k, "`__sp`", "seq").select(*keys, "seq", "start", "end", "match")


def _inline(df: DataFrame, keys: list[str], arr: str, probe: str) -> DataFrame:
    """One row per array element.  ``inline_outer`` + a filter on a
    generated column: a plain ``inline`` makes the optimizer infer
    ``size(arr) > 0`` and push it below the projections, where the whole
    array expression (regexes, folds, generators) would be evaluated a
    second time inside the filter."""
    return df.selectExpr(*keys, f"inline_outer({arr})").where(f"`{probe}` IS NOT NULL")


def pattern_hits(df: DataFrame, text: str, pattern: str, keys: list[str]) -> DataFrame:
    """P01-P51 as a table job: hits of builtin ``pattern``."""
    b = BUILTINS[pattern]
    return regex_hits(df, text, b.java, keys, guard=b.guard, guard_lower=b.guard_lower)


def js_regex_hits(df: DataFrame, text: str, js_pattern: str, flags: str, keys: list[str]) -> DataFrame:
    """D3 as a table job: hits of a user regex (JavaScript syntax)."""
    tr = RX.to_java(js_pattern, flags or "g")
    return regex_hits(df, text, tr.pattern, keys, first_only=not tr.global_)


def explode_detections(df: DataFrame, keys: list[str], col: str = "detections") -> DataFrame:
    """One row per detection (rows without detections drop out)."""
    k = [ident(c) for c in keys]
    return _inline(df, k, ident(col), "start")
