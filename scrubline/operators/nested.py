"""Sanitize the string leaves of a nested column, keys untouched.

The walk happens on the driver over the column's *schema* (not the data)
and yields one expression: structs are rebuilt with ``named_struct`` (a
null struct stays null), arrays with ``transform``, maps with
``transform_values`` (keys kept), and every string leaf becomes the whole
sanitize pipeline as a single expression (``sanitized_sql``).  Other
scalars are kept.  Leaves more than 50 container levels deep become
'[MAX_DEPTH_EXCEEDED]'.  Cycles cannot occur in a Spark schema.  The
result is a narrow projection: no explode, no regrouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scrubline import fixed as FX
from scrubline.functions.sqlx import ident, name, q
from scrubline.operators.detect import Options, compile_rules, sanitized_sql
from scrubline.operators.rules import Rule


def _walk(expr: str, dtype: T.DataType, depth: int, leaf) -> str:
    if isinstance(dtype, T.StringType):
        if depth > FX.MAX_JSON_DEPTH:
            return f"CASE WHEN {expr} IS NULL THEN NULL ELSE {q(FX.MAX_DEPTH_MARKER)} END"
        return leaf(expr)
    if isinstance(dtype, T.StructType):
        if not dtype.fields:
            return expr
        parts = ", ".join(f"{q(f.name)}, {_walk(f'{expr}.{ident(f.name)}', f.dataType, depth + 1, leaf)}"
                          for f in dtype.fields)
        return f"CASE WHEN {expr} IS NULL THEN NULL ELSE named_struct({parts}) END"
    if isinstance(dtype, T.ArrayType):
        e = name("e")
        return f"transform({expr}, {e} -> {_walk(e, dtype.elementType, depth + 1, leaf)})"
    if isinstance(dtype, T.MapType):
        k, v = name("k"), name("v")
        return f"transform_values({expr}, ({k}, {v}) -> {_walk(v, dtype.valueType, depth + 1, leaf)})"
    return expr


def nested_sql(col: str, dtype: T.DataType, rules: list[Rule], opts: Options | None = None, spark=None) -> str:
    """The E6 expression for column ``col`` of type ``dtype``."""
    opts = opts or Options()
    comp = compile_rules(rules, spark)
    return _walk(ident(col), dtype, 0, lambda e: sanitized_sql(e, comp, opts))


def sanitize_nested(df: DataFrame, col: str, rules: list[Rule], opts: Options | None = None) -> DataFrame:
    """Column ``col`` with every string leaf sanitized; other columns kept."""
    dtype = df.schema[col].dataType
    expr = nested_sql(col, dtype, rules, opts, df.sparkSession)
    return df.selectExpr(*[f"{expr} AS {ident(c)}" if c == col else ident(c) for c in df.columns])
