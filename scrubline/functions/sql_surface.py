"""The engine callable from SQL.

``register_sql_functions`` defines temporary SQL functions whose bodies are
the same generated expressions the DataFrame operators use, so SQL users
get the JVM-side pipeline (no Python UDF on the row path):

* ``<prefix>_text(x)``  -- sanitize a string under the given rules (E2),
* ``<prefix>_mask(x)``  -- the word mask (G11),
* ``<prefix>_hash(x)``  -- the 31-bit value hash used to seed fakes (G1),
* ``<prefix>_detections(x)`` -- a table function (``register_detections``):
  the resolved detections as rows, for use with LATERAL.  Spark turns the
  lateral call into a generator on the calling row: no join, no shuffle.

Defining and planning ``<prefix>_text`` costs as much analysis as the
DataFrame pipeline (seconds, independent of data size).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from scrubline.functions.generators import mask_word
from scrubline.functions.rng import js_hash
from scrubline.functions.sqlx import ident
from scrubline.operators.detect import PUBLIC, Options, compile_rules, detections_sql, sanitized_sql
from scrubline.operators.rules import Rule


def register_sql_functions(spark: SparkSession, rules: list[Rule], opts: Options | None = None,
                           prefix: str = "scrub") -> list[str]:
    opts = opts or Options()
    comp = compile_rules(rules, spark)
    defs = {
        f"{prefix}_text": sanitized_sql("x", comp, opts),
        f"{prefix}_mask": mask_word("x"),
        f"{prefix}_hash": js_hash("x"),
    }
    types = {f"{prefix}_text": "STRING", f"{prefix}_mask": "STRING", f"{prefix}_hash": "BIGINT"}
    for fname, body in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {fname}(x STRING) RETURNS {types[fname]} RETURN {body}")
    return list(defs)


def register_detections(spark: SparkSession, rules: list[Rule], opts: Options | None = None, prefix: str = "scrub") -> str:
    """Defines the table function ``<prefix>_detections(x STRING)``; it gives
    no row for null or empty text and text without detections.  Call it in an
    inner lateral join: Spark 4.1 drops rows without detections from a left
    one too."""
    body = detections_sql("x", compile_rules(rules, spark), opts or Options())
    cols = ", ".join(f"{ident(k)} {t}" for k, t in PUBLIC.items())
    names = ", ".join(ident(k) for k in PUBLIC)
    # no filter around the generator: Spark would then join the texts back instead of generating on the calling row
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_detections(x STRING) RETURNS TABLE({cols}) RETURN SELECT {names} FROM (SELECT inline({body}))")
    return f"{prefix}_detections"
