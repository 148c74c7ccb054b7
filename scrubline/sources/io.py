"""Sources and sinks (A1-A9): rule tables, audit tables, backups, results.

Everything is a DataFrame reader or writer; nothing is collected except
where a caller asks for a validation report.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline import fixed as FX
from scrubline.functions.stored import global_rank
from scrubline.operators import audit as A
from scrubline.operators.sanitize import run_statistics
from scrubline.operators.rules import RULE_SCHEMA, validate_rules

#: Rules of one document of an export.
EXPORT_RULES = 5000

_JSON_RULE = T.StructType([f for f in RULE_SCHEMA.fields if f.name not in ("ordinal", "profile")])


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A2: a rule table stored as JSON lines (one rule per line) or as a
    table with RULE_SCHEMA.  Missing ordinals follow file name and place in
    the file, after the given ones."""
    df = spark.read.schema(RULE_SCHEMA).json(path).select("*", "_metadata.file_path", "_metadata.file_block_start",
                                                          F.monotonically_increasing_id().alias("__at"))
    # the place within a file is the order of the reader's ids in a block
    last = df.agg(F.max("ordinal").alias("__last"), F.count("ordinal").alias("__given"))  # one row
    ranked = global_rank(df, F.col("ordinal").asc_nulls_last(), "file_path", "file_block_start", "__at", out="__row")
    return (ranked.join(F.broadcast(last))
            .withColumn("ordinal", F.coalesce(F.col("ordinal"), (F.coalesce("__last", F.lit(-1)) + 1 + F.col("__row") - F.col("__given")).cast("int")))
            .select(*[f.name for f in RULE_SCHEMA.fields]))


def import_rules(spark: SparkSession, path: str) -> DataFrame:
    """A3: an export ``{"rules": [...], ...}``, in one document or several;
    rejects one whose ``rules`` is not an array; returns the rules with their
    ``validation`` (B1) so callers keep ``validation.is_valid`` rows.  A
    document's ``offset`` is the place of its first rule (0 if not given)."""
    raw = spark.read.option("multiLine", True).json(path)
    if "rules" not in raw.columns or not isinstance(raw.schema["rules"].dataType, T.ArrayType):
        raise ValueError("invalid rules file: 'rules' must be an array")
    offset = F.coalesce(F.col("offset").cast("int"), F.lit(0)) if "offset" in raw.columns else F.lit(0)
    typed = raw.select(offset.alias("offset"), F.from_json(F.to_json("rules"), T.ArrayType(_JSON_RULE)).alias("rules"))
    rules = typed.select("offset", F.posexplode("rules").alias("at", "r")).select(
        *[F.col(f"r.{f.name}").alias(f.name) for f in _JSON_RULE.fields], (F.col("offset") + F.col("at")).cast("int").alias("ordinal"),
        F.lit(None).cast("string").alias("profile"))
    return validate_rules(rules)


def export_rules(rules: DataFrame, path: str, export_date: dt.datetime | None = None) -> None:
    """A4: one JSON document ``{rules, exportDate, version}``.  Of more than
    EXPORT_RULES rules, several such documents, a file each, with the place
    of their first rule as ``offset``: no task gathers more than one."""
    when = (export_date or dt.datetime.now(dt.timezone.utc)).isoformat()
    cols = [f.name for f in _JSON_RULE.fields]
    rule = F.struct(*cols).alias("rule")
    head = [F.lit(when).alias("exportDate"), F.lit(FX.EXPORT_VERSION).alias("version")]
    if rules.limit(EXPORT_RULES + 1).count() <= EXPORT_RULES:
        ordered = F.array_sort(F.collect_list(F.struct("ordinal", "id", rule)))
        doc = rules.agg(F.transform(ordered, lambda x: x["rule"]).alias("rules")).select("rules", *head)
        doc.coalesce(1).write.mode("overwrite").json(path)
        return
    placed = global_rank(rules.select("ordinal", "id", rule), "ordinal", "id", "rule", out="__at")
    parts = placed.groupBy(F.floor(F.col("__at") / EXPORT_RULES).alias("__part")).agg(F.array_sort(F.collect_list(F.struct("__at", "rule"))).alias("placed"))
    docs = parts.select(F.transform("placed", lambda x: x["rule"]).alias("rules"), *head, (F.col("__part") * EXPORT_RULES).alias("offset"))
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)  # a document read as such is a whole file


def export_audit(audit: DataFrame, path: str) -> None:
    """Write the audit table as JSON; refuses an empty table."""
    if audit.isEmpty():
        raise ValueError("no history to export")
    audit.write.mode("overwrite").json(path)


def export_results(df: DataFrame, path: str, fmt: str = "json", include_detections: bool = True,
                   text: str = "sanitized", include_metadata: bool = False) -> None:
    """Sanitized results as text, json or csv (detections as a JSON
    string for csv; text keeps only the sanitized text).  With
    ``include_metadata`` the run's statistics go to ``path-metadata``."""
    if include_metadata:
        run_statistics(df).write.mode("overwrite").json(f"{path}-metadata")
    if fmt == "text":
        df.select(F.coalesce(F.col(text), F.lit(""))).write.mode("overwrite").text(path)
        return
    out = df if include_detections else df.drop("detections")
    if fmt == "csv":
        if "detections" in out.columns:
            out = out.withColumn("detections", F.to_json("detections"))
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").json(path)


def backup(path: str, rules: DataFrame | None = None, audit: DataFrame | None = None,
           words: DataFrame | None = None, profiles: DataFrame | None = None) -> None:
    """A8 export: one folder, one table per part that is given."""
    for name, df in (("rules", rules), ("history", audit), ("words", words), ("profiles", profiles)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A8 import: the parts present in a backup folder; rules come back with
    their validation (the original restores them unchecked)."""
    out = {}
    jvm_fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_fs.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("rules", "history", "words", "profiles"):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            df = spark.read.parquet(f"{path}/{name}")
            out[name] = validate_rules(df) if name == "rules" else df
    return out


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """A6."""
    return A.read(spark, path)
