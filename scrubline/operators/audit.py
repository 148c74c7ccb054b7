"""Audit (history) operators F1-F13 over an audit table.

The audit table (``AUDIT_SCHEMA``) is an ordinary, append-only table; every
operator here is a DataFrame transformation.  Newest-first retention and
paging use ``orderBy(...).limit(...)``, which Spark plans as a
``TakeOrderedAndProject`` (per-partition top-k, then a merge of k rows) --
never a full sort or a single-partition window.  Statistics and per-rule
counts are partial (map-side) aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline import fixed as FX

DETECTION_TYPE = T.ArrayType(T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("rule_name", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("pattern", T.StringType()),
    T.StructField("match", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType()),
    T.StructField("selected", T.BooleanType()),
]))

AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("original_text", T.StringType()),
    T.StructField("sanitized_text", T.StringType()),
    T.StructField("detections", DETECTION_TYPE),
    T.StructField("detections_count", T.IntegerType()),
    T.StructField("profile_name", T.StringType()),
    T.StructField("input_preview", T.StringType()),
    T.StructField("output_preview", T.StringType()),
    T.StructField("input_size", T.IntegerType()),
    T.StructField("output_size", T.IntegerType()),
])


def audit_entries(sanitized: DataFrame, id_col: Column, ts_col: Column, original: str, result: str = "sanitized",
                  profile: str = "default") -> DataFrame:
    """audit rows from a ``sanitize`` output.  The id is given by the
    caller (a key of the source row, so re-running a batch rewrites the same
    ids instead of minting random ones)."""
    o, s = F.col(original), F.col(result)
    return sanitized.select(
        id_col.cast("string").alias("id"),
        ts_col.cast("timestamp").alias("timestamp"),
        o.alias("original_text"),
        s.alias("sanitized_text"),
        F.col("detections").alias("detections"),
        F.coalesce(F.size("detections"), F.lit(0)).alias("detections_count"),
        F.lit(profile).alias("profile_name"),
        F.left(o, F.lit(FX.PREVIEW_CHARS)).alias("input_preview"),
        F.left(s, F.lit(FX.PREVIEW_CHARS)).alias("output_preview"),
        F.length(o).alias("input_size"),
        F.length(s).alias("output_size"),
    )


def append(entries: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A5: append entries to the audit table at ``path``."""
    entries.write.mode("append").format(fmt).save(path)


def read(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the audit table."""
    return spark.read.schema(AUDIT_SCHEMA).format(fmt).load(path)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("timestamp").desc(), F.col("id").desc())


def retain(df: DataFrame, max_entries: int = FX.DEFAULT_MAX_HISTORY) -> DataFrame:
    """F2 (and F3 with 10): keep the newest ``max_entries`` entries."""
    return newest_first(df).limit(max_entries)


def changed(df: DataFrame) -> Column:
    """original and sanitized differ."""
    return ~F.col("original_text").eqNullSafe(F.col("sanitized_text"))


def audit_stats(df: DataFrame) -> DataFrame:
    """entries, total detections, modified entries, average detections
    (one decimal, 0 when empty), first and last timestamp."""
    n = F.count(F.lit(1))
    total = F.coalesce(F.sum(F.coalesce(F.size("detections"), F.lit(0))), F.lit(0))
    return df.agg(
        n.alias("entries"),
        total.alias("total_detections"),
        F.count_if(changed(df)).alias("modified_entries"),
        F.when(n > 0, F.round(total / n, 1)).otherwise(F.lit(0.0)).alias("avg_detections"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def date_filter(df: DataFrame, which: str, as_of: dt.datetime) -> DataFrame:
    """'today' (since local midnight of ``as_of``), 'week' (midnight - 7
    days), 'month' (same day of the previous month); anything else: all.
    ``add_months`` clamps the 31st to the month's end (documented)."""
    midnight = dt.datetime(as_of.year, as_of.month, as_of.day)
    if which == "today":
        return df.where(F.col("timestamp") >= F.lit(midnight))
    if which == "week":
        return df.where(F.col("timestamp") >= F.lit(midnight - dt.timedelta(days=7)))
    if which == "month":
        return df.where(F.col("timestamp") >= F.add_months(F.lit(midnight.date()), -1).cast("timestamp"))
    return df


def search(df: DataFrame, term: str) -> DataFrame:
    """case-insensitive substring in original, sanitized, or any
    detection's rule name or match."""
    if not term:
        return df
    t = term.lower()
    hit = (F.coalesce(F.lower("original_text").contains(t), F.lit(False))
           | F.coalesce(F.lower("sanitized_text").contains(t), F.lit(False))
           | F.coalesce(F.exists("detections", lambda d: F.coalesce(F.lower(d["rule_name"]).contains(t), F.lit(False))
                                 | F.coalesce(F.lower(d["match"]).contains(t), F.lit(False))), F.lit(False)))
    return df.where(hit)


def page(df: DataFrame, n: int, size: int = FX.HISTORY_PAGE_SIZE) -> DataFrame:
    """page ``n`` (1-based) of the newest-first list."""
    return newest_first(df).offset((n - 1) * size).limit(size)


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    """drop entries whose id is in ``ids`` (a one-column table).
    A left-anti join: Spark broadcasts ``ids`` only when its size estimate is
    under the broadcast threshold, otherwise it shuffles both sides."""
    return df.join(ids.select(F.col(ids.columns[0]).cast("string").alias("id")), "id", "left_anti")


def clear(df: DataFrame) -> DataFrame:
    """F10 clear."""
    return df.limit(0)


def by_category(df: DataFrame) -> DataFrame:
    """detections per (category, rule)."""
    d = df.select(F.explode("detections").alias("d"))
    return d.groupBy(F.col("d.category").alias("category"), F.col("d.rule_id").alias("rule_id")).agg(
        F.count(F.lit(1)).alias("n"))


def reprocess(df: DataFrame, rules, opts=None) -> DataFrame:
    """sanitize ``original_text`` again under the current rules and
    report whether the result changed."""
    from scrubline.operators.sanitize import sanitize
    out = sanitize(df.select("id", "original_text", F.col("sanitized_text").alias("old_sanitized")),
                   "original_text", rules, opts, out="new_sanitized")
    return out.select("id", "old_sanitized", "new_sanitized",
                      (~F.col("old_sanitized").eqNullSafe(F.col("new_sanitized"))).alias("changed"))
