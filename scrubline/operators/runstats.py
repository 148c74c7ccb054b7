"""E9 in passing: the statistics of a run, taken while it writes.

``observed`` hangs an ``Observation`` on a sanitized table: whatever action
consumes the table fills it, without a second pass.  Besides counts it
takes two mergeable sketches, a KLL sketch of text sizes and a HyperLogLog
sketch of distinct texts, so the statistics of many runs add up to those of
all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: log2 of the registers of the distinct sketch (relative error 1.04 / sqrt(2^12) = 1.6 %) and the KLL parameter (rank error about 1.3 % at 200).
HLL_K, KLL_K = 12, 400

COUNTS = ("rows", "rows_with_detections", "changed_rows", "json_rows", "detections", "replacements", "input_chars", "output_chars")


def _metrics(text: str, out: str) -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("detections_count") > 0).alias("rows_with_detections"),
            F.count_if(~F.col(text).eqNullSafe(F.col(out))).alias("changed_rows"), F.count_if(F.col("input_type") == "json").alias("json_rows"),
            total("detections_count").alias("detections"), total("patterns_replaced").alias("replacements"),
            total("input_size").alias("input_chars"), total("output_size").alias("output_chars"),
            F.kll_sketch_agg_bigint(F.coalesce(F.col("input_size"), F.lit(0)).cast("long"), F.lit(KLL_K)).alias("sizes"),
            F.hll_sketch_agg(F.coalesce(F.col(text), F.lit("")), F.lit(HLL_K)).alias("texts")]


def observed(sanitized: DataFrame, text: str, name: str = "run", out: str = "sanitized") -> tuple[DataFrame, Observation]:
    """A ``sanitize`` result that takes its statistics when it is consumed,
    and where they will be.  The observation's ``get`` waits for that action."""
    seen = Observation(name)
    return sanitized.observe(seen, *_metrics(text, out)), seen


def run_row(spark: SparkSession, seen: Observation, run: str) -> DataFrame:
    """The statistics of one run as a row: its name, counts and sketches."""
    got = seen.get
    row = (run, *[int(got[c]) for c in COUNTS], bytes(got["sizes"]), bytes(got["texts"]))
    return spark.createDataFrame([row], "run string, " + ", ".join(f"{c} long" for c in COUNTS) + ", sizes binary, texts binary")


def summed(runs: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row for all runs of a table of ``run_row`` rows: counts summed,
    sketches merged; ``distinct_texts`` is an estimate over all runs, and
    ``size_quantiles`` come from the merged sketch."""
    one = runs.agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in COUNTS], F.kll_merge_agg_bigint("sizes").alias("sizes"), F.hll_union_agg("texts").alias("texts"))
    return one.select("runs", *COUNTS, F.hll_sketch_estimate("texts").alias("distinct_texts"),
                      F.array(*[F.kll_sketch_get_quantile_bigint("sizes", F.lit(x)) for x in quantiles]).alias("size_quantiles"))
