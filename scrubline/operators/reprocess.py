"""F12 with a difference: what changes when old entries meet new rules.

Old and new detections of an entry are two lists of intervals.  Merged by
position they fall into islands that overlap nothing else (see
``islands``); an island with new detections only was added, one with old
ones only was removed, one whose two sides differ was changed.  So the two
lists are aligned by one ordering and never compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.operators.detect import Options, detect
from scrubline.operators.islands import islands
from scrubline.operators.rules import Rule

_FIELDS = ["start", "end", "rule_id", "match", "replacement"]


def detection_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, change, old, new): one row per island of the
    detections of a text that is not the same on both sides.

    ``old`` and ``new`` hold one detection a row: ``keys`` (not null), start,
    end, rule_id, match, replacement.  ``old`` and ``new`` of the result are
    the sides' (start, end, rule_id, replacement), by start.  ``change`` is
    added, removed or changed.  A text without detections on both sides has
    no row; repeated detections count once.
    """
    def side(df, n):
        return df.select(*keys, *_FIELDS).distinct().withColumn("rank", F.lit(n)).withColumn("sub", F.lit(0)).withColumn("seq", F.xxhash64("end", "rule_id", "replacement"))
    both = islands(side(old, 0).unionByName(side(new, 1)), keys)
    pick = lambda n: F.array_sort(F.collect_list(F.when(F.col("rank") == n, F.struct("start", "end", "rule_id", "replacement"))))
    met = both.groupBy(*keys, "island").agg(F.max("end").alias("end"), pick(0).alias("old"), pick(1).alias("new"))
    change = F.when(F.size("old") == 0, F.lit("added")).when(F.size("new") == 0, F.lit("removed")).when(F.col("old") != F.col("new"), F.lit("changed"))
    return met.withColumn("change", change).where("change IS NOT NULL").select(*keys, F.col("island").alias("start"), "end", "change", "old", "new")


def reprocess_changes(audit: DataFrame, rules: list[Rule], opts: Options | None = None, words: DataFrame | None = None) -> DataFrame:
    """F12 over an audit table: the entries' original texts under new rules,
    against the detections they were stored with, by ``detection_changes``.
    Entry ids are not null and occur once."""
    flat = lambda df: df.selectExpr("id", "inline_outer(detections)").where("start IS NOT NULL").select("id", *_FIELDS)
    new = detect(audit.select("id", "original_text"), "original_text", rules, opts, words=words, key="id")
    return detection_changes(flat(audit), flat(new), ["id"])


def change_counts(changes: DataFrame) -> DataFrame:
    """Entries and islands by kind of change."""
    return changes.groupBy("change").agg(F.countDistinct("id").alias("entries"), F.count("*").alias("places"))
