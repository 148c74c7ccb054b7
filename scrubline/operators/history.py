"""B10/B15 over time: which rule was valid when.

A change log of a rule set (one row a change) becomes a table of versions
with the interval in which each was valid.  An as-of join brings detections
of an audit log together with the version that was valid at their time.

Few rules have very many detections, so a join on the rule alone would put
a rule's detections into one task.  Versions are laid out by day instead: a
detection's day and rule lead to the versions valid on that day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions.stored import stored

#: Seconds of a slice of time in which versions and detections meet.
SLICE = 86_400


def rule_versions(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Versions of rules: the columns of ``changes`` without ``op``, and
    ``valid_from``, ``valid_to`` (null: still valid).

    ``changes`` holds ``keys`` (profile and rule id, say), ``changed_at``,
    ``op`` (set or delete) and the rule's columns.  A deletion ends a version
    and starts none; of changes to one rule at one time the last by their
    columns counts.  Changes without a time are ignored.
    """
    rest = [c for c in changes.columns if c not in (*keys, "changed_at", "op")]
    one = changes.where("changed_at IS NOT NULL").groupBy(*keys, "changed_at").agg(F.max(F.struct("op", *rest)).alias("c"))
    after = F.lead("changed_at").over(Window.partitionBy(*keys).orderBy("changed_at"))  # the changes of one rule
    return one.withColumn("valid_to", after).where("c.op <> 'delete'").select(*keys, *[F.col(f"c.{c}").alias(c) for c in rest], F.col("changed_at").alias("valid_from"), "valid_to")


def rules_at(versions: DataFrame, when) -> DataFrame:
    """The versions valid at one time."""
    return versions.where((F.col("valid_from") <= F.lit(when)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(when))))


def with_valid_rule(rows: DataFrame, versions: DataFrame, keys: list[str], time: str = "timestamp") -> DataFrame:
    """``rows`` with the columns of the rule version valid at their ``time``;
    nulls where none was.  ``rows`` and ``versions`` share ``keys`` only.

    Rows without a time or key stay, with nulls.  A version is laid out over
    the slices between the rows' first and last time, so an open interval
    costs no more than the log is long.
    """
    at = lambda c: F.floor(F.unix_seconds(c) / SLICE)
    span = rows.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))  # one row
    v = versions.join(F.broadcast(span)).where("lo IS NOT NULL AND valid_from <= hi AND (valid_to IS NULL OR valid_to > lo)")
    first, last = at(F.greatest("valid_from", "lo")), at(F.least(F.coalesce("valid_to", "hi"), "hi"))
    v = stored(v.withColumn("__slice", F.explode(F.sequence(first, last))).drop("lo", "hi"), "versions")
    r = rows.withColumn("__slice", at(F.col(time)))
    extra = [c for c in versions.columns if c not in keys]
    on = [r[k] == v[k] for k in [*keys, "__slice"]] + [v["valid_from"] <= r[time], v["valid_to"].isNull() | (v["valid_to"] > r[time])]
    return r.join(v, on, "left").select(*[r[c] for c in rows.columns], *[v[c] for c in extra])
