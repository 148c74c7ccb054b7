"""E10 kept over many runs: a pseudonym table that only grows by what is new.

The table holds every value seen so far with its replacement, one folder a
version.  A run finds the distinct values of its texts, sets them off
against the table and generates replacements for the unseen ones only.
The table is far larger than a run's values, so it is thinned first by a
bitmap of the run's values (fixed size, broadcast): what the anti join
shuffles is about the run, not about the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.sqlx import ident
from scrubline.functions.stored import bitmap, maybe_in, stored
from scrubline.operators.detect import Options, compile_rules, replacement_sql
from scrubline.operators.rules import Rule
from scrubline.operators.sanitize import _FOUND, _found

SCHEMA = "rule_id string, match string, vstart int, vend int, replacement string, version int"


def read_pseudonyms(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; empty if there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def update_pseudonyms(df: DataFrame, text: str, rules: list[Rule], path: str, opts: Options | None = None) -> DataFrame:
    """Adds the values that the rules find in ``text`` and the table at
    ``path`` lacks, as its next version, and returns the rows added.

    A run repeated on the same texts adds nothing.  A version is one Spark
    write: a run that fails leaves none.  One run at a time may write to a
    table.  Rules are told apart by their id; null and empty texts hold
    nothing.
    """
    opts = opts or Options()
    spark = df.sparkSession
    comp = compile_rules(rules, spark)
    # vstart and vend are -1 for all but key-value rules, never null: an equi-join serves
    found = stored(_found(df.selectExpr(ident(text)), text, comp, []).selectExpr(*_FOUND, "c.rank AS rank").distinct(), "found")
    known = read_pseudonyms(spark, path)
    last = known.agg(F.max("version")).first()[0]
    fresh = found
    if last is not None:
        likely = maybe_in(known.select(*_FOUND), bitmap(found, _FOUND), _FOUND)
        fresh = stored(found.join(likely, _FOUND, "left_anti"), "fresh")
    if fresh.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    version = (last or 0) + 1
    c = fresh.selectExpr(*_FOUND, "named_struct('rank', rank, 'match', match, 'vstart', vstart, 'vend', vend) AS c")
    rows = c.selectExpr(*_FOUND, f"{replacement_sql(comp, 'c', opts)} AS replacement")
    rows.write.parquet(f"{path}/version={version}")
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(f"{path}/version={version}")
