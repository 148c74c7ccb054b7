"""F2/F3 on a stream: the newest entries of each profile, kept up to date.

Each micro-batch is merged with what was kept before it, and the newest N of
every profile become the next state, a folder named by the batch.  A batch
that is tried again reads the same earlier state and replaces its own
folder, so a restart neither loses nor repeats entries.

A profile may hold most of a stream.  So entries compete within (profile,
slice) first, and only N a slice meet in the profile's last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline import fixed as FX
from scrubline.operators.audit import AUDIT_SCHEMA
from scrubline.streaming.stream import stream_home

#: Slices a profile's entries compete in before the last round.
SLICES = 32


def newest(entries: DataFrame, n: int, by: str = "profile_name") -> DataFrame:
    """The newest ``n`` entries of each profile, by time and id; of entries
    with one id the newest counts.  A null profile is one of its own; an
    entry without a time is the oldest."""
    order = [F.col("timestamp").desc_nulls_last(), F.col("id").desc_nulls_last()]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cols = entries.columns
    # an id's entries are in one slice
    df = entries.withColumn("__slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)))
    df = df.withColumn("__k", rank(by, "__slice", "id")).where("__k = 1")
    df = df.withColumn("__k", rank(by, "__slice")).where(F.col("__k") <= n)
    return df.withColumn("__k", rank(by)).where(F.col("__k") <= n).select(*cols)


def _states(spark: SparkSession, home: str) -> list[int]:
    """The batches that have a complete state folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/kept")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = lambda x: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/kept/{x}/_SUCCESS"))
    return sorted(int(x.split("=")[1]) for x in names if x.startswith("batch=") and done(x))


def kept(spark: SparkSession, name: str) -> DataFrame:
    """What the retention stream ``name`` keeps after its last batch."""
    home = stream_home(spark, name)
    states = _states(spark, home)
    if not states:
        return spark.createDataFrame([], AUDIT_SCHEMA)
    return spark.read.schema(AUDIT_SCHEMA).parquet(f"{home}/kept/batch={states[-1]}")


def retain_stream(spark: SparkSession, entries: DataFrame, name: str, n: int = FX.DEFAULT_MAX_HISTORY, trigger: str | None = None):
    """Starts the retention of a stream of audit entries (AUDIT_SCHEMA).
    Without a ``trigger`` it drains what is there and stops.  Run again under
    its name it goes on; states older than the last two are deleted."""
    home = stream_home(spark, name)

    def merge(batch: DataFrame, batch_id: int):
        before = [s for s in _states(spark, home) if s < batch_id]
        merged = batch.select(*AUDIT_SCHEMA.fieldNames())
        if before:
            merged = merged.unionByName(spark.read.schema(AUDIT_SCHEMA).parquet(f"{home}/kept/batch={before[-1]}"))
        newest(merged, n).write.mode("overwrite").parquet(f"{home}/kept/batch={batch_id}")
        fs = spark._jvm.org.apache.hadoop.fs.Path(home).getFileSystem(spark._jsc.hadoopConfiguration())
        for s in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/kept/batch={s}"), True)

    w = entries.writeStream.foreachBatch(merge).option("checkpointLocation", f"{home}/_checkpoint")
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()
