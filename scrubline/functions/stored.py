"""Intermediate tables in the shared folder, ranks and bitmaps over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.session import checkpoint_dir

#: Size of a membership bitmap: 2^26 bits = 8 MB in rows of 4 KB.
BITMAP_BITS = 1 << 26
ROW_BITS = 1 << 15


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder named by ``spark.checkpoint.dir`` and read
    back: later steps do not compute it again, also after a lost executor,
    and Spark knows its size."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, *order, out: str = "rank") -> DataFrame:
    """``df`` with its 0-based place in the order of ``order``: a range sort
    and one offset per partition, so no task sees more than its range."""
    s = stored(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__place", 33)
    n = s.groupBy(part.alias("__part")).agg(F.count("*").alias("n"), F.min("__place").alias("__first"))
    # one row per partition of the sort
    off = n.withColumn("__off", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (s.withColumn("__part", part).join(F.broadcast(off.drop("n")), "__part")
            .withColumn(out, (F.col("__off") + F.col("__place") - F.col("__first")).cast("long")).drop("__place", "__part", "__first", "__off"))


def _slot(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS))


def bitmap(df: DataFrame, keys: list[str], name: str = "bitmap") -> DataFrame:
    """A written bitmap of fixed size with a bit for each value of ``keys``."""
    slot = _slot(keys)
    return stored(df.select(F.floor(slot / ROW_BITS).cast("long").alias("__bucket"), (slot % ROW_BITS).alias("pos"))
                  .groupBy("__bucket").agg(F.bitmap_construct_agg("pos").alias("__bits")), name)


def maybe_in(df: DataFrame, bits: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose bit is set: all whose key is in the bitmap's table, and
    a few more.  The bitmap is broadcast: BITMAP_BITS bits at most."""
    slot = _slot(keys)
    pos = slot % ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (df.withColumn("__bucket", F.floor(slot / ROW_BITS).cast("long")).join(F.broadcast(bits), "__bucket")
            .where(F.getbit(byte, (pos % 8).cast("int")) == 1).select(*df.columns))


def surely_out(df: DataFrame, bits: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that ``maybe_in`` leaves out: none whose key is in the bitmap's table."""
    slot = _slot(keys)
    pos = slot % ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (df.withColumn("__bucket", F.floor(slot / ROW_BITS).cast("long")).join(F.broadcast(bits), "__bucket", "left")
            .where(F.col("__bits").isNull() | (F.getbit(byte, (pos % 8).cast("int")) == 0)).select(*df.columns))
