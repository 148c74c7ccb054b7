"""Exact deduplication by progressive refinement (DataFrame functions only).

Rows are compared by the byte length of their text (folding A-Z keeps it),
then, within the lengths that occur twice, by a hash of a prefix, and only
the rows that still share both are folded and hashed in full.  Which lengths,
and which (length, prefix) keys, occur twice is kept as a written bitmap of
fixed size (``BITMAP_BITS``), so each test is a broadcast of a proven 1 MB
and no text is ever shuffled: a set bit that belongs to another key only
costs one more hash, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import cut, q, text_or_empty

#: Code points of the prefix that the second refinement hashes.
PREFIX_CHARS = 64
#: Size of the survivor bitmap: 2^23 bits = 1 MB in rows of 4 KB.
BITMAP_BITS = 1 << 23
ROW_BITS = 1 << 15


def normalised(text):
    """A-Z lower-cased, everything else as it is; null counts as empty."""
    return F.translate(text_or_empty(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _slot(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS))


def _twice(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(bucket, bits): a bit for each value of ``keys`` seen twice.  The
    grouping only counts, so a hot key is combined map-side."""
    slot = _slot(keys)
    twice = rows.groupBy(*keys).count().where("count > 1")
    return cut(twice.select(F.floor(slot / ROW_BITS).cast("long").alias("__bucket"), (slot % ROW_BITS).alias("pos"))
               .groupBy("__bucket").agg(F.bitmap_construct_agg("pos").alias("__bits")), name)


def _tested(rows: DataFrame, bitmap: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: whether the bit of their key is set."""
    slot = _slot(keys)
    pos = slot % ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("__bucket", F.floor(slot / ROW_BITS).cast("long")).join(F.broadcast(bitmap), "__bucket", "left")
            .withColumn(out, F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bits"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every input row with ``keep_id`` (largest id of the rows with an equal
    normalised text), ``group_size`` and ``kept``, and the columns ``keep``
    (default: all; without the text no text is written or moved).

    Null and empty texts are equal to each other.  Rows that repeat the id
    and the text of the row that stays are dropped but for one.  A null id
    ranks below all others (``keep_id`` is null only if all ids of the group
    are).  An empty table gives an empty result.  An input column called
    like a result column is replaced by it.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("keep_id", "group_size", "kept")])
    text = text_or_empty(F.col(q(text_col)))
    cols = [F.col(q(c)) for c in df.columns if keep is None or c in keep]
    sized = df.select(*cols, F.col(q(id_col)).alias("__id"), F.octet_length(text).alias("__len"), text.alias("__text"))
    sized = _tested(sized, _twice(sized, ["__len"], "lengths"), ["__len"], "__met")
    keyed = sized.withColumn("__pre", F.when(F.col("__met"), F.xxhash64(normalised(F.substring("__text", 1, PREFIX_CHARS)))))
    prefixes = _twice(keyed.where("__met").select("__len", "__pre"), ["__len", "__pre"], "prefixes")
    marked = _tested(keyed, prefixes, ["__len", "__pre"], "__bit").withColumn("__twice", F.col("__met") & F.col("__bit"))
    alone = marked.where("not __twice").select(
        *cols, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # full content is hashed only where length and prefix occur twice
    rank = F.struct(F.col("__id"), F.monotonically_increasing_id().alias("__tie"))
    rows = cut(marked.where("__twice").select(*cols, "__len", "__pre", F.sha2(normalised("__text"), 256).alias("__full"),
                                              rank.alias("__rank")), "twice")  # written, so ties are broken once
    best = (rows.groupBy("__len", "__pre", "__full")
            .agg(F.max("__rank").alias("__best"), F.count("*").alias("group_size")))
    # sort-merge join: adaptive execution splits a hot group
    grouped = (rows.join(best, ["__len", "__pre", "__full"])
               .select(*cols, F.col("__best.__id").alias("keep_id"), "group_size",
                       F.col("__best").eqNullSafe(F.col("__rank")).alias("kept")))
    return alone.unionByName(grouped)
