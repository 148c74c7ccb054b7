"""F6 over a large audit log: substring search by a trigram index.

The log is kept in blocks of entries that came together.  For each block the
index holds the trigrams of everything a search looks at, as rows (gram,
block) in folders by a hash of the gram.  A search reads the folders of its
term's trigrams, keeps the blocks that have all of them, reads only those
blocks of the log and verifies.  A term of fewer than three characters has
no trigram: it is answered by a scan.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.stored import stored
from scrubline.operators.audit import AUDIT_SCHEMA, search
from scrubline.operators.wordscan import BATCH_ROWS, NONE, code_points

#: Entries of a block, and folders of the index.
BLOCK_ENTRIES, FOLDERS = 1000, 64
#: Trigrams that a table of flags may tell apart; of larger alphabets they are sorted.
TABLE = 1 << 26


def _searched() -> Column:
    """The distinct strings that ``audit.search`` looks at, in lower case."""
    dets = F.coalesce(F.flatten(F.transform("detections", lambda d: F.array(d["rule_name"], d["match"]))), F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.array("original_text", "sanitized_text"), dets), lambda s: F.lower(F.coalesce(s, F.lit("")))))


def _trigrams(texts: list[str]) -> list[str]:
    """The distinct trigrams of some strings; none crosses from one into the next."""
    cps = np.full(sum(len(t) + 1 for t in texts), NONE, np.int64)
    at = 0
    for t in texts:
        cps[at:at + len(t)] = code_points(t)
        at += len(t) + 1
    if len(cps) < 3:
        return []
    met = np.zeros(NONE + 1, bool)
    met[cps] = True
    alphabet = np.flatnonzero(met)
    n, place = len(alphabet), np.zeros(NONE + 1, np.int32)
    place[alphabet] = np.arange(n, dtype=np.int32)
    c = place[cps].astype(np.int64)
    code = (c[:-2] * n + c[1:-1]) * n + c[2:]
    if n ** 3 <= TABLE:
        seen = np.zeros(n ** 3, bool)
        seen[code] = True
        code = np.flatnonzero(seen)
    else:
        code = np.unique(code)
    three = alphabet[np.stack([code // (n * n), code // n % n, code % n], axis=1)]
    three = three[(three != NONE).all(axis=1)]
    joined = three.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i:i + 3] for i in range(0, len(joined), 3)]


def _block_grams(log: DataFrame) -> DataFrame:
    """(block, gram): the trigrams of the blocks of a log, distinct within a
    batch of rows."""
    def run(batches):
        for t in batches:
            block, texts = t.column(0).to_pylist(), t.column(1)
            cuts = [i for i in range(len(block)) if i == 0 or block[i] != block[i - 1]] + [len(block)]
            for a, b in zip(cuts, cuts[1:]):
                grams = _trigrams(texts.slice(a, b - a).flatten().to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([block[a]] * len(grams), pa.string()), pa.array(grams, pa.string())], ["block", "gram"])

    log.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return log.select("block", _searched().alias("texts")).mapInArrow(run, "block string, gram string")


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def append_indexed(entries: DataFrame, path: str, block_entries: int = BLOCK_ENTRIES) -> None:
    """A5 with an index: appends entries to the log at ``path`` in blocks, as
    they come (a stream comes in the order of time), and their trigrams to its
    index.  No entry is shuffled.  The index is written last; a log block
    without one is found by no indexed search, so an append that failed is
    simply repeated."""
    batch = uuid.uuid4().hex
    at = F.monotonically_increasing_id()  # partition and place in it
    name = F.concat_ws("-", F.lit(batch), F.shiftright(at, 33), F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / block_entries))
    entries.withColumn("block", name).write.mode("append").option("compression", "zstd").partitionBy("block").parquet(f"{path}/log")
    spark = entries.sparkSession
    new = _log(spark, path).where(F.col("block").startswith(batch))
    grams = _block_grams(new).withColumn("folder", _folder(F.col("gram")))
    # dealt by folder, so a folder is written by one task; equal rows meet there
    grams.repartition(FOLDERS, "folder").distinct().write.mode("append").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/grams")


def _log(spark: SparkSession, path: str) -> DataFrame:
    schema = AUDIT_SCHEMA.fields
    return spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", block string").parquet(f"{path}/log")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries of an indexed log."""
    return _log(spark, path).drop("block")


def candidate_blocks(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """The blocks that hold all trigrams of a term; None if it has none."""
    t = term.lower()
    grams = sorted({t[i:i + 3] for i in range(len(t) - 2)})
    if not grams:
        return None
    index = spark.read.schema("gram string, block string, folder int").parquet(f"{path}/grams")
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    held = index.where(F.col("folder").isin(folders) & F.col("gram").isin(grams)).select("block", "gram").distinct()
    return held.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("block")


def search_indexed(spark: SparkSession, path: str, term: str) -> DataFrame:
    """F6 on an indexed log: the entries that ``audit.search`` finds.  The
    blocks are joined on the log's partition column, so Spark prunes its
    folders at run time; an empty term finds all entries."""
    log = _log(spark, path)
    blocks = candidate_blocks(spark, path, term)
    if blocks is not None:
        log = log.join(stored(blocks, "blocks"), "block", "left_semi")
    return search(log.drop("block"), term)
