"""Importance resampling towards a target distribution of hashed n-grams.

A document's features are its runs of 1 to ``max_n`` consecutive words,
hashed by CRC-32 into buckets.  Every document is scanned once in its
separator-normalised form (words joined by one space), and the running CRC
is stored before and after each word.  The CRC of any run of words follows
from two of these prefixes: over GF(2) the CRC of a prefix, shifted by as
many zero bytes as the run has, cancels out of the CRC of the longer prefix.
So no n-gram is ever built or hashed as a string.

Two passes over the texts: one counts the buckets of the corpus and of the
target texts, one weighs each document by the mean log ratio of its
features.  A Gumbel variable hashed from the document's id turns the weights
into a draw without replacement: the highest scores are drawn.
"""

from __future__ import annotations

from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import cut, q, small_batches

#: Production setting of the registered query.
MAX_N, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
#: Scores per block of the two-level running count over the score histogram.
SCORE_BLOCK = 512
#: A-Z folded, everything but letters, digits and bytes of non-ASCII characters is a separator.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _byte_table() -> np.ndarray:
    """CRC register after one more zero byte, by the register's low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map over GF(2), kept as one table a byte of its argument."""
    return op[0][x & 255] ^ op[1][(x >> 8) & 255] ^ op[2][(x >> 16) & 255] ^ op[3][x >> 24]


def _shift_maps(n: int = 48) -> list[np.ndarray]:
    """Maps of a CRC past 2^k zero bytes, each the square of the one before."""
    t = _byte_table()
    x = np.arange(256, dtype=np.uint32)
    op = np.stack([t[(x << (8 * i)) & 255] ^ ((x << (8 * i)) >> 8) for i in map(np.uint32, range(4))])
    out = [op]
    for _ in range(n - 1):
        op = _apply(op, op)
        out.append(op)
    return out


_SHIFT = _shift_maps()


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Every CRC moved past its number of zero bytes."""
    out, n, k = crc.astype(np.uint32), zeros.astype(np.int64), 0
    while n.any():
        odd = np.nonzero(n & 1)[0]
        out[odd] = _apply(_SHIFT[k], out[odd])
        n, k = n >> 1, k + 1
    return out


def scan(texts: Iterable[str | None]):
    """(document, before, after, start, end) of the words of a batch: the
    running CRC of the normalised document before and after each word, and
    the word's byte range in it (documents stand one behind the other)."""
    doc, before, after, size = [], [], [], []
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
        c = 0
        for w in words:
            before.append(c)
            c = crc32(w, c)
            after.append(c)
            c = crc32(b" ", c)
        size.extend(map(len, words))
        doc.append((i, len(words)))
    ids, n = (np.array(v, np.int64) for v in zip(*doc)) if doc else (np.empty(0, np.int64),) * 2
    size = np.array(size, np.int64)
    end = np.cumsum(size + 1) - 1
    return np.repeat(ids, n), np.array(before, np.uint32), np.array(after, np.uint32), end - size, end, n


def features(texts: Iterable[str | None], max_n: int):
    """(document, CRC) of every run of 1 to ``max_n`` words, and the words of each text."""
    doc, before, after, start, end, n = scan(texts)
    docs, crcs = [], []
    for k in range(max_n):
        a = np.arange(max(0, len(doc) - k))
        a = a[doc[a] == doc[a + k]]  # runs never leave their document
        docs.append(doc[a])
        crcs.append(after[a + k] ^ shifted(before[a], end[a + k] - start[a]))
    return np.concatenate(docs), np.concatenate(crcs), n


def bucket_counts(df: DataFrame, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n): one row a bucket that occurs; each task sends at most one row a bucket."""
    small_batches(df.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for t in batches:
            _, crc, _ = features(t.column(0).to_pylist(), max_n)
            total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    part = df.select(F.col(q(text_col)).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, max_n: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed target share over its corpus
    share.  The result has ``buckets`` numbers, whatever the corpus: that is
    what reaches the driver."""
    c = bucket_counts(docs, text_col, max_n, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    c = c.unionByName(bucket_counts(target, target_col, max_n, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    c = cut(c.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = c.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    all_ = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(c, "bucket", "left").na.fill(0).join(F.broadcast(total))
    d = lambda name, add: F.col(name).cast("double") + F.lit(float(add))
    gain = F.floor(F.lit(1000.0) * F.log(d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))))
    rows = all_.select("bucket", gain.cast("long").alias("g")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.g for r in rows]
    return out


def gumbel(id_: Column, seed: int) -> Column:
    """A Gumbel variable, in thousandths, from 32 bits of a SHA-256 of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, max_n: int) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each document's features."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches):
        g = shared.value
        for t in batches:
            doc, crc, n = features(t.column(1).to_pylist(), max_n)
            k = np.bincount(doc, minlength=t.num_rows)
            total = np.zeros(t.num_rows, np.int64)
            np.add.at(total, doc, g[crc % np.uint32(len(g))])
            w = np.where(k > 0, total // np.maximum(k, 1), 0)  # // goes down
            yield pa.RecordBatch.from_arrays([t.column(0), *(pa.array(v, pa.int64()) for v in (n, k, w))], ["id", "n_words", "n_features", "weight"])

    src = docs.select(F.col(q(id_col)).cast("long").alias("id"), F.col(q(text_col)).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def draw_highest(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... over the floor(percent * N / 100)
    highest scores of the N rows with ``min_words`` words, else null.

    Scores are whole numbers: their histogram, far smaller than the rows,
    tells where each score's ranks begin, so only the drawn rows are sorted,
    score by score, and no task sees all of them.
    """
    fit = F.col("n_words") >= min_words
    hist = scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / SCORE_BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n").alias("m"))
    total = blocks.agg(F.floor(F.sum("m") * percent / 100).cast("long").alias("k"))
    # blocks: the range of the scores over SCORE_BLOCK, some hundreds of rows for any corpus
    above = F.coalesce(F.sum("m").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = (hist.join(F.broadcast(blocks.select("block", above.alias("above"))), "block")
             .select("score", (F.col("above") + inner).alias("before")).join(F.broadcast(total)).where("before < k"))
    first = cut(first, "ranks")
    # one row a drawn score: the range of scores bounds it; Spark picks the join by its size
    got = scored.join(first, "score", "left").withColumn("__in", fit & F.col("before").isNotNull())
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features"))
    drawn = got.where("__in").withColumn("rank", place)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("k"), F.col("rank")).cast("long"))
    rest = got.where(~F.col("__in")).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*scored.columns, "rank")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
                        max_n: int = 2, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): one row per input row;
    ``rank`` is null for rows that are not drawn.

    Null, empty and wordless texts have no features and the weight 0; texts
    with fewer than ``min_words`` words are weighed and never drawn.  Ties of
    score go to the smaller id, a null id comes last (its Gumbel variable is
    that of the empty string), repeated rows keep their own ranks.  Very long
    texts are scanned whole.  An empty target or corpus gives smoothed shares
    only; an empty table an empty result.  Other columns are ignored.
    """
    gains = bucket_gains(docs, target, text_col, target_col, max_n, buckets)
    w = weigh(docs, gains, id_col, text_col, max_n)
    scored = cut(w.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored")
    return draw_highest(scored, percent, min_words)


ORACLE_SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, unnest(w) AS x FROM w),
v AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM b)),
v2 AS (SELECT x, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)] AS h FROM v),
c AS MATERIALIZED (SELECT x, xor(4294967295, list_reduce(h, lambda a, y: list_reduce(range(8),
       lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(a, y)), 4294967295)) % {BUCKETS} AS bucket FROM v2),
s AS (SELECT bucket, count(*) AS n FROM f JOIN c USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN c USING (x) GROUP BY bucket),
g AS MATERIALIZED (SELECT c.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
       / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS g
     FROM (SELECT DISTINCT bucket FROM c) c LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM f JOIN c USING (x) JOIN g USING (bucket) GROUP BY doc_id),
d AS MATERIALIZED (SELECT w.doc_id, len(w.w) AS n_features, coalesce(floor(m.g::DOUBLE / m.n), 0)::BIGINT AS weight,
       ('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (doc_id)),
e AS MATERIALIZED (SELECT doc_id, n_features::BIGINT AS n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= {MIN_WORDS})
SELECT e.*, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM r) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
