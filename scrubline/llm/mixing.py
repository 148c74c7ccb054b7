"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable with the mean
``target share / present share`` of its source says.  The variable is the
inverse of the Poisson distribution at a uniform number hashed from (seed,
document), so a retried task, another partitioning or another run draws the
same counts.  Means above ``CHUNK`` are drawn as sums of independent parts,
so the inversion takes a bounded number of steps and never underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import cut, q

#: Largest mean inverted in one piece.
CHUNK = 8.0
#: Production setting: shares proportional to (documents of the source)^ALPHA.
ALPHA = 0.5
SEED = 20240601


def _unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of an md5."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(mean: Column, key: Column, seed: int = SEED) -> Column:
    """The hash-seeded Poisson count of ``key``: for each part the smallest k
    whose distribution function exceeds the uniform number."""
    parts = F.greatest(F.ceil(mean / CHUNK), F.lit(1)).cast("int")
    lam = mean / parts
    def one(part):
        u = _unit(F.lit(seed), key, part)
        start = F.struct(F.lit(0).alias("k"), F.exp(-lam).alias("p"), F.exp(-lam).alias("c"))
        # 64 steps reach beyond 1 - 2^-52 for every mean up to CHUNK
        step = lambda s, i: F.when(s["c"] > u, s).otherwise(
            F.struct(i.alias("k"), (s["p"] * lam / i).alias("p"), (s["c"] + s["p"] * lam / i).alias("c")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["k"])
    return F.aggregate(F.transform(F.sequence(F.lit(0), parts - 1), one), F.lit(0), lambda a, x: a + x)


def repetition_rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None,
                     alpha: float = ALPHA) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its target
    share while the expected total stays the number of documents.
    ``weights`` gives target weights by source (a source not named gets 0);
    without it a source weighs (its documents)^alpha."""
    n = docs.groupBy(F.col(q(source_col)).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        w = n.withColumn("w", F.coalesce(m[F.col("__source")], F.lit(0.0)))
    total = w.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    # one total row: a broadcast of a single row
    return (w.join(F.broadcast(total)).select(
        "__source", F.when(F.col("tw") > 0, F.round(F.col("w") / F.col("tw") * F.col("tn") / F.col("n"), 9))
        .otherwise(F.lit(0.0)).alias("__rate")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: dict | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The replicated documents in global random order: the input's columns,
    ``copy_no`` (0-based) and ``shuffle_key`` (the order).

    A null source is a source of its own.  A null id is replaced by the
    text's md5 as the seed (null text: empty).  Repeated rows draw the same
    count each.  Empty and very long texts count as one document like any
    other; an empty table gives an empty result.  An input column called
    like a result column is replaced by it.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("copy_no", "shuffle_key")])
    cols = [F.col(q(c)) for c in docs.columns]
    # a row a source, written: Spark knows its size and moves no text for the join while it is small
    rates = cut(repetition_rates(docs, source_col, weights, alpha), "rates")
    key = F.coalesce(F.col(q(id_col)).cast("string"), F.md5(F.coalesce(F.col(q(text_col)), F.lit(""))))
    # with very many sources a shuffle join, where adaptive execution splits a hot one
    joined = docs.join(rates, docs[q(source_col)].eqNullSafe(rates["__source"]))
    counted = joined.withColumn("__k", poisson_count(F.col("__rate"), key, seed)).where("__k > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}s"), key, F.col("copy_no").cast("string"))), 1, 15), 16, 10)
    out = copies.select(*cols, "copy_no", order.cast("long").alias("shuffle_key"))
    return out.orderBy("shuffle_key", q(id_col), "copy_no")


ORACLE_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source),
r AS (SELECT source, round(w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n, 9) AS rate FROM n),
d AS (SELECT doc_id, d.source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key, rate,
             greatest(ceil(rate / {CHUNK}), 1)::INT AS parts
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT DISTINCT key, rate, rate / parts AS lam, part,
             ('0x' || substr(md5('{SEED}|' || key || '|' || part), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE AS u
      FROM (SELECT *, unnest(range(parts)) AS part FROM d)),
s AS (SELECT key, rate, part, u, lam, 0 AS k, exp(-lam) AS p, exp(-lam) AS c FROM p
      UNION ALL SELECT key, rate, part, u, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) FROM s WHERE c <= u AND k < 64),
k AS (SELECT key, rate, sum(k) AS n FROM (SELECT key, rate, part, max(k) AS k FROM s GROUP BY ALL) GROUP BY ALL),
x AS (SELECT d.doc_id, d.source, d.key, unnest(range(k.n::BIGINT)) AS copy_no FROM d JOIN k ON d.key = k.key AND d.rate = k.rate)
SELECT doc_id, source, copy_no::INT AS copy_no,
       ('0x' || substr(md5('{SEED}s|' || key || '|' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM x
"""
