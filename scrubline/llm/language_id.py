"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text (hashed letter trigrams
under a multinomial model per language), the declared markup language, the
suffix of the address, and a prior of the host.  The host prior is smoothed
through a hierarchy (host, registered domain, everything), and all counts
behind the priors and the evidence tables are grouped aggregations over
every row; only the trigram model is fitted on a bounded sample
(``FIT_DOCS`` per language, drawn by a hash of the text).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.llm.common import cut, q, small_batches

#: Documents per declared language the trigram model is fitted on (a bound in expectation).
FIT_DOCS = 1000
#: Documents with letters that a declared language needs to be a class: with fewer there is nothing to fit a model on.
MIN_DOCS = 10
#: Hash buckets of the trigram model, and the most cells (buckets by classes) that the driver and a
#: worker hold (128 MB): with more than MODEL_CELLS / BUCKETS classes there are fewer buckets.
BUCKETS, MODEL_CELLS = 1 << 14, 1 << 25
#: Weight of the text: log likelihoods count as TEXT_SCALE * sqrt(trigrams) independent ones.
TEXT_SCALE = 4.0
#: Pseudo-observations each level of the host hierarchy lends to the next.
HOST_KAPPA = 20.0
#: Additive smoothing of the declared-language and suffix tables.
ALPHA = 0.5
#: Documents whose best posterior is lower are rejected (language 'und').
MIN_POSTERIOR = 0.5
#: Hosts, suffixes or declared values whose tables are broadcast (8 bytes a class each; fewer if
#: there are more than 8 classes); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
UNDETERMINED = "und"
#: Code points handled at once: bounds the memory for very long texts.
BLOCK = 1 << 20


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of every trigram around a letter; lower case, all else is space."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c < 0x2E80)))
    c[~letter] = 32
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(18)).astype(np.int64)[letter[1:-1]]


def _blocks(text: str):
    for i in range(0, max(len(text), 1), BLOCK):
        yield text[i:i + BLOCK]


def subtag(declared: Column) -> Column:
    """The primary language subtag of a declared value, in lower case
    ('en-US', 'EN_gb' and 'en' are 'en'); null unless two or three letters."""
    t = F.lower(F.regexp_extract(F.trim(declared.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(t != "", t)


def languages(df: DataFrame, text_col: str, declared_col: str) -> list[str]:
    """The classes: language subtags declared by at least ``MIN_DOCS`` texts
    with letters, whatever their share of the rows.  Two or three letters
    bound their number; only the names reach the driver."""
    d = df.where(F.col(q(text_col)).rlike(r"\p{L}")).select(subtag(F.col(q(declared_col))).alias("l")).where("l IS NOT NULL")
    n = d.groupBy("l").agg(F.count("*").alias("n"))
    return sorted(r.l for r in n.where(F.col("n") >= MIN_DOCS).select("l").collect())


def fit_text_model(df: DataFrame, text_col: str, declared_col: str, langs: list[str]) -> np.ndarray:
    """log P(bucket | language), one column per language and a flat last one
    for texts in none of them.  At most MODEL_CELLS counts reach the driver."""
    buckets = min(BUCKETS, 1 << (MODEL_CELLS // (len(langs) + 1)).bit_length() - 1)
    classes = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(langs)), "l int, name string"))
    d = (df.select(subtag(F.col(q(declared_col))).alias("name"), F.col(q(text_col)).alias("x")).where(F.col("x").isNotNull())
         .join(classes, "name").select("l", "x"))
    n = d.groupBy("l").count()
    u = F.pmod(F.xxhash64("x", F.lit(7)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = d.join(F.broadcast(n), "l").where(u < F.lit(float(FIT_DOCS)) / F.col("count")).select("l", "x")

    def count(batches):
        acc = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = acc.setdefault(lang, np.zeros(buckets, np.int32))
                for part in _blocks(text):
                    a += np.bincount(trigram_buckets(part) & (buckets - 1), minlength=buckets).astype(np.int32)
        for lang, a in acc.items():
            at = np.nonzero(a)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(a[at], pa.int32())], ["l", "b", "n"])

    counts = sample.mapInArrow(count, "l int, b int, n int").groupBy("l", "b").agg(F.sum("n").cast("int").alias("n")).toArrow()
    table = np.zeros((buckets, len(langs) + 1), np.float32)
    table[counts["b"].to_numpy(), counts["l"].to_numpy()] = counts["n"].to_numpy()
    total = table.sum(0, dtype=np.float64) + 0.05 * buckets
    for c in range(len(langs)):  # column by column: no second table of its size
        table[:, c] = np.log((table[:, c].astype(np.float64) + 0.05) / total[c])
    table[:, -1] = -np.log(buckets)
    return table


def text_scores(df: DataFrame, text_col: str, model: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``__ll`` (tempered log likelihood by class) and
    ``__tri`` (number of trigrams)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # MODEL_CELLS floats at most
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField("__ll", T.ArrayType(T.DoubleType())), T.StructField("__tri", T.LongType())])
    src = df.select(*[F.col(q(c)) for c in keep], F.col(q(text_col)).alias("__text"))

    def score(batches):
        table = shared.value
        for b in batches:
            lls, tri = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                s, n = np.zeros(table.shape[1]), 0
                for part in _blocks(text or ""):
                    ids = trigram_buckets(part) & (len(table) - 1)
                    s += table[ids].sum(0, dtype=np.float64)
                    n += len(ids)
                lls.append((s * (min(n, TEXT_SCALE * n ** 0.5) / n)).tolist() if n else s.tolist())
                tri.append(n)
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(lls, pa.list_(pa.float64())), pa.array(tri, pa.int64())], b.schema.names[:-1] + ["__ll", "__tri"])

    return src.mapInArrow(score, out)


def _counts(rows: DataFrame, by: str, k: int) -> DataFrame:
    """(by, __c): for every value the rows of each class, as an array."""
    per = rows.where(F.col(by).isNotNull()).groupBy(by, "__top").agg(F.count("*").alias("n"))
    m = per.groupBy(by).agg(F.map_from_entries(F.collect_list(F.when(F.col("__top").isNotNull(), F.struct("__top", "n")))).alias("m"))
    return m.select(by, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("__c"))


def _totals(rows: DataFrame, k: int) -> list[int]:
    """The rows of each class: one number a class reaches the driver."""
    n = {r[0]: r[1] for r in rows.where("__top is not null").groupBy("__top").count().collect()}
    return [n.get(i, 0) for i in range(k)]


def _numbers(values) -> Column:
    """One constant array, whatever its length."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def _log_table(rows: DataFrame, col: str, k: int) -> DataFrame:
    """(col, lp): log P(value | language) for each language, smoothed; one
    row for every value, however rare."""
    per = cut(_counts(rows, col, k), "evidence")
    d = per.count()
    tot = _numbers(t + ALPHA * d for t in _totals(rows.where(F.col(col).isNotNull()), k))
    return per.select(col, F.zip_with("__c", tot, lambda c, t: F.log((c + ALPHA) / t)).alias(f"{col}_lp"))


def host_priors(rows: DataFrame, k: int) -> DataFrame:
    """(__host, __prior): P(language | host), each level smoothed by the one
    above: everything, registered domain (last two labels), host."""
    host = rows.where("__host is not null").withColumn("__dom", F.substring_index("__host", ".", -2))
    n = _counts(host, "__host", k).withColumn("__dom", F.substring_index("__host", ".", -2)).withColumnRenamed("__c", "__n")
    # the total also covers rows without a host
    g = _totals(rows, k)
    g = _numbers((x + 1) / (sum(g) + k) for x in g)
    smooth = lambda c, up: F.zip_with(c, up, lambda x, u: (x + HOST_KAPPA * u) / (F.aggregate(c, F.lit(0).cast("long"), lambda s, y: s + y) + HOST_KAPPA))
    dom = _counts(host, "__dom", k).select("__dom", smooth("__c", g).alias("__d"))
    return n.join(dom, "__dom").select("__host", smooth("__n", F.col("__d")).alias("__prior"))


def _joined(out: DataFrame, table: DataFrame, col: str, k: int) -> DataFrame:
    """``out`` with the row of its value.  A shuffle would move the texts: few
    values are broadcast; beyond the bound adaptive execution splits a hot one."""
    most = BROADCAST_HOSTS * 8 // max(k, 8)
    small = table.limit(most + 1).count() <= most
    return out.join(F.broadcast(table) if small else table, col, "left")


def identify_language(df: DataFrame, text_col: str = "text", declared_col: str | None = "lang",
                      host_col: str | None = "source", suffix_col: str | None = None,
                      keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``lang_id``, ``lang_posterior``
    and ``lang_kept`` for every row.

    A null declared language, host or suffix is no evidence.  A text without
    letters (null, empty, digits only) is undetermined: ``lang_id`` 'und',
    posterior of the best class on the other evidence, not kept.  So is a
    text that a flat trigram distribution explains better than every
    language, and one whose best posterior is below ``MIN_POSTERIOR``.  A
    declared value counts by its language subtag ('en-US' is 'en'); one that
    is no such tag, or is declared by fewer than ``MIN_DOCS`` texts, is no
    class: its texts get the class that explains them best, or 'und'.  The
    raw values stay evidence, however many there are.  Very
    long texts are scored whole in blocks.  Ties go to the first language in
    alphabetical order.  An empty table, or one without declared languages,
    gives rows that are all undetermined.  Repeated rows score alike; an
    input column called like a result column is replaced by it.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("lang_id", "lang_posterior", "lang_kept")])
    keep = [c for c in (keep or df.columns) if c in df.columns]
    cols = [F.col(q(c)) for c in keep]
    small_batches(df.sparkSession)
    langs = languages(df, text_col, declared_col) if declared_col else []
    if not langs:
        return df.select(*cols, F.lit(UNDETERMINED).alias("lang_id"), F.lit(0.0).alias("lang_posterior"), F.lit(False).alias("lang_kept"))
    k = len(langs)
    model = fit_text_model(df, text_col, declared_col, langs)
    null = F.lit(None).cast("string")
    named = df.select(*[F.col(q(c)) for c in df.columns],
                      (F.col(q(declared_col)) if declared_col else null).alias("__declared"),
                      (F.col(q(host_col)) if host_col else null).alias("__host"),
                      (F.col(q(suffix_col)) if suffix_col else null).alias("__suffix"))
    ev = ["__declared", "__host", "__suffix"]
    # one scoring pass over the text, written once: the counts and the fusion read its narrow columns
    scored = cut(text_scores(named, text_col, model, keep + ev), "lang")
    best_text = F.array_max(F.slice("__ll", 1, k))
    usable = (F.col("__tri") > 0) & (best_text >= F.col("__ll")[k])
    rows = (scored.withColumn("__ok", usable)
            .withColumn("__top", F.when(F.col("__ok"), (F.array_position(F.slice("__ll", 1, k), best_text) - 1).cast("int"))))
    out = rows.select(*cols, *ev, "__ll", "__ok")
    if declared_col:
        out = _joined(out, _log_table(rows, "__declared", k), "__declared", k)
    if suffix_col:
        out = _joined(out, _log_table(rows, "__suffix", k), "__suffix", k)
    if host_col:
        out = _joined(out, cut(host_priors(rows, k), "hosts"), "__host", k)
    for have, name in ((declared_col, "__declared_lp"), (suffix_col, "__suffix_lp"), (host_col, "__prior")):
        out = out if have else out.withColumn(name, F.lit(None).cast("array<double>"))
    zero = F.array_repeat(F.lit(0.0), k)
    lp = F.zip_with(F.slice("__ll", 1, k), F.coalesce("__declared_lp", zero), lambda a, b: a + b)
    lp = F.zip_with(lp, F.coalesce("__suffix_lp", zero), lambda a, b: a + b)
    lp = F.zip_with(lp, F.coalesce(F.transform("__prior", lambda p: F.log(p)), zero), lambda a, b: a + b)
    out = out.withColumn("__lp", lp).withColumn("__max", F.array_max("__lp"))
    post = 1.0 / F.aggregate("__lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__max")))
    name = F.element_at(F.from_json(F.lit(json.dumps(langs)), "array<string>"), F.array_position("__lp", F.col("__max")).cast("int"))
    kept = F.col("__ok") & (F.col("lang_posterior") >= MIN_POSTERIOR)
    return (out.withColumn("lang_posterior", post).withColumn("lang_kept", kept)
            .select(*cols, F.when(F.col("lang_kept"), name).otherwise(F.lit(UNDETERMINED)).alias("lang_id"), "lang_posterior", "lang_kept"))
