"""The corpus pipeline: documents to token ids in five stages.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of
``documents`` (and any others), works on all rows it is given and returns
the same columns, but for the last, which returns the encoded documents.
Between the stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import exact_dedup, language_id, minhash_odd, mixing, piece_wfst
from scrubline.llm.common import cut, drop_cut, scratch, table

#: Not expressible in SQL: trained text model, MinHash, transducer.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts without letters, texts
    that no language explains and null texts go."""
    ren = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of the input cannot clash with results
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = language_id.identify_language(ren, at["text"], at["lang"], at["source"]).where("lang_kept")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id."""
    ren = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = exact_dedup.exact_dedup(ren, at["doc_id"], at["text"]).where("kept")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of at least 0.8 (five-word
    shingles), the row with the smallest doc_id; a null id comes last, and of
    equal ids one row stays.  Texts without words stay."""
    ren = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    # ids may be null or stand on several texts: rows are told apart by a written key
    rows = cut(ren.withColumn("row", F.monotonically_increasing_id()), "rows")
    r = minhash_odd.near_duplicates(rows, "row", at["text"]).select(F.col("id").alias("row"), "component_id")
    r = cut(r.join(rows.select("row", F.col(at["doc_id"]).alias("id")), "row"), "near")
    first = r.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")).select("m.row")
    # written, so Spark knows its size and moves no text while it is small
    gone = cut(r.select("row").join(first, "row", "left_anti"), "gone")
    out = rows.join(gone, "row", "left_anti")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target shares, in
    global random order."""
    ren = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = mixing.mix_sources(ren, at["doc_id"], at["text"], at["source"])
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its id, language and source."""
    out = piece_wfst.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "ids", "n_tokens", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_to_weights),
    ("piece_encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the encoded documents.  What a
    stage writes for itself goes when its result is written, and a result
    when the next one is; the last is read by the rows returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as written:
            out = cut(stage(spark, docs, sf_dir), name)
            written.remove(out)
        drop_cut(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
