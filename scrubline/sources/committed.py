"""A7/A9 with a commit: exports that are visible whole or not at all.

An export is written to a folder of its own; only when Spark has committed
it, its files are listed with their rows in a manifest, and the manifest,
one file that appears at once, makes it the current export.  Readers follow
the newest manifest, so a job that failed or is still running leaves nothing
they could see, and an export replaces the one before without a gap.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("json", "csv", "parquet", "text")
MANIFEST = "export string, format string, columns string, file string, rows long, place long"


def _options(writer, fmt: str):
    return writer.option("header", True).option("escape", '"') if fmt == "csv" else writer


def export_committed(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Writes ``df`` as a new export under ``path`` and commits it; returns
    its name.  For csv and text, columns must be of simple types (``to_json``
    others first); text takes one string column.  An empty table is an export
    without files."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    spark, name = df.sparkSession, uuid.uuid4().hex
    home = f"{path}/data/{name}"
    _options(df.write, fmt).format(fmt).save(home)
    back = spark.read.schema(df.schema).option("header", True).format(fmt).load(home) if fmt != "text" else spark.read.text(home)
    files = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    place = len(_manifests(spark, path))
    rows = files.select(F.lit(name).alias("export"), F.lit(fmt).alias("format"), F.lit(df.schema.json()).alias("columns"), "file", "rows", F.lit(place).cast("long").alias("place"))
    head = spark.createDataFrame([(name, fmt, df.schema.json(), None, None, place)], MANIFEST)
    rows.unionByName(head).coalesce(1).write.parquet(f"{path}/manifests/{place:08d}-{name}")  # a row a file
    return name


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """The committed manifests, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{n}/_SUCCESS"))]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the current export: a row a file."""
    names = _manifests(spark, path)
    if not names:
        raise FileNotFoundError(f"no committed export at {path}")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{names[-1]}")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current export, from the files its manifest lists."""
    from pyspark.sql.types import StructType
    m = manifest(spark, path)
    head = m.where("file IS NULL").first()
    schema = StructType.fromJson(json.loads(head.columns))
    home = f"{path}/data/{head.export}"
    df = spark.read.option("header", True).option("escape", '"').schema(schema).format(head.format).load(home)
    listed = m.where("file IS NOT NULL").select(F.col("file").alias("__file"))
    return df.withColumn("__file", F.col("_metadata.file_name")).join(listed, "__file", "left_semi").drop("__file")
