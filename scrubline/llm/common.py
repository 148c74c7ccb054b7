"""Helpers shared by the operators: table reads, written intermediate
tables in the shared folder, Arrow batch size and safe input columns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.session import checkpoint_dir

#: Rows per Arrow batch for operators that carry whole texts: a batch of
#: ordinary documents is about 1 MB, and a long text costs only itself.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per Spark context, so Python
    workers import it wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_scrubline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="scrubline-"), "scrubline.zip")  # the driver serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._scrubline_shipped = True


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Before Python stages: few rows per Arrow batch bound the memory of the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_held: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that ``cut`` writes inside the block are deleted at its end,
    but for those the block removes from the list it is given."""
    _held.append([])
    try:
        yield _held[-1]
    finally:
        for t in _held.pop():
            drop_cut(t)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared folder named by
    ``spark.checkpoint.dir`` and reads it back, so a lost executor costs a
    re-read and not a recomputation.  The write is the only action."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _held:
        _held[-1].append(out)
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes a table written by ``cut`` that no later step reads."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(col):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def q(name: str) -> str:
    """A column name quoted for expressions (names may hold dots)."""
    return "`" + name.replace("`", "``") + "`"


def map_runs(df: DataFrame, keys: list[str], fn, schema: str, order: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """``fn(pandas frame) -> pandas frame`` for every group of ``keys``.

    The rows are dealt out by key and sorted, and each task walks the runs
    of equal keys in its stream, so very many small groups cost no call into
    Python each.  Only one group at a time is held: callers bound its size.
    ``tasks`` deals the rows to so many tasks, where the work of a row is far
    more than its bytes tell.
    """
    import pandas as pd

    ship(df.sparkSession)
    dealt = df.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *(order or []))

    def run(frames):
        rest = None
        for f in frames:
            if rest is not None:
                f = pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            k = f[keys]
            new = (k != k.shift()).any(axis=1).to_numpy()
            at = new.nonzero()[0].tolist()
            rest = f.iloc[at[-1]:]  # may go on in the next batch
            out = [fn(f.iloc[a:b]) for a, b in zip(at, at[1:])]
            out = [o for o in out if o is not None and len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest):
            o = fn(rest)
            if o is not None and len(o):
                yield o

    return dealt.mapInPandas(run, schema)
