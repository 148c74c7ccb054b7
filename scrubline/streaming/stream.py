"""Structured Streaming (H1-H3).

Sanitizing is stateless and row-local, so the streaming plan is the batch
plan on ``readStream``: file source -> sanitize -> file sink, append mode,
exactly-once through the checkpoint.  The debounce setting of the original
(300 ms) maps to a processing-time trigger; tests and the driver use
``availableNow``.  The audit stream (H2) appends audit rows per micro-batch
with ``foreachBatch`` (idempotent on batch id: each batch writes its own
folder).  Every stream takes a ``name``: its checkpoint and output live
under that name in ``spark.checkpoint.dir``, so starting it again goes on
where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.operators.detect import Options
from scrubline.operators.rules import Rule
from scrubline.operators.sanitize import sanitize
from scrubline.session import checkpoint_dir

DEFAULT_DEBOUNCE = "300 milliseconds"


def sanitize_stream(stream: DataFrame, text: str, rules: list[Rule], opts: Options | None = None) -> DataFrame:
    """H1: the sanitize operator on a streaming DataFrame."""
    return sanitize(stream, text, rules, opts)


def stream_home(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def run_file_stream(spark: SparkSession, directory: str, text: str, rules: list[Rule], keys: list[str], name: str,
                    opts: Options | None = None, fmt: str = "parquet", files_per_trigger: int = 1,
                    glob: str | None = None) -> DataFrame:
    """Read the files of ``directory`` (optionally only those matching
    ``glob``) as a file stream, sanitize, write to a parquet sink under the
    shared checkpoint folder with ``availableNow``, and return the sink as a
    batch DataFrame.  Run again under its ``name`` it takes only new files."""
    base = stream_home(spark, name)
    reader = spark.read.format(fmt)
    stream_reader = spark.readStream.format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
        stream_reader = stream_reader.option("pathGlobFilter", glob)
    schema = reader.load(directory).schema
    src = stream_reader.schema(schema).load(directory)
    out = sanitize_stream(src, text, rules, opts).select(*keys, text, "sanitized", "detections_count")
    q = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", base + "/_checkpoint").option("path", base + "/out")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(base + "/out")


def audit_stream(spark: SparkSession, stream: DataFrame, text: str, id_col: str, ts_col: str, rules: list[Rule],
                 audit_path: str, name: str, opts: Options | None = None, trigger: str = DEFAULT_DEBOUNCE,
                 available_now: bool = False):
    """H2 + H3: sanitize a stream and append audit rows per micro-batch
    (processing-time trigger = the debounce; ``available_now`` drains the
    source once, for batch-like runs and tests).  The checkpoint belongs to
    ``name``, and a batch writes ``audit_path/stream=<name>/batch=<id>``: a
    batch that is tried again replaces itself only, a restart goes on with
    the next id, and other streams may share the audit path."""
    from scrubline.operators.audit import audit_entries
    san = sanitize_stream(stream, text, rules, opts)

    def write_batch(batch: DataFrame, batch_id: int):
        entries = audit_entries(batch, F.col(id_col), F.col(ts_col), text)
        entries.write.mode("overwrite").parquet(f"{audit_path}/stream={name}/batch={batch_id}")

    w = san.writeStream.foreachBatch(write_batch).option("checkpointLocation", stream_home(spark, name) + "/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start()
