"""D8 on candidate rows: conflict resolution for tables with one candidate a
row, where the candidates of one text may be more than one task should hold.

A running maximum of the ends cuts a text's candidates, in order of their
starts, into islands: a candidate that starts where all earlier ones have
ended is influenced by none of them.  So each island is resolved by itself,
and the islands of one text go to different tasks.

The running maximum itself is not taken over a whole text in one window:
candidates are dealt out by (text, chunk of positions), each chunk's largest
end is an aggregate, and a short window over the chunks of a text says what
reaches into a chunk from before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions.sqlx import ident
from scrubline.functions.stored import stored
from scrubline.operators.detect import resolve

#: Code points of a text whose candidates are ordered by one task.
CHUNK = 1 << 16


def _before(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """(keys, __chunk, out): the largest ``col`` of all earlier chunks of the text."""
    per = df.groupBy(*keys, "__chunk").agg(F.max(col).alias("m"))
    w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    return per.select(*keys, "__chunk", F.max("m").over(w).alias(out))


def islands(cands: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """``cands`` with ``island``, the start of the island a candidate is in.
    ``cands`` holds ``keys`` (not null) and start, end, rank, sub, seq."""
    rows = stored(cands.withColumn("__chunk", F.floor(F.col("start") / (chunk or CHUNK)).cast("long")), "islands")
    cols = [ident(c) for c in cands.columns]
    inner = Window.partitionBy(*keys, "__chunk").orderBy("start", "rank", "sub", "seq")
    reach = F.greatest(F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    flagged = rows.join(_before(rows, keys, "end", "__reach"), [*keys, "__chunk"])
    flagged = flagged.withColumn("__first", F.when(F.col("start") >= F.coalesce(reach, F.lit(0)), F.col("start")))
    flagged = stored(flagged.drop("__reach"), "islands")
    carried = flagged.join(_before(flagged, keys, "__first", "__open"), [*keys, "__chunk"])
    own = F.max("__first").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return carried.select(*cols, F.coalesce(own, "__open").alias("island"))


def resolve_islands(cands: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """The candidates that survive D8, with all their columns.

    ``cands`` holds one candidate a row: ``keys`` (they identify a text and
    are not null), start, end, prio and the order rank, sub, seq; no
    candidate is empty.  An empty table gives an empty result, a repeated
    candidate yields to its first copy.  One task holds one island.
    """
    first = ["start", "rank", "sub", "seq", "end", "prio"]
    rest = [c for c in cands.columns if c not in first and c not in keys]
    one = F.struct(*[F.col(ident(c)) for c in [*first, *rest]])
    met = islands(cands, keys, chunk).groupBy(*[ident(k) for k in keys], "island").agg(F.array_sort(F.collect_list(one)).alias("c"))
    kept = met.selectExpr(*[ident(k) for k in keys], f"inline_outer({resolve('`c`')})")
    return kept.select(*[F.col(ident(c)) for c in cands.columns])
