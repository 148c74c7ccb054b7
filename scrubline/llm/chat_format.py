"""Chat formatting with collapse of cumulative snapshots (DataFrame
functions only).

A logged conversation that is a prefix of a longer one (the same turns in
the same order, then more) is a snapshot of it.  A rolling hash of the turn
prefixes of every conversation gives the keys; an anti-join of the whole
conversations against the proper prefixes keeps the maximal ones, of equal
ones the smallest id, and those are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rendering of one turn.
TURN_OPEN, TURN_SEP, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, p1, p2, n): two 64-bit hashes of the first ``pos``
    turns, and the number of turns.  Only narrow rows are shuffled: a turn's
    text enters as its hash.  The hash of a prefix is the running xor of
    hashes of (position, turn), so it rolls in one pass over the turns."""
    t = turns.select(
        "conv_id", "turn",
        F.xxhash64(F.lit(1), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("t1"),
        F.xxhash64(F.lit(2), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("t2"),
    ).groupBy("conv_id", "turn", "t1", "t2").agg(F.lit(1).alias("__one")).drop("__one")  # repeated rows count once
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (t.withColumn("pos", F.row_number().over(w))
            .withColumn("p1", F.bit_xor(F.xxhash64("pos", "t1")).over(run))
            .withColumn("p2", F.bit_xor(F.xxhash64("pos", "t2")).over(run))
            .withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
            .select("conv_id", "pos", "p1", "p2", "n"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no proper prefix
    of another; of equal ones the smallest ``conv_id``."""
    p = rolling_prefixes(turns)
    whole = (p.where("pos = n").groupBy("pos", "p1", "p2")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")))
    proper = p.where("pos < n").select("pos", "p1", "p2").distinct()
    return (whole.join(proper, ["pos", "p1", "p2"], "left_anti")
            .select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations
    of a table (conv_id, turn, role, text).

    Turns are ordered by ``turn`` (null first), ties by their content hash.
    A row repeated within a conversation counts once.  A null role or text
    renders as empty; a null is not equal to an empty value when prefixes
    are compared.  Rows with a null ``conv_id`` form one conversation of
    their own.  Other columns are ignored; an empty table gives an empty
    result.  The rendering of one conversation is one output value and is
    the only thing gathered.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    keep = maximal_conversations(turns)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece = F.concat(F.lit(TURN_OPEN), role, F.lit(TURN_SEP), text, F.lit(TURN_CLOSE))
    h = [F.xxhash64(F.lit(k), role, F.col("role").isNull(), text, F.col("text").isNull()) for k in (1, 2)]
    # the order of rolling_prefixes: turn (null first), then the content hashes
    one = F.struct(F.col("turn").alias("turn"), h[0].alias("t1"), h[1].alias("t2"), piece.alias("piece"))
    k = keep.select(F.col("conv_id").alias("__id"), "n_turns", "n_copies")
    kept_turns = turns.join(k, turns.conv_id.eqNullSafe(k["__id"])).drop("__id")
    return (kept_turns.groupBy("conv_id", "n_turns", "n_copies")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_set(one)), lambda x: x["piece"]), "").alias("rendered")))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn, role, text) AS l, count(*) AS n,
             string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                        ORDER BY turn, role, text) AS rendered
      FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
m AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY l)
SELECT m.conv_id, c.n AS n_turns, m.n_copies, c.rendered FROM m JOIN c USING (conv_id)
"""
