"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product reaches
``ETA``.  Directions are structured random product codes: in each of
``TABLES`` random rotations the space is cut into two halves with
``CODES`` random code words each, and every pair of words is a direction.  A vector
is list-decoded to all directions it exceeds: a word of the first half is
followed up only if the best word of the second can still reach the
threshold.  Vectors meet on (label, filter) and every pair that meets is
verified in double precision.

At a cosine of 0.93 a pair shares no filter of one table with probability
0.64, of all tables with less than 1e-6, closer pairs far less often.
A pair that meets in several filters counts in the first they share, which
a task finds again from the code words, so no pair is ever listed.  Equal
vectors are one class; a bucket over BLOCK vectors is dealt out in pairs
of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scrubline.llm.common import cut, map_runs, q, small_batches
from scrubline.llm.components import components

TABLES, CODES, ETA = 32, 16, 2.5
BLOCK = 2048
SEED = 3

_CODES: dict[int, tuple] = {}


def code_words(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(dim, TABLES * CODES) directions of the words of either half, by dimension."""
    if dim not in _CODES:
        rng = np.random.default_rng([SEED, dim])
        half = (dim + 1) // 2
        first, second = [], []
        for _ in range(TABLES):
            turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            first.append(turn[:, :half] @ rng.normal(size=(half, CODES)))
            second.append(turn[:, half:] @ rng.normal(size=(dim - half, CODES)))
        _CODES[dim] = np.concatenate(first, 1), np.concatenate(second, 1)
    return _CODES[dim]


def list_decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that unit vectors exceed."""
    first, second = code_words(x.shape[1])
    a = (x @ first).reshape(len(x), TABLES, CODES)
    b = (x @ second).reshape(len(x), TABLES, CODES)
    row, tab, i = np.nonzero(a >= ETA - b.max(2, keepdims=True))  # first words that can still reach it
    hit, j = np.nonzero(b[row, tab] >= (ETA - a[row, tab, i])[:, None])
    return row[hit], (tab[hit] * CODES + i[hit]) * CODES + j


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component is taken out
    first, so no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(classes: DataFrame, kind: str) -> DataFrame:
    """(label, dim, filter, id, size, vec): a row for every filter a class
    passes, with its components as ``kind`` (float32 or float64)."""
    small_batches(classes.sparkSession, 1024)

    def run(batches):
        for t in batches:
            by_dim: dict[int, list] = {}
            emb = t.column(2).to_pylist()
            for k, e in enumerate(emb):
                by_dim.setdefault(len(e), []).append(k)
            for dim, at in by_dim.items():
                raw = np.array([emb[k] for k in at], kind)
                row, f = list_decode(_unit(raw))
                at = np.array(at)[row]
                vec = pa.array([v.tobytes() for v in raw], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(at)), pa.array(np.full(len(f), dim, np.int32)), pa.array(f.astype(np.int32)),
                                                  t.column(1).take(pa.array(at)), t.column(3).take(pa.array(at)), vec],
                                                 ["label", "dim", "filter", "id", "size", "vec"])

    lab = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "id", "embedding", "size").mapInArrow(run, f"label {lab}, dim int, filter int, id long, size long, vec binary")


def _roots(near: np.ndarray) -> np.ndarray:
    """Component number of each row of a symmetric boolean matrix."""
    n = len(near)
    root = np.full(n, -1)
    for s in range(n):
        if root[s] < 0:
            reach = np.zeros(n, bool)
            front = np.zeros(n, bool)
            front[s] = True
            while front.any():
                reach |= front
                front = near[front].any(0) & ~reach
            root[reach] = s
    return root


def linked(filters: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(id, w, root): for every bucket and member with a link, the rows that
    it links with for the first time there, and a member of its component."""
    key = ["label", "dim", "filter"]
    # a count of narrow rows first: vectors alone in a bucket are not moved
    size = filters.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").select(*key, F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    m = filters.join(size, key)
    m = m.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    m = m.select(*key, F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"), "blk", "id", "size", "vec")

    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2:
            return None
        x = _unit(np.frombuffer(b"".join(g["vec"]), kind).reshape(len(g), -1))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        b1, b2, blk = g["b1"].iloc[0], g["b2"].iloc[0], g["blk"].to_numpy()
        if b1 != b2:  # two blocks: pairs within a block belong to another group
            near &= blk[:, None] != blk[None, :]
        has = np.nonzero(near.any(1))[0]
        if not len(has):
            return None
        near, x = near[np.ix_(has, has)], x[has]
        ids, w = g["id"].to_numpy()[has], g["size"].to_numpy()[has].astype(np.float64)
        # the first filter two vectors share is the one that counts them
        row, f = list_decode(x)
        before = f < g["filter"].iloc[0]
        cols, f = np.unique(f[before], return_inverse=True)
        member = np.zeros((len(has), len(cols)), np.float32)
        member[row[before], f] = 1
        member = member[:, member.sum(0) > 1]
        counted = near & ~((member @ member.T) > 0)
        root = _roots(near)
        low = np.array([ids[root == r].min() for r in np.unique(root)])
        return pd.DataFrame({"id": ids, "w": (counted @ w).astype(np.int64), "root": low[np.searchsorted(np.unique(root), root)]})

    return map_runs(m, [*key, "b1", "b2"], one, "id long, w long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id): one row per input row; vectors of one
    label and dimension link at a cosine of at least ``threshold``.

    A null id, label or vector, an empty or zero vector and one with a null
    or non-finite component links with nothing.  A repeated row counts as
    another vector.  Pairs exactly at the threshold link.  Components are
    used as they are given, floats or doubles, however large or small.  An
    empty table gives an empty result; other columns are ignored.
    """
    double = getattr(df.schema[vec_col].dataType, "elementType", None) == DoubleType()
    kind = "float64" if double else "float32"
    given = F.col(q(vec_col)) if double else F.col(q(vec_col)).cast("array<float>")
    v = df.select(F.col(q(id_col)).cast("long").alias("id"), F.col(q(label_col)).alias("label"), given.alias("embedding"))
    # in one dimension only the sign counts: the vectors of a sign are one class
    v = v.withColumn("embedding", F.when(F.size("embedding") == 1, F.transform("embedding", lambda x: F.signum(x).cast("double" if double else "float"))).otherwise(F.col("embedding")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(~bad, F.lit(False))
            & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = cut(v.where("good").groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("size")), "vec")
    pairs = cut(linked(cut(_filters(classes, kind), "caps"), threshold, kind), "links")
    degree = pairs.groupBy("id").agg(F.sum("w").alias("w"))
    comp = components(pairs.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = (classes.join(degree, "id", "left").join(comp, "id", "left")
           .select("label", "embedding", (F.col("size") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"),
                   F.coalesce("component_id", "id").alias("component_id")))
    linking = v.where("good").join(per, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = v.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linking.unionByName(alone)


ORACLE_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
e AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
                   WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.id = c.c AS kept
FROM c LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) n ON n.a = c.id
"""
