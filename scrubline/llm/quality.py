"""Quality classifier: random-indexing word vectors, pooled per document,
and a two-layer network with temperature-calibrated probabilities.

Every word has a random sparse index vector (from a hash of its letters
and its shape); the vector of a word is the sum of the index vectors of its
neighbours over the whole corpus.  The sums are whole numbers, so they do
not depend on partitioning.  Words are hashed into ``BUCKETS`` rows, so the
table has a fixed size.  Only the network is fitted on a bounded sample
(``FIT_ROWS`` labelled rows, drawn by a hash of the id).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import q, small_batches

BUCKETS, DIM, NONZERO = 8192, 32, 4
FEATURES = 2 * DIM + 3
#: Labelled rows the network is fitted on (a bound in expectation), and its size and training.
FIT_ROWS = 4000
HIDDEN, EPOCHS, RATE, DECAY = 24, 600, 0.02, 1e-3
#: Share of the sample that only sets the temperature.
CALIBRATE = 0.25
THRESHOLD = 0.7
#: Code points split at once, but for longer words, and bytes of a word beyond which it is coded by itself.
BLOCK, LONG = 1 << 20, 64


def index_vectors() -> np.ndarray:
    """(BUCKETS, DIM) ternary vectors, NONZERO entries each."""
    rng = np.random.default_rng(7)
    at = np.argsort(rng.random((BUCKETS, DIM)), 1)[:, :NONZERO]
    out = np.zeros((BUCKETS, DIM), np.int64)
    np.put_along_axis(out, at, rng.choice([-1, 1], (BUCKETS, NONZERO)), 1)
    return out


INDEX = index_vectors()
#: The places of the entries of each index vector: a positive one by its place, a negative one DIM further on.
ENTRIES = np.nonzero(np.hstack([INDEX > 0, INDEX < 0]))[1].reshape(BUCKETS, NONZERO)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
#: What stands for a code point in a shape, plus one; 0 where not asked yet.
_SHAPES = np.zeros(0x110000, np.uint32)


def _crc32(text: str, start: np.ndarray | int = 0) -> np.ndarray:
    """zlib.crc32 of the UTF-8 of every line of a text, from ``start`` on."""
    data = text.encode()
    b = np.frombuffer(data, np.uint8)
    end = np.append(np.nonzero(b == 10)[0], len(b))
    first = np.append(0, end[:-1] + 1)
    size = end - first
    out = np.zeros(len(end), np.uint32) + np.uint32(start)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    far = int((size > LONG).sum())
    for i in order[:far].tolist():
        out[i] = zlib.crc32(data[first[i]:end[i]], int(out[i]))
    order = order[far:]
    at, left, crc = first[order], -size[order], ~out[order]
    for j in range(LONG):
        n = int(np.searchsorted(left, -j, "left"))  # words of more than j bytes
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ b[at[:n] + j]) & 255] ^ (crc[:n] >> 8)
    out[order] = ~crc
    return out


def codes_of(words: pa.Array) -> np.ndarray:
    """The buckets of each word (lower case and shape) and of its shape, in
    one number; -1 for an empty string.  A shape has A, a and 0 for capitals,
    other letters and digits, and equal neighbours once."""
    lines = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py()
    points = np.frombuffer(lines.encode("utf-32-le"), np.uint32)
    for x in np.unique(points[_SHAPES[points] == 0]).tolist():
        c = chr(x)
        _SHAPES[x] = ord("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c) + 1
    shape = _SHAPES[points] - np.uint32(1)
    shape = shape[np.append(True, (shape[1:] != shape[:-1]) | (shape[1:] == 10))[:len(shape)]]
    s = _crc32(shape.tobytes().decode("utf-32-le"))
    code = _crc32(lines.lower(), s).astype(np.int64) % BUCKETS * BUCKETS + s.astype(np.int64) * 31 % BUCKETS
    return np.where(pc.binary_length(words).to_numpy(zero_copy_only=False) > 0, code, -1)


def blocks(column: pa.Array):
    """(texts, their rows): a column of texts, nulls as empty ones, with texts
    of more than BLOCK code points cut at white space."""
    column = column.fill_null("")
    size = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    if not (size > BLOCK).any():
        return column, np.arange(len(column))
    parts, rows = [], []
    for row, text in enumerate(column.to_pylist()):
        at = 0
        while at < max(len(text), 1):
            end = at + BLOCK
            while end < len(text) and not text[end].isspace():
                end += 1
            parts.append(text[at:end])
            rows.append(row)
            at = end
    return pa.array(parts, pa.large_string()), np.array(rows)


def word_codes(column: pa.Array):
    """(rows, blocks, word buckets, shape buckets) of all words of a column of
    texts, for some whole blocks at a time: at most BLOCK code points, or one
    block.  Each distinct word is coded once."""
    texts, row = blocks(column)
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
        words = pc.utf8_split_whitespace(texts.slice(at, end - at))
        coded = words.flatten().dictionary_encode()
        codes = codes_of(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        block = np.repeat(np.arange(at, end), words.value_lengths().to_numpy(zero_copy_only=False))
        real = codes >= 0  # white space at an end of a text leaves an empty string there
        codes, block = codes[real], block[real]
        if len(codes):
            yield row[block], block, codes // BUCKETS, codes % BUCKETS
        at = end


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """(BUCKETS, DIM) unit vectors: the summed index vectors of the
    neighbours of every word of every document.  Each task sums its rows
    first, Spark adds the sums up, and the fixed-size table reaches the driver."""
    small_batches(docs.sparkSession)
    names = [f"d{i}" for i in range(DIM)]

    def run(batches):
        acc = np.zeros(BUCKETS * 2 * DIM, np.int64)
        for t in batches:
            for _, block, w, s in word_codes(t.column(0)):
                own = np.concatenate([ENTRIES[w], ENTRIES[s]], 1)
                near = block[1:] == block[:-1]  # the neighbours of a word stand in its block
                at = w[:, None] * (2 * DIM)
                for word, other in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                    acc += np.bincount((at[word][near] + own[other][near]).ravel(), minlength=len(acc))
        acc = acc.reshape(BUCKETS, 2, DIM)
        acc = acc[:, 0] - acc[:, 1]
        at = np.nonzero(acc.any(1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at)] + [pa.array(acc[at, i]) for i in range(DIM)], ["b", *names])

    parts = docs.select(F.col(q(text_col)).cast("string").alias("text")).mapInArrow(run, "b long, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((BUCKETS, DIM))
    out[rows["b"].to_numpy(np.int64)] = rows[names].to_numpy(np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Features of every whole text of a column: the mean word vector, the
    mean index vector of the shapes, how concentrated the words are, how often
    a word's vector is that of the word before, and the length."""
    rows = len(column)
    n, again, last, of = np.zeros(rows, np.int64), np.zeros(rows, np.int64), -1, -1
    v, s, w = np.zeros((rows, DIM)), np.zeros((rows, 2 * DIM), np.int64), np.zeros((rows, 2 * DIM), np.int64)
    for row, block, words, shapes in word_codes(column):
        n += np.bincount(row, minlength=rows)
        again += np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=rows)
        again[row[0]] += int(of == row[0] and last == words[0])
        of, last = row[-1], words[-1]
        first = np.nonzero(np.diff(block, prepend=-1))[0]
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
            v[row[a]] += table[words[a:b]].sum(0, dtype=np.float64)
        lane = row[:, None] * (2 * DIM)
        for total, codes in ((s, shapes), (w, words)):
            total += np.bincount((lane + ENTRIES[codes]).ravel(), minlength=total.size).reshape(total.shape)
    k = np.maximum(n, 1)
    s, w = s[:, :DIM] - s[:, DIM:], w[:, :DIM] - w[:, DIM:]
    return np.column_stack([v / k[:, None], s / k[:, None], np.linalg.norm(w, axis=1) / k, again / k, np.log1p(n)])


class Network:
    """Two layers, tanh between them, a logistic output with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) >= 8 and 0 < self.prior < 1
        if not self.fitted:
            return
        o = rng.permutation(len(y))
        cut = max(1, int(len(y) * CALIBRATE))
        cal, fit = o[:cut], o[cut:]
        self.mean, self.std = x[fit].mean(0), x[fit].std(0) + 1e-6
        z, t = (x[fit] - self.mean) / self.std, y[fit]
        p = [rng.normal(0, (1 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - t) / len(t)
            back = d[:, None] * p[2] * (1 - h * h)
            grads = [z.T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.p = p
        logit, t = self.logit(x[cal]), y[cal]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(t > 0, -logit, logit) / g).mean() for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -10, 10)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-self.logit(x) / self.temperature))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(q(id_col)).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels (id, 0/1) are learned from rows that are not held out; null ids,
    null labels and labels without a document are ignored, repeated labels
    count again.  A label whose id stands on several documents counts for
    each; at most about twice FIT_ROWS rows are fitted on.  The score depends
    on the text alone: null and empty texts have the features of no words,
    equal texts score alike, very long texts are pooled whole.  With no usable labels or one class only, every score
    is the share of label 1 (0.5 without any).  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    table = word_vectors(docs, text_col)
    shared = spark.sparkContext.broadcast(table)  # BUCKETS x DIM floats: fixed size
    known = (labels.where(F.col(q(label_col)).isin(0, 1) & F.col(q(id_col)).isNotNull() & ~held_out(id_col))
             .select(F.col(q(id_col)).alias("__id"), F.col(q(label_col)).cast("int").alias("__y")))
    total = known.count()
    u = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = known.where(u < F.lit(FIT_ROWS / max(total, 1)))
    small_batches(spark)
    # an id may stand on very many documents: beyond twice the bound they are thinned by a hash of the text
    met = docs.select(F.col(q(id_col)).alias("__id")).join(F.broadcast(sample), "__id").count()
    thin = F.pmod(F.xxhash64(F.col(q(text_col)).cast("string"), F.monotonically_increasing_id()), F.lit(1 << 30)).cast("double") / float(1 << 30)
    some = docs if met <= 2 * FIT_ROWS else docs.where(thin < F.lit(2 * FIT_ROWS / met))

    def features(batches):
        for t in batches:
            x = pooled(t.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    # FIT_ROWS narrow rows: a broadcast of a proven size
    rows = (some.join(F.broadcast(sample), some[q(id_col)] == sample["__id"])
            .select("__y", F.col(q(text_col)).cast("string").alias("t")).mapInArrow(features, "y int, x array<double>").toPandas())
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), FEATURES)
    order = np.lexsort(np.column_stack([x, rows["y"].to_numpy()]).T) if len(rows) else np.empty(0, np.int64)  # the order of arrival does not matter
    net = spark.sparkContext.broadcast(Network(x[order], rows["y"].to_numpy(np.float64)[order]))

    def score(batches):
        for t in batches:
            s = net.value.score(pooled(t.column(2), shared.value))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col(q(id_col)).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(q(text_col)).cast("string").alias("t"))
    return src.mapInArrow(score, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
