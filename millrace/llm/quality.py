"""Quality classifier: supervised subword embeddings.

A text is a bag of tokens. Each token stands for itself and its character n-grams, all hashed
into BUCKETS learned vectors; the vectors are averaged over the document and go through a
softmax layer. Vectors and layer are trained together by numpy stochastic gradient descent
on the driver, from at most TRAIN_ROWS labelled rows of the training fold, taken in the order
of a hash of their id; executors turn those rows into bucket counts, so the driver never
holds a text. The output is linear in the averaged vector, so scoring needs one number a
bucket: each Python worker keeps, for the tokens it has met, the sum over their buckets.

A token that repeats its predecessor and a line that repeats an earlier line of the text are
replaced by tokens of their own, so that the model can learn what repetition means.

Cases: a null text counts as empty; an empty text gets the score of the layer's bias; a row
whose id is null is scored and falls in the fold of the empty id; ids that repeat are scored
row by row; labels other than 0 and 1 and labels without a document teach nothing, without
any usable label every score is 0.5; an empty table gives an empty result; only doc_id and
text of the documents are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

TRAIN_ROWS = 4000
BUCKETS = 1 << 16
DIM = 8
NGRAMS = (3, 4)
EPOCHS = 6
RATE = 4.0
CACHE_ENTRIES = 400_000
#: Scores from here on are predicted 1.
THRESHOLD = 0.3
HELD_OUT = 0
_SAME, _LINE = "\x02same", "\x02line"


def tokens(text: str) -> list[str]:
    """White-space tokens, with marks for repeated tokens and lines."""
    out, seen, last = [], set(), None
    for line in text.split("\n"):
        words = line.split()
        if len(words) > 1:
            if line in seen:
                out.append(_LINE)
                continue
            seen.add(line)
        if len(words) == len(set(words)) and (not words or words[0] != last):
            out += words
        else:
            out += [_SAME if w == v else w for w, v in zip(words, [last, *words])]
        last = words[-1] if words else last
    return out


def buckets(token: str) -> list[int]:
    """The token's own bucket and those of its character n-grams."""
    if token[0] == "\x02":
        return [zlib.crc32(token.encode()) % BUCKETS]
    edged = f"<{token}>"
    grams = {edged[i : i + n] for n in NGRAMS for i in range(len(edged) - n + 1)}
    return [zlib.crc32(token.encode()) % BUCKETS, *(zlib.crc32(b"\x01" + g.encode()) % BUCKETS for g in grams)]


class _Known(dict):
    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[key] = self.compute(key)
        return out


def _features(batches):
    """Bucket numbers and counts of each row's text, as packed arrays."""
    known = _Known(buckets)
    for batch in batches:
        ids, counts = [], []
        for text in batch.column("text"):
            every = [b for t in tokens(text.as_py() or "") for b in known[t]]
            b, n = np.unique(np.array(every, np.int32), return_counts=True)
            ids.append(b.tobytes())
            counts.append(n.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "y", "ids", "counts"])


_SHARED: dict = {}


def token_values(weight: np.ndarray) -> _Known:
    """For each token the sum of its buckets' weights (real) and their number (imaginary); tasks of one Python worker share what it has met."""
    mark = zlib.crc32(weight.tobytes())
    if mark not in _SHARED:
        at = lambda raw: float(weight[zlib.crc32(raw) % BUCKETS])
        grams = _Known(lambda g: at(b"\x01" + g.encode()))

        def value(token):
            if token[0] == "\x02":
                return complex(at(token.encode()), 1)
            edged = f"<{token}>"
            own = {edged[i : i + n] for n in NGRAMS for i in range(len(edged) - n + 1)}
            return complex(at(token.encode()) + sum(map(grams.__getitem__, sorted(own))), 1 + len(own))

        _SHARED.clear()
        _SHARED[mark] = _Known(value)
    return _SHARED[mark]


def train(rows: list, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's contribution to the logit of label 1, and the bias. rows: (label, buckets, counts)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    layer += rng.normal(0, 0.5, layer.shape).astype(np.float32)
    size, step, steps = 16, 0, epochs * -(-len(rows) // 16)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), size):
            part = [rows[i] for i in order[a : a + size] if len(rows[i][1])]
            if not part:
                continue
            now = rate * (1 - step / steps)
            step += 1
            ids = np.concatenate([r[1] for r in part])
            weight = np.concatenate([r[2] / r[2].sum() for r in part])
            starts = np.cumsum([0, *(len(r[1]) for r in part[:-1])])
            mean = np.add.reduceat(vectors[ids] * weight[:, None], starts)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(part)), [r[0] for r in part]] -= 1
            error /= len(part)
            back = error @ layer.T
            layer -= now * mean.T @ error * 0.25
            bias -= now * error.sum(0) * 0.05
            gradient = back[np.repeat(np.arange(len(part)), [len(r[1]) for r in part])] * weight[:, None]
            own, inverse = np.unique(ids, return_inverse=True)
            total = np.stack([np.bincount(inverse, gradient[:, d], len(own)) for d in range(DIM)], 1)
            vectors[own] -= (now * size * total).astype(np.float32)
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT, max_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Train on at most max_rows labelled rows outside the held-out fold."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & ~common.train_fold("doc_id", held_out) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
    rows = own.mapInArrow(_features, "doc_id long, y int, ids binary, counts binary").orderBy("doc_id", "ids").limit(max_rows).collect()
    return train([(r.y, np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.float32)) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float], held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    weights, bias = model
    shipped = docs.sparkSession.sparkContext.broadcast(weights)  # one number a bucket, whatever the input

    def run(batches):
        known = token_values(shipped.value)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                got = np.fromiter(map(known.__getitem__, tokens(text.as_py() or "")), np.complex128).sum()
                z = bias + (got.real / got.imag if got.imag else 0.0)
                out.append(1 / (1 + np.exp(-z)) if z > -700 else 0.0)
            s = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), s, pa.array([int(x >= THRESHOLD) for x in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.train_fold("doc_id", held_out).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns."""
    weights, bias = model
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        known = token_values(shipped.value)
        edge = np.log(threshold / (1 - threshold)) - bias
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                got = np.fromiter(map(known.__getitem__, tokens(text.as_py() or "")), np.complex128).sum()
                keep.append(bool((got.real / got.imag if got.imag else 0.0) >= edge))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
