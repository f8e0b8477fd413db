"""Document quality by supervised subword embeddings.

Every word and every character n-gram of NGRAMS bytes that touches a word has a hashed bucket with
a learned vector of DIM numbers. A document is the mean of its vectors; a softmax over two classes
gives the score. Buckets, softmax and vectors are trained by stochastic gradient descent in numpy
on at most SAMPLE labelled rows (in hash order of their ids), whatever the size of the input. As
everything after the mean is linear, scoring folds each vector to one number per bucket.

Null and empty texts have no features and get the score of the bias alone. Repeated rows score
alike; unlabelled rows teach nothing; without labels every score is 0.5. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm import tokens as T
from marketlens.llm.common import held_out, labelled_sample, lean, table

SAMPLE = 3000  # labelled rows that teach, at most
BUCKETS = 1 << 16
DIM = 8
NGRAMS = (3, 4)
EPOCHS = 8
RATE = 0.5
THRESHOLD = 0.7


def features(column):
    """Buckets of all features of a string column, and each text's bounds (n+1) per feature kind."""
    data, offsets = T.utf8(column)
    starts, ends, first = T.word_spans(data, offsets, "space")
    kinds = [((T.span_hashes(data, starts, ends) % T.U(BUCKETS)).astype(np.int32), first)]
    if len(data) >= max(NGRAMS):
        space = ~T.byte_class("space")[data]
        values = (T.byte_values() >> T.U(32)).astype(np.uint32)[data]
        values[space] = 12345
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        for k in NGRAMS:
            n = len(data) - k + 1
            h, ok = np.zeros(n, np.uint32), np.ones(n, bool)
            for j in range(k):
                h = h * np.uint32(0x9E3779B1) + values[j : j + n]
                if 0 < j:
                    ok &= ~edge[j : j + n]  # within one text
                if 0 < j < k - 1:
                    ok &= ~space[j : j + n]  # white space at its ends at most
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            h ^= h >> np.uint32(13)
            at = np.flatnonzero(ok)
            kinds.append(((h[at] & np.uint32(BUCKETS - 1)).astype(np.int32), np.searchsorted(at, offsets)))
    return kinds


def means(kinds, table_):
    """The mean of table_[bucket] over all features of each text; 0 without features."""
    n = len(kinds[0][1]) - 1
    total, count = np.zeros(n), np.zeros(n)
    for bucket, bounds in kinds:
        run = np.concatenate([[0.0], np.cumsum(table_[bucket], dtype=np.float64)])
        total += run[bounds[1:]] - run[bounds[:-1]]
        count += np.diff(bounds)
    return total / np.maximum(count, 1)


class Model:
    """One logit per bucket, and the bias."""

    def __init__(self, logits, bias):
        self.logits, self.bias = logits, bias

    def scores(self, column):
        z = means(features(column), self.logits) + self.bias
        return 1 / (1 + np.exp(-z))


def train(texts, labels, seed=7):
    """Embeddings and softmax by stochastic gradient descent over (text, label) rows."""
    y = np.asarray(labels, np.int64)
    if len(y) < 2 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(0 if not len(y) else (2.0 if y[0] else -2.0)))
    docs = []
    for t in texts:
        kinds = features(pa.array([t], pa.string()))
        bucket, count = np.unique(np.concatenate([k[0] for k in kinds]), return_counts=True)
        docs.append((bucket, (count / max(1, count.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bias[1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            bucket, share = docs[i]
            hidden = share @ vectors[bucket]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            vectors[bucket] -= (rate * 40) * share[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def learn(docs, labels):
    """The model from a bounded sample of labelled rows."""
    rows = sorted(labelled_sample(docs, labels, "quality", SAMPLE).collect())
    return train([r.text for r in rows], [r.y for r in rows])


def _score(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            for part in T.slices(batch, "text", T.CHUNK // 2):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")))], ["doc_id", "score"])

    return lean(score)


def score_quality(docs, model):
    """doc_id and score in 0 to 1 of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), "doc_id long, score double")


def query(spark, sf_dir):
    """op5: held_out, score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
