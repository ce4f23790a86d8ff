"""Quality classifier: supervised subword embeddings averaged over a document, softmax output.

Features of a text are its words and pairs of neighbouring words (hashed), and the character n-grams of
its bytes (hashed). Each bucket has a learned vector; the document's vector is the mean over all its
features, times one constant that belongs to the model; a softmax layer gives the class. Both are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the output is linear in
the mean, a bucket's vector folds into one number for scoring: all of a text is scored by hashing, one
gather and a sum, and the score is the fitted softmax itself.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from busfleet.llm._labels import fitted, held_out, labelled_sample
from busfleet.llm._text import Bytes, mix, pieces, plus, utf8

WORDS, PAIRS, GRAMS, ORDERS, DIM = 1 << 16, 1 << 16, 1 << 17, (3, 5), 8
BUCKETS = WORDS + PAIRS + GRAMS
#: Bytes of text that a task works on at a time; a longer text is taken whole.
PIECE = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(data, at):
    """Yields (buckets, documents) for the words, their pairs and each order of n-grams of some texts."""
    text = Bytes(data, at, lower=False)
    if not len(data):
        return
    words = text.words()
    yield (words % np.uint64(WORDS)).astype(np.int64), text.doc
    pairs = np.flatnonzero(text.doc[1:] == text.doc[:-1])
    yield WORDS + (mix(words[pairs] * _ODD + words[pairs + 1]) % np.uint64(PAIRS)).astype(np.int64), text.doc[pairs]
    doc = np.repeat(np.arange(text.n, dtype=np.int32), np.diff(at))
    for n in ORDERS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        packed = data[:m].astype(np.uint64)
        for i in range(1, n):
            packed |= data[i : m + i].astype(np.uint64) << np.uint64(8 * i)
        packed *= _ODD
        packed >>= np.uint64(64 - GRAMS.bit_length() + 1)
        inside = doc[:m] == doc[n - 1 :]
        yield WORDS + PAIRS + packed.astype(np.int64)[inside], doc[:m][inside]


def counts(data, at):
    """Distinct buckets of each text and how often each occurs there."""
    found = [[] for _ in range(len(at) - 1)]
    for buckets, doc in features(data, at):
        cut = np.searchsorted(doc, np.arange(len(at)))
        for i in range(len(at) - 1):
            found[i].append(buckets[cut[i] : cut[i + 1]])
    for own in found:
        yield np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_counts=True)


def gain_of(rows):
    """The constant that means are multiplied by: the median over the rows of 1 / the norm of their shares."""
    spread = [c.sum() / np.sqrt(float(c.astype(float) @ c)) for _, b, c in rows if len(b)]
    return float(np.median(spread)) if spread else 1.0


def fit(rows, prior, epochs=4, rate=1.0, seed=1):
    """The folded weights of the buckets, the gain and the bias, from (y, buckets, counts) rows; with no row, weights of 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias, gain = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32), gain_of(rows)
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, b, c = rows[k]
            step += 1
            if not len(b):
                continue
            share = c.astype(np.float32)
            share *= gain / share.sum()
            mean = share @ vectors[b]
            p = _softmax(out @ mean + bias)
            p[y] -= 1
            # a text of few features has a large norm: its step is shortened, not its score
            lr = rate * (1 - step / (steps + 1)) / max(1.0, float(share @ share))
            back = p @ out
            out -= lr * np.outer(p, mean)
            bias -= lr * p
            vectors[b] -= lr * np.outer(share, back)
    ones = sum(y for y, *_ in rows)
    balance = np.log((ones + 0.5) / (len(rows) - ones + 0.5)) if rows else 0.0
    return {"weight": (vectors @ (out[1] - out[0])).astype(np.float32), "bias": float(bias[1] - bias[0]), "shift": float(prior - balance), "gain": gain, "layers": (vectors, out, bias)}


def _softmax(z):
    p = np.exp(z - z.max())
    return p / p.sum()


def logits(data, at, model):
    """Log odds of class 1 of each text: the mean over its features; an empty text has the bias alone."""
    n = len(at) - 1
    total, size = np.zeros(n), np.zeros(n)
    for buckets, doc in features(data, at):
        total += np.bincount(doc, model["weight"][buckets], n)
        size += np.bincount(doc, minlength=n)
    return total / np.maximum(size, 1) * model["gain"] + model["bias"] + model["shift"]


def train(docs, labels, label="quality", modulus=5, rest=0, per_class=3000, class_bytes=16_000_000, **names):
    """The model of ``docs`` and ``labels``.

    ``per_class`` and ``class_bytes`` bound the labelled rows used of each class, and their text. Features
    are taken where the rows are; one task fits the model on them.
    """
    sample, prior = labelled_sample(docs, labels, label, modulus, rest, per_class, class_bytes, **names)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, most=PIECE):
                got = list(counts(*utf8(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([b.astype(np.int32).tobytes() for b, _ in got], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in got], pa.binary())], ["doc_id", "y", "b_int32", "c_uint32"])

    rows = sample.select("doc_id", "y", "text").mapInArrow(run, plus(sample.select("doc_id", "y").schema, "b_int32 binary, c_uint32 binary"))

    def whole(rows):
        model = fit(rows, prior)
        del model["layers"]
        return model

    return fitted(rows, whole)


def score(docs, model, text="text", id="doc_id", modulus=5, rest=0, threshold=0.3, keep=()):
    """Per row: doc_id, held_out, score (probability of class 1), predicted; empty and null texts too.

    Repeated rows are scored each. Further columns are left out unless named in ``keep``.
    """
    rows = docs.select(F.col(id).alias("doc_id"), held_out(id, modulus, rest).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("__text"), *keep)
    names = ["doc_id", "held_out", *keep]
    schema = plus(rows.select(*names).schema, "score double, predicted int")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "__text", PIECE):
                p = 1 / (1 + np.exp(-np.clip(logits(*utf8(part.column("__text")), model), -500, 500)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def accepted(docs, model, text="text", threshold=0.3):
    """The rows of ``docs``, with all columns, whose score reaches the threshold. Never shuffled."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, PIECE):
                z = logits(*utf8(part.column(text)), model)
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
