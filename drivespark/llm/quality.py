"""Quality classifier: supervised subword embeddings, averaged per document, softmax output, trained by numpy SGD.

Features are hashed to buckets: words, pairs of a word with one just before it (a pair of equal words is one feature,
whatever the word), and byte n-grams. Every bucket has a learnt vector; a document is the mean of its word vectors plus
the mean of its n-gram vectors, and a softmax layer gives the class. The fit runs on a bounded sample of labelled
documents (whole texts, with a bound on their bytes). For scoring, vectors and output layer fold into one number for each bucket, so a document costs a lookup for
each feature; whole texts are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spare
from .toxicity import training_rows
from .vectors import byte_column, groups, mixed, word_hashes

BITS, SIZES, DIM = 16, (3, 4), 8
#: The model is fitted on at most this many labelled documents, those with the least hash of id.
SAMPLE_DOCS = 6_000
EPOCHS, BATCH, RATE = 6, 16, 0.5
THRESHOLD = 0.7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Model:
    table: np.ndarray  # log odds of label 1 that a feature of weight 1 adds, by bucket
    bias: float


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, weight) of every feature; a document's words weigh 1 together, and so do its n-grams."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(np.r_[False, word, False].view(np.int8)))
    starts, stops = edges[0::2], edges[1::2]
    shift = np.uint64(64 - bits)
    h = word_hashes(buf, starts, stops)
    doc_w = np.searchsorted(ends, starts, side="right")
    buckets, docs = [mixed(h) >> shift], [doc_w]
    for back in (1, 2):
        a, b = h[:-back], h[back:]
        pair = np.where(a == b, np.uint64(back), mixed(a * np.uint64(3) + b) * np.uint64(2 * back + 1))
        inside = doc_w[:-back] == doc_w[back:]
        buckets.append((mixed(pair) >> shift)[inside])
        docs.append(doc_w[back:][inside])
    words = np.concatenate(docs)
    rolled, grams = buf.astype(np.uint32), []
    doc_b = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    for size in SIZES:
        g = np.zeros(max(0, len(buf) - size + 1), np.uint32)
        for k in range(size):
            g = g * np.uint32(0x01000193) + rolled[k : k + len(g)]
        grams.append(((g * np.uint32(0x9E3779B1) + np.uint32(size)) >> np.uint32(32 - bits)).astype(np.uint64))
    inside = [doc_b[: len(g)] == doc_b[len(buf) - len(g) :] for g in grams]
    letters = np.concatenate([doc_b[: len(g)][i] for g, i in zip(grams, inside, strict=True)])
    bucket = np.concatenate([*buckets, *(g[i] for g, i in zip(grams, inside, strict=True))]).astype(np.int64)
    n = len(texts)
    share_w, share_b = (1 / np.maximum(1, np.bincount(x, minlength=n)) for x in (words, letters))
    return np.concatenate([words, letters]), bucket, np.concatenate([share_w[words], share_b[letters]])


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Model:
    """Vectors and output layer by stochastic gradient descent on the softmax loss; folded into one table."""
    rows = []
    for a, b in groups(texts):
        doc, bucket, weight = features(texts[a:b])
        key, at = np.unique(doc.astype(np.int64) << BITS | bucket, return_inverse=True)
        held, own = np.bincount(at, weight), key >> BITS
        cut = np.searchsorted(own, np.arange(b - a + 1))
        rows += [((key[cut[i] : cut[i + 1]] & ((1 << BITS) - 1)).astype(np.int32), held[cut[i] : cut[i + 1]].astype(np.float32)) for i in range(b - a)]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    classes = np.eye(2, dtype=np.float32)[labels]
    steps = EPOCHS * -(-len(rows) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            rate, step = RATE * (1 - step / steps), step + 1
            picked = [i for i in order[k : k + BATCH] if len(rows[i][0])]
            if not picked:
                continue
            bucket, weight = (np.concatenate([rows[i][c] for i in picked]) for c in (0, 1))
            starts = np.cumsum([0, *(len(rows[i][0]) for i in picked[:-1])])
            hidden = np.add.reduceat(vectors[bucket] * weight[:, None], starts)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = p / p.sum(axis=1, keepdims=True) - classes[picked]
            back = g @ out.T
            out -= rate * 0.1 * hidden.T @ g / len(picked)
            bias -= rate * 0.1 * g.mean(axis=0)
            sizes = np.diff(np.r_[starts, len(bucket)])
            change = np.repeat(back, sizes, axis=0) * weight[:, None]
            # The mean of a thousand vectors moves slowly; its parts take steps that much larger.
            for j in range(DIM):
                vectors[:, j] -= rate * 20 * np.bincount(bucket, change[:, j], 1 << BITS).astype(np.float32)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; a text without features gets the bias's."""
    doc, bucket, weight = features(texts)
    z = model.bias + np.bincount(doc, model.table[bucket] * weight, len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Input columns, then ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts have no features: their score is that of the classes' shares. Repeated rows are scored alike;
    input columns named like the new ones are replaced.
    """
    from pyspark.sql import functions as F

    docs = docs.drop(*(c for c in ("score", "predicted") if c in docs.columns and c != text_col))
    table, bias = docs.sparkSession.sparkContext.broadcast(model.table), model.bias

    def run(batches):
        own = Model(table.value, bias)
        for batch in batches:
            texts = byte_column(batch.column(batch.num_columns - 1))
            found = [scores(own, texts[a:b]) for a, b in groups(texts)]
            score = np.concatenate(found) if found else np.zeros(0)
            columns = [*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(spare(docs, "__text_bytes"), F.col(text_col).cast("binary")).mapInArrow(run, f"{fields}, score double, predicted int")


def fit_quality(docs: DataFrame, labels: DataFrame, parts: int = 4, rest: int = 2, most: int = SAMPLE_DOCS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labelled rows outside the held-out part; without any such row, one that scores all texts 0.5."""
    rows = training_rows(docs, labels, label_col, parts, rest, most, id_col, text_col)
    return fit([t for t, _ in rows], np.array([y for _, y in rows], np.int64)) if rows else Model(np.zeros(1 << BITS, np.float32), 0.0)
