"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of the summed weights of its hashed words and word beginnings. A document is toxic if any sentence
is, p = 1 - product of (1 - sentence scores) (noisy-or), and the loss on p alone teaches the word weights, so the model
then points at the sentences that make a document toxic. It is fitted by stochastic gradient descent on a bounded sample
of labelled documents and sent to the tasks, which score every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare
from .vectors import byte_column, groups, held_out, mixed, runs, word_hashes

#: Weights of words and of their beginnings (bytes), hashed; the size of the model.
BITS, PREFIXES = 20, (4, 5, 6)
#: The model is fitted on at most this many labelled documents, those with the least hash of id, and of these on as many
#: whole texts as hold this many bytes together.
SAMPLE_DOCS, SAMPLE_BYTES = 6_000, 16_000_000
#: Words of an instance at most: a longer sentence (a table, a list without stops) is several, each of which is scored.
LONGEST = 40
#: Features of fewer documents of the sample keep weight 0: they could only be learnt by heart.
LEAST_DOCS = 3
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.1, 1e-6
THRESHOLD = 0.5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("'")]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def instances(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, ...]:
    """Features and sentences of ``texts``: bucket of each word or beginning, its sentence, each sentence's text, first and last byte.

    Sentences end at ``.!?`` and line ends; those without a word are left out.
    """
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, stops = runs(_WORD[buf])
    low, hashes, words = _LOWER[buf], [word_hashes(_LOWER[buf], starts, stops)], [np.arange(len(starts))]
    for size in PREFIXES:
        longer = np.flatnonzero(stops - starts > size)
        hashes.append(word_hashes(low, starts[longer], starts[longer] + size) + np.uint64(size))
        words.append(longer)
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    bucket = (mixed(np.concatenate(hashes)[order]) >> np.uint64(64 - bits)).astype(np.int64)
    closers = np.flatnonzero(_END[buf])
    raw, of_word, held = np.unique(np.searchsorted(closers, starts), return_inverse=True, return_counts=True)
    # A sentence of many words (a table, a list without stops) is cut into instances of at most LONGEST words.
    piece = (np.arange(len(starts)) - np.repeat(np.cumsum(held) - held, held)) // LONGEST
    new = np.flatnonzero(np.r_[True, (np.diff(of_word) != 0) | (np.diff(piece) != 0)][: len(starts)])
    of_word, raw = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(starts)])), raw[of_word[new]]
    # A sentence has a feature or not: repeats count once.
    pair = np.unique(of_word[word[order]].astype(np.int64) << bits | bucket)
    sentence, bucket = pair >> bits, pair & ((1 << bits) - 1)
    doc = np.searchsorted(ends, closers[raw], side="right")
    offset = ends - np.array([len(t) + 1 for t in texts])
    return bucket, sentence, doc, starts[new] - offset[doc], stops[np.r_[new[1:], len(starts)][: len(new)] - 1] - offset[doc]


def _sentence_logits(model: Model, bucket, sentence, n: int) -> np.ndarray:
    return model.bias + np.bincount(sentence, model.weights[bucket], n)


def _document_scores(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Noisy-or: log(1 - p) of a document is the sum of its sentences' log(1 - p)."""
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, logits), n))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Adaptive-rate gradient descent on the noisy-or log-likelihood of the documents' labels."""
    model, total = Model(np.zeros(1 << BITS), -9.0), np.full(1 << BITS, 1e-2)
    parts = []
    for a, b in groups(texts):
        bucket, sentence, doc, _, _ = instances(texts[a:b])
        cut = np.searchsorted(doc[sentence], np.arange(b - a + 1))
        parts += [(bucket[cut[i] : cut[i + 1]].astype(np.int32), np.unique(sentence[cut[i] : cut[i + 1]], return_inverse=True)[1].astype(np.int32)) for i in range(b - a)]
    seen = np.zeros(1 << BITS, np.int32)
    for bucket, _ in parts:
        seen[np.unique(bucket)] += 1
    # The start: how much oftener toxic documents have a feature than clean ones, as log odds.
    toxic = np.zeros(1 << BITS, np.int32)
    for (bucket, _), y in zip(parts, labels, strict=True):
        if y:
            toxic[np.unique(bucket)] += 1
    share = (labels.sum() + 1) / (len(labels) - labels.sum() + 1)
    odds = np.log((toxic + 0.5) / (seen - toxic + 0.5) / share)
    model.weights = np.where(seen >= LEAST_DOCS, np.maximum(0, odds - 1), 0)
    kept = [seen[bucket] >= LEAST_DOCS for bucket, _ in parts]
    parts = [(bucket[k], sentence[k], int(sentence.max(initial=-1)) + 1) for (bucket, sentence), k in zip(parts, kept, strict=True)]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(parts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            counts = [parts[i][2] for i in rows]
            base = np.cumsum([0, *counts])
            bucket = np.concatenate([parts[i][0] for i in rows])
            sentence = np.concatenate([parts[i][1] + base[j] for j, i in enumerate(rows)])
            doc = np.repeat(np.arange(len(rows)), counts)
            z = _sentence_logits(model, bucket, sentence, base[-1])
            clean = np.bincount(doc, np.logaddexp(0, z), len(rows))  # -log(1 - p)
            y = labels[rows]
            # d loss / d clean: 1 for a clean document, -(1-p)/p for a toxic one; d clean / d z is the sentence's score.
            slope = np.where(y == 1, -1 / np.expm1(np.clip(clean, 1e-9, 50)), 1.0)
            grad = np.clip(slope, -1e3, 1e3)[doc] / (1 + np.exp(-np.clip(z, -30, 30)))
            used, at = np.unique(bucket, return_inverse=True)
            g = np.bincount(at, grad[sentence], len(used)) + DECAY * len(order) * model.weights[used]
            total[used] += g * g
            # Weights stay at 0 or above: a word may make a sentence toxic, and no number of others makes up for it.
            model.weights[used] = np.maximum(0, model.weights[used] - RATE * g / np.sqrt(total[used]))
            model.bias = float(np.clip(model.bias - 0.1 * grad.sum() / len(rows), -14, -6))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, rest: int, most: int, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> list[tuple[bytes, int]]:
    """Whole texts and labels of labelled rows outside the held-out part, in the order of a hash of id.

    At most ``most`` rows and ``size`` bytes of texts: a text that has no room among those before it is left out as a whole
    and the next ones go on, so one very long text neither ends nor empties the sample, and no text is cut. The picked ids are bounded, so they may be broadcast; texts that were not picked never leave their task.
    """
    size = SAMPLE_BYTES if size is None else size
    picked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i"), parts, rest))
    picked = picked.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("size"), text.alias("text"))
    found, held, keys = rows.join(F.broadcast(picked), "i").orderBy(F.xxhash64("i"), "i", "t").select("i", "t", "size", "y").limit(most).collect(), 0, []
    for r in found:
        if held + r["size"] <= size:
            held += r["size"]
            keys.append((r.i, r.t, r.y))
    if not keys:
        return []
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(sorted(set(keys), key=str), f"i {kind}, t long, y int")
    texts = {(r.i, r.t): bytes(r.text) for r in rows.join(F.broadcast(wanted), ["i", "t"]).select("i", "t", "text").toLocalIterator()}
    return [(texts[i, t], y) for i, t, y in keys]


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Input columns, then ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``sentences``.

    ``sentences`` lists (first byte, end byte, score) of the sentences that are toxic by themselves. Null, empty and
    wordless texts score 0. Rows that repeat are scored alike, an empty table gives no rows; input columns named like the
    new ones are replaced.
    """
    made = [c for c in ("score", "predicted", "sentences") if c in docs.columns]
    docs = docs.drop(*made)
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32)), model.bias
    spans = "array<struct<first: int, last: int, score: double>>"

    def run(batches):
        own = Model(weights.value, bias)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts, scores, found = byte_column(batch.column(batch.num_columns - 1)), [], []
            for a, b in groups(texts):
                bucket, sentence, doc, first, last = instances(texts[a:b])
                z = _sentence_logits(own, bucket, sentence, len(doc))
                scores.append(_document_scores(z, doc, b - a))
                own_found = [[] for _ in range(b - a)]
                for i in np.flatnonzero(z >= np.log(threshold / (1 - threshold))).tolist():
                    own_found[doc[i]].append({"first": int(first[i]), "last": int(last[i]), "score": float(1 / (1 + np.exp(-z[i])))})
                found += own_found
            score = np.concatenate(scores) if scores else np.zeros(0)
            columns = [*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted", "sentences"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    hidden = spare(docs, "__text_bytes")
    return docs.withColumn(hidden, F.col(text_col).cast("binary")).mapInArrow(run, f"{fields}, score double, predicted int, sentences {spans}")


def fit_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, most: int = SAMPLE_DOCS, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labelled rows outside the held-out part; without any such row, one that finds nothing toxic."""
    rows = training_rows(docs, labels, label_col, parts, rest, most, id_col, text_col)
    return fit([t for t, _ in rows], np.array([y for _, y in rows], np.int64)) if rows else Model(np.zeros(1 << BITS), -14.0)
