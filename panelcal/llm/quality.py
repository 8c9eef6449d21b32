"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its hashed n-grams: every word and its character
n-grams (3 to 5 bytes of ``<word>``), every pair of neighbouring words and, as pairs of the same word
are mostly never seen before, one more shared n-gram for "the word before again". A softmax layer
over the average gives the probability of each label. Vectors and layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.llm.common import Texts, WordTable, mix64, ngrams, saved, with_text_columns

#: Labelled documents of which a model is learned, at most. They are the first in hash order of their text.
SAMPLE_ROWS = 3000
#: Bytes of text of which a model is learned, at most; a sampled text counts whole or not at all.
SAMPLE_BYTES = 12_000_000
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSION = 8
AGAIN = 0  # bucket of "the word before again"
THRESHOLD = 0.7
#: Words that a task remembers, some 200 bytes each; most words are rare, so that fewer cost no time.
KNOWN_WORDS = 200_000


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash per word; bucket and word number of each of its n-grams, the word itself included."""
    grams, owner = ngrams(words, SIZES)
    own = np.fromiter((hash_word(w) for w in words), np.uint64, len(words))
    return own, np.concatenate([bucket(own), bucket(grams)]), np.concatenate([np.arange(len(words)), owner])


def hash_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 7)


def pair_buckets(hashes: np.ndarray, same_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each pair of neighbouring words of a text, and whether both are the same word."""
    left, right = hashes[:-1][same_text], hashes[1:][same_text]
    return bucket(mix64(left * np.uint64(3) + right)), left == right


@dataclass(frozen=True)
class Model:
    """``vectors`` (bucket x dimension), ``weights`` (dimension x 2) and ``bias`` (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def logits(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1 before averaging."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    kinds = sorted(set(words))
    number = {w: i for i, w in enumerate(kinds)}
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    own, buckets, owner = word_features(kinds)
    pairs, again = pair_buckets(own[at], np.ones(len(words) - 1, bool))
    total = np.bincount(buckets, np.bincount(at, minlength=len(kinds))[owner], BUCKETS)
    total += np.bincount(pairs, minlength=BUCKETS)
    total[AGAIN] += again.sum()
    held = np.flatnonzero(total)
    return held.astype(np.int32), total[held].astype(np.float32)


def train(texts: Texts, labels: list[int], epochs: int = 6, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent, a document a step, with a rate that falls to zero."""
    if not texts:
        return Model(np.zeros((BUCKETS, DIMENSION), np.float32), np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIMENSION)) - 0.5) / DIMENSION).astype(np.float32)
    weights = ((rng.random((DIMENSION, 2)) - 0.5) / DIMENSION).astype(np.float32)
    share = (np.bincount(np.asarray(labels, np.int64), minlength=2)[:2] + 1) / (len(labels) + 2)
    bias = np.log(share).astype(np.float32)
    rows = [counts(t) for t in texts]
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            held, n = rows[i]
            speed = np.float32(rate * (1 - step / steps))
            step += 1
            part = (n / max(1, n.sum())).astype(np.float32)
            hidden = part @ vectors[held]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights @ p
            weights -= speed * np.outer(hidden, p).astype(np.float32)
            bias -= np.float32(0.1) * speed * p
            # A bucket moves in proportion to its share; the average has thousands, so the step is scaled up.
            vectors[held] -= (speed * 20) * part[:, None] * back
    return Model(vectors, weights, bias)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> tuple[Texts, list[int]]:
    """A bounded sample of labelled texts: first by the hash of the text, within both bounds.

    The hash of the last sampled text is found on hashes alone; only texts up to it are then read, once
    each, so neither copies nor long texts can pass more than the bounds to the driver.
    """
    hashed = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES // 100).withColumn("h", F.xxhash64("t"))
    labelled = labels.where(F.col(label).isin(0, 1)).select(id_col, F.col(label).cast("int").alias("y"))
    cut = hashed.select(id_col, "h").join(labelled, id_col).select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if cut is None:
        return [], []
    rows = saved(hashed.where(F.col("h") <= cut).join(labelled, id_col).groupBy("h", "y").agg(F.first("t").alias("t")), "labelled-sample")
    texts: Texts = []
    found: list[int] = []
    held = 0
    for row in rows.orderBy("h", "y").toLocalIterator():
        data = row.t.encode()
        if held + len(data) <= SAMPLE_BYTES:
            held += len(data)
            texts.append(data)
            found.append(row.y)
    return texts, found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from the texts of ``docs`` that ``labels`` marks 0 or 1; other marks and null ids are left out.

    Without such rows the model gives even odds.
    """
    return train(*sample(docs, labels, id_col, text, label))


def scorer(model: Model):
    """A function from texts to scores (probability of label 1)."""
    logits = model.logits()
    base = float(model.bias[1] - model.bias[0])

    def features(words: list[bytes]) -> list[np.ndarray]:
        own, buckets, owner = word_features(words)
        return [own, np.bincount(owner, logits[buckets], len(words)), np.bincount(owner, minlength=len(words))]

    def make():
        known = WordTable(features, KNOWN_WORDS)

        def run(texts: Texts) -> list:
            split = [(t or b"").split() for t in texts]
            size = np.fromiter(map(len, split), np.int64, len(split))
            at = known.lookup([w for words in split for w in words])
            total, grams = np.zeros(len(texts)), np.zeros(len(texts))
            if len(at):
                own, weight, n = known.arrays
                owner = np.repeat(np.arange(len(texts)), size)
                total += np.bincount(owner, weight[at], len(texts))
                grams += np.bincount(owner, n[at], len(texts))
                same = owner[1:] == owner[:-1]
                pairs, again = pair_buckets(own[at], same)
                total += np.bincount(owner[1:][same], logits[pairs] + again * logits[AGAIN], len(texts))
                grams += np.bincount(owner[1:][same], 1 + again, len(texts))
            return [1 / (1 + np.exp(-(base + total / np.maximum(grams, 1))))]

        return run

    return make


def with_score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.7, else 0).

    Null, empty and wordless texts get the score of the label shares alone. Rows are scored one by
    one, so ties and repeats get equal scores. An empty table gives no rows.
    """
    scored = with_text_columns(docs, scorer(model), "score double", text, keep)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


__all__ = ["Model", "fit", "train", "with_score"]
