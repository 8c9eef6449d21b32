"""Language identification as a mixture: which languages a document is made of, and in what shares.

A word's likelihood under a language is that of its character n-grams (smoothed relative frequencies
learned per language). A document is a mixture of languages over its words; expectation-maximisation
estimates the shares. The set of languages is chosen by penalised likelihood: for each size, the
languages of largest share are fitted alone, and a larger set must gain more than its penalty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.llm.common import Texts, WordTable, ngrams, saved, with_text_columns

#: Texts learned from for each language, at most: the first by the hash of the text.
SAMPLE_PER_LANGUAGE = 1500
#: Characters of a text above which it is not learned from (it is still predicted, whole).
SAMPLE_CHARS = 20_000
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 18
SMOOTHING = 0.5
#: Log likelihood of a word is bounded below relative to its best language, so that no single word decides.
FLOOR = -12.0
FULL_STEPS, SET_STEPS = 8, 5
#: Languages of a set at most considered; a document of more is described by its largest ones.
LARGEST_SET = 4
#: Penalty for each further language, in units of log(words).
PENALTY = 2.0
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: log probability of each n-gram bucket under each language (bucket x language).
    table: np.ndarray


def buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, owner = ngrams(words, SIZES)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), owner


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").decode("utf-8", "replace").lower().encode().split()


def learn(texts: list[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs; every text counts by its n-gram frequencies."""
    languages = sorted({lang for lang, _ in texts})
    counts = np.zeros((BUCKETS, max(1, len(languages))))
    for i, lang in enumerate(languages):
        seen: dict[bytes, int] = {}
        for other, text in texts:
            if other == lang:
                for w in words_of(text.encode()):
                    seen[w] = seen.get(w, 0) + 1
        if seen:
            b, owner = buckets(list(seen))
            counts[:, i] += np.bincount(b, np.fromiter(seen.values(), float, len(seen))[owner], BUCKETS)
    smooth = counts + SMOOTHING
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from a bounded sample of the texts with a language; null texts and languages are left out.

    The bound holds per language: the sampled hashes are found on hashes alone, and each text counts
    once, so copies cannot fill it.
    """
    hashed = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select(
        F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h")
    )
    kinds = hashed.groupBy("l").count().collect()
    cuts = []
    for row in kinds:
        # Hashes are uniform: the k-th smallest of the texts of a language bounds its sample.
        last = hashed.where(F.col("l") == row.l).select("h").distinct().orderBy("h").limit(SAMPLE_PER_LANGUAGE).agg(F.max("h")).first()[0]
        cuts.append((row.l, last))
    if not cuts:
        return Model([], np.zeros((BUCKETS, 1), np.float32))
    chosen = F.lit(False)
    for language, last in cuts:
        chosen = chosen | ((F.col("l") == language) & (F.col("h") <= last))
    rows = saved(hashed.where(chosen).groupBy("l", "h").agg(F.first("t").alias("t")), "language-sample")
    return learn([(r.l, r.t) for r in rows.orderBy("l", "h").toLocalIterator()])


def expectation_maximisation(likelihood: np.ndarray, owner: np.ndarray, shares: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """Shares (text x language) after some steps; a share of zero stays zero."""
    size = np.diff(np.append(starts, len(owner)))[:, None]
    for _ in range(steps):
        part = likelihood * shares[owner]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        shares = np.add.reduceat(part, starts, axis=0) / size
    return shares


def mixtures(loglik: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the chosen language sets, and the number of languages of each text with words.

    ``loglik`` is word x language, texts one after the other; every entry of ``sizes`` is positive.
    """
    likelihood = np.exp(np.maximum(loglik - loglik.max(axis=1, keepdims=True), FLOOR)).astype(np.float32)
    n, k = len(sizes), likelihood.shape[1]
    owner = np.repeat(np.arange(n), sizes)
    starts = np.cumsum(sizes) - sizes
    full = expectation_maximisation(likelihood, owner, np.full((n, k), 1 / k, np.float32), starts, FULL_STEPS)
    order = np.argsort(-full, axis=1, kind="stable")
    best, best_shares, best_size = np.full(n, -np.inf), np.zeros((n, k)), np.zeros(n, np.int64)
    for size in range(1, min(k, LARGEST_SET) + 1):
        mask = np.zeros((n, k), bool)
        np.put_along_axis(mask, order[:, :size], True, axis=1)
        shares = np.where(mask, np.maximum(full, 1e-6), 0).astype(np.float32)
        shares /= shares.sum(axis=1, keepdims=True)
        if size > 1:
            shares = expectation_maximisation(likelihood, owner, shares, starts, SET_STEPS)
        value = np.add.reduceat(np.log(np.maximum((likelihood * shares[owner]).sum(axis=1), 1e-30)), starts) - PENALTY * size * np.log(sizes + 1.0)
        better = value > best
        best[better], best_shares[better], best_size[better] = value[better], shares[better], size
    return best_shares, best_size


def with_language(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its share) and ``languages`` (the chosen set, largest first).

    Null texts and texts without a letter get ``und``, score 0 and an empty set; so do all if nothing
    was learned. Equal shares go to the language that sorts first.
    """
    languages = model.languages

    def features(words: list[bytes]) -> list[np.ndarray]:
        b, owner = buckets(words)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words)))
        return [np.add.reduceat(model.table[b[order]], starts, axis=0)]

    def make():
        known = WordTable(features)

        def run(texts: Texts) -> list:
            decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
            letters = [any(map(str.isalpha, t)) for t in decoded]
            words = [t.lower().encode().split() if has and languages else [] for t, has in zip(decoded, letters, strict=True)]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            name, score, chosen = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            at = np.flatnonzero(sizes)
            if len(at):
                rows = known.lookup([w for ws in words for w in ws])
                shares, count = mixtures(known.arrays[0][rows], sizes[at])
                order = np.argsort(-shares, axis=1, kind="stable")
                for j, i in enumerate(at.tolist()):
                    name[i] = languages[order[j, 0]]
                    score[i] = min(1.0, shares[j, order[j, 0]])
                    chosen[i] = [languages[x] for x in order[j, : count[j]]]
            return [name, score, chosen]

        return run

    return with_text_columns(docs, make, "lang_pred string, score double, languages array<string>", text, keep)
