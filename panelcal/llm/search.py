"""Ranked lexical search of all documents by dense blocked multiplication in whole numbers.

Items are taken in blocks of a bounded number of terms. For each block one scan of the texts leaves, of
every document, its length and the block's terms in it with their counts; a second pass over that compact
table multiplies. A tile of documents gives a dense float64 matrix of impacts over the terms that occur in
it, a tile of items one of weights, and their product is the scores. All entries are whole numbers and the terms of
one product are so few that every partial sum stays below 2^53: the sums are exact in any order. A task
keeps the best of each item with all that tie with the last of them, and the order (score, doc_id) then decides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcal.llm.common import Texts, forget, saved, with_text_columns

#: (item, term) pairs of a block of items, which every executor holds.
BLOCK_PAIRS = 1_000_000
#: Items, documents and terms of a tile: its matrices hold some 16 MB each at most.
TILE_ITEMS, TILE_DOCS, TILE_TERMS = 256, 512, 4096
#: Salts of the first of the two rounds that merge the tasks' best.
SALTS = 16
#: The impact of a term is below this.
IMPACT = 1_000_000

#: Letters A-Z in lower case, digits, a-z and all bytes beyond ASCII as they are; other bytes are blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in their order; none of a null text."""
    return (text or b"").translate(FOLD).split()


def weight(documents: int, holding: int) -> int:
    """Rarity of a term that ``holding`` of ``documents`` documents hold, in thousandths."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Saturating share of a term's count in a document of relative length ``m``, in millionths."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class ItemTile(NamedTuple):
    """A tile of items: its terms are numbered anew, and ``weights`` is dense (terms x items)."""

    items: np.ndarray
    local: np.ndarray
    weights: np.ndarray
    width: int


def item_tiles(pairs: np.ndarray, w: np.ndarray, items: int) -> Iterator[ItemTile]:
    """Tiles of items 0 .. items-1 from their (item, term) pairs; terms of no weight are left out."""
    pairs = pairs[w[pairs[:, 1]] > 0]
    for start in range(0, items, TILE_ITEMS):
        here = pairs[(pairs[:, 0] >= start) & (pairs[:, 0] < start + TILE_ITEMS)]
        if len(here):
            used, column = np.unique(here[:, 1], return_inverse=True)
            local = np.full(len(w), -1, np.int32)
            local[used] = np.arange(len(used))
            weights = np.zeros((len(used), min(TILE_ITEMS, items - start)))
            weights[column, here[:, 0] - start] = w[here[:, 1]]
            bound = ((1 << 53) - 1) // (IMPACT * int(w[used].max()))
            yield ItemTile(np.arange(start, start + weights.shape[1]), local, weights, min(TILE_TERMS, bound))


def tile_scores(tile: ItemTile, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Scores (documents x items) of a tile of documents, given as (doc, term, impact), as 64-bit numbers."""
    column = tile.local[term]
    held = column >= 0
    used, column = np.unique(column[held], return_inverse=True)
    scores = np.zeros((docs, len(tile.items)), np.int64)
    for first in range(0, len(used), tile.width):
        inside = (column >= first) & (column < first + tile.width)
        dense = np.zeros((docs, min(tile.width, len(used) - first)))
        dense[doc[held][inside], column[inside] - first] = impact[held][inside]
        scores += (dense @ tile.weights[used[first : first + tile.width]]).astype(np.int64)
    return scores


class Best:
    """The k best of each item so far, by falling score, then rising id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.least = np.ones(items, np.int64)
        self.kept = (np.zeros(0, np.int64),) * 4  # item, score, no id, id
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, tile: ItemTile, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Scores that reach the k-th best so far are candidates, ties with it among them."""
        doc, item = np.nonzero(scores >= self.least[tile.items])
        if len(doc):
            self.new.append((tile.items[item], scores[doc, item], none[doc], ids[doc]))
            self.waiting += len(doc)
            if self.waiting > max(1 << 17, 4 * self.k * len(tile.items)):
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, score, none, ids = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(item)]])))
        stay = order[rank < self.k]
        self.kept = tuple(x[stay] for x in (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True)))
        last = rank == self.k - 1
        self.least[item[last]] = score[order][last]
        self.new, self.waiting = [], 0
        return self.kept


def with_terms(docs: DataFrame, numbers, text: str, keep: list[str]) -> DataFrame:
    """``n``, the terms of a text with repeats, and the broadcast terms in it: ``term`` their numbers, ``tf`` their counts."""

    def make():
        number = numbers.value

        def run(texts: Texts) -> list:
            lengths, term, tf, ends = [], [], [], [0]
            for t in texts:
                words = terms(t)
                lengths.append(len(words))
                held = [(number[x], c) for x, c in Counter(words).items() if x in number]
                term += [x for x, _ in held]
                tf += [c for _, c in held]
                ends.append(len(term))
            ends = pa.array(ends, pa.int32())
            return [lengths, pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))]

        return run

    return with_text_columns(docs, make, "n bigint, term array<int>, tf array<int>", text, keep)


def holders(hits: DataFrame, size: int) -> dict[int, int]:
    """How many documents hold each of the ``size`` terms of a block; counts merge in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["t", "c"])

    return dict(map(tuple, hits.select("term").mapInArrow(run, "t bigint, c bigint").groupBy("t").agg(F.sum("c")).collect()))


def best_of_tasks(hits: DataFrame, block, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of every item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names, pairs, w = block.value
        tiles = list(item_tiles(pairs, w, len(names)))
        best = Best(len(names), k)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                ids, n, term, tf = (batch.column(i).slice(start, TILE_DOCS) for i in range(4))
                counts = term.value_lengths().to_numpy()
                m = np.array([100 - 50 + (50 * x * documents) // total for x in n.to_pylist()], np.int64)
                doc = np.repeat(np.arange(len(counts)), counts)
                of = term.flatten().to_numpy()
                impact = impacts(tf.flatten().to_numpy().astype(np.int64), m[doc])
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                known = ids.fill_null(0).to_numpy()
                for tile in tiles:
                    best.add(tile, tile_scores(tile, doc, of, impact, len(counts)), known, none)
        item, score, none, ids = best.settle()
        columns = [pa.array([names[i] for i in item], pa.int64()), pa.array(ids, mask=none.astype(bool)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc", "score"])

    return hits.select("doc", "n", "term", "tf").where(F.size("term") > 0).mapInArrow(run, "item bigint, doc bigint, score bigint")


def ranked(best: DataFrame, k: int) -> DataFrame:
    """The k best of each item of all tasks, in two rounds, so that one task meets k rows a salt."""
    order = [F.desc("score"), F.col("doc").asc_nulls_last()]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(SALTS))).orderBy(*order)
    some = best.withColumn("at", F.row_number().over(part)).where(F.col("at") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item id, rank, doc id, score): the k documents of highest score above 0 of each item, equal scores by rising id.

    Null and empty texts have no terms: such documents count nowhere, such items get no rows. The texts of
    rows that share an item id are taken together, null being one such id; documents of null id take part and rank last among equals; rows
    that repeat a document are documents of their own. Empty tables give no rows. Columns other than those
    named are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("body"))
    listed = with_text_columns(asked, lambda: lambda texts: [[sorted(set(terms(t))) for t in texts]], "term array<binary>", "body", ["item"])
    pairs = saved(listed.select("item", F.explode("term").alias("term")).distinct(), "item-terms")
    blocks = -(-pairs.count() // BLOCK_PAIRS)
    whole = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("body"))
    parts = []
    for b in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        names = sorted({r.item for r in rows}, key=lambda x: (x is not None, x))
        number = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        hits = saved(with_terms(whole, spark.sparkContext.broadcast(number), "body", ["doc"]), "terms")
        documents, total = hits.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = holders(hits, len(number))
        w = np.array([weight(documents, held[i]) if i in held else 0 for i in range(len(number))], np.int64)
        place = {x: i for i, x in enumerate(names)}
        numbered = np.array([(place[r.item], number[bytes(r.term)]) for r in rows], np.int64).reshape(-1, 2)
        block = spark.sparkContext.broadcast((names, numbered, w))
        parts.append(best_of_tasks(hits, block, documents, max(total, 1), k))
    best = parts[0] if parts else spark.createDataFrame([], "item bigint, doc bigint, score bigint")
    for part in parts[1:]:
        best = best.unionByName(part)
    return ranked(best, k).select(F.col("item").alias(item_col), F.col("rank").cast("int"), F.col("doc").alias(id_col), "score")
