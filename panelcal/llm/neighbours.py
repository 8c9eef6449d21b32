"""Nearest neighbours by inner product with query-aware collision counting.

Inner products become distances: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q M / |q|, 0) have
|x' - q'|^2 = 2 M^2 - 2 M q.x / |q|, so nearest is largest. Each of ``PROJECTIONS`` random directions keeps
its projections sorted. A window around the query's own projection widens with the radius R (R, cR, c^2 R, ...: virtual
rehashing, by the ends of the window in the sorted array); a vector that falls in the windows of at least ``THRESHOLD`` of the
directions is verified by its exact inner product. A search ends when the k-th best verified vector lies within R, and
no number of candidates ends it before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcal.llm.common import saved

PROJECTIONS = 32
#: Width of a window at radius 1, in units of a projection's standard deviation at distance 1.
WIDTH = 2.7
#: A vector at distance R falls in a window with probability 0.82; it is verified from this share of windows on.
THRESHOLD = 0.72
FIRST_RADIUS, RATIO = 0.3, 1.1
#: Distinct vectors and queries of a block.
BLOCK_VECTORS, BLOCK_QUERIES = 60000, 512
SEED = 11


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, largest: float) -> None:
        rng = np.random.default_rng(SEED)
        d = vectors.shape[1]
        self.vectors, self.largest = vectors, largest
        self.short = vectors.astype(np.float32)
        self.directions = rng.standard_normal((d + 1, PROJECTIONS))
        norms = (vectors * vectors).sum(axis=1)
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(largest**2 - norms, 0))])
        projected = lifted @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and inner products of the k nearest found (all, if fewer), in no order.

        As the radius grows, only the two new ends of each window are counted.
        """
        n = len(self.vectors)
        norm = float(np.sqrt((query * query).sum()))
        centre = np.append(query * (self.largest / norm), 0.0) @ self.directions
        seen = np.zeros(n, bool)
        found, products = np.zeros(0, np.int64), np.zeros(0)
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        radius = FIRST_RADIUS * self.largest
        hits = np.zeros(n, np.int64)
        low = high = np.array([s.searchsorted(c) for s, c in zip(self.sorted, centre, strict=True)])
        waiting: list[np.ndarray] = []
        while True:
            reach = WIDTH / 2 * radius
            before, after = low, high
            low = np.array([s.searchsorted(c - reach) for s, c in zip(self.sorted, centre, strict=True)])
            high = np.array([s.searchsorted(c + reach, "right") for s, c in zip(self.sorted, centre, strict=True)])
            for order, a, b, c, d in zip(self.order, low.tolist(), before.tolist(), after.tolist(), high.tolist(), strict=True):
                waiting += (order[a:b], order[c:d])
            new = np.zeros(0, np.int64)
            if (high - low).sum() >= need * min(k, n):  # else the windows cannot hold k candidates
                hits += np.bincount(np.concatenate(waiting), minlength=n)
                waiting = []
                new = np.flatnonzero((hits >= need) & ~seen)
            if radius >= 2 * self.largest and len(found) + len(new) < min(k, n):
                new = np.flatnonzero(~seen)
            if len(new):
                seen[new] = True
                found = np.concatenate([found, new])
                products = np.concatenate([products, self.short[new] @ query.astype(np.float32)])
                if len(found) > 4 * k:
                    # Ties with the k-th stay, for the caller to order; the slack covers single precision.
                    keep = products >= np.partition(products, len(products) - k)[len(products) - k] - 1e-4 * self.largest * norm
                    found, products = found[keep], products[keep]
            if len(found) >= min(k, n):
                kth = np.partition(products, len(products) - min(k, n))[len(products) - min(k, n)]
                if 2 * self.largest**2 - 2 * self.largest * kth / norm <= radius**2 or radius >= 2 * self.largest:
                    return found, (self.vectors[found] * query).sum(axis=1)
            radius *= RATIO


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): distinct rows whose vector is whole, finite, not zero and of the commonest length."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = v.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0)).distinct()
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    return good.where(F.size("v") == (size.n if size else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, itself left out, ties to the smaller id.

    Vectors and queries that are null, zero, of an odd length or hold null or non-finite components take no
    part, nor do null ids; identical rows are one. Equal vectors are searched for once and share their result, and of equal vectors only the
    k + 1 smallest ids can matter, which are kept before the shuffle: so a vector that a third of all rows have is one vector.
    """
    data, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = data.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    groups = saved(kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = saved(asked, "queries")
    kinds = saved(asked.groupBy("v").agg(F.min("vec_id").alias("q")), "query-kinds")
    size = groups.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    largest = float(np.sqrt(size.m or 0.0)) * (1 + 1e-12)
    blocks = max(1, -(-size.n // BLOCK_VECTORS))
    rounds = max(1, -(-kinds.count() // BLOCK_QUERIES))
    left = groups.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("c"), "ids", "v")
    right = kinds.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("v"), F.lit(rounds)).cast("int").alias("c"), "q", "v")

    def block(points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(points) and len(wanted):
            index = Index(np.stack(points["v"].to_numpy()).astype(np.float64), largest)
            ids = points["ids"].to_numpy()
            for q, v in zip(wanted["q"], wanted["v"], strict=True):
                found, products = index.search(np.asarray(v, np.float64), k + 1)
                order = np.argsort(-products, kind="stable")
                kth = products[order[min(k, len(order) - 1)]]
                order = order[products[order] >= kth]
                members = [ids[i] for i in found[order]]
                scores = np.repeat(products[order], [len(m) for m in members])
                flat = np.concatenate(members)
                best = np.lexsort((flat, -scores))[: k + 1]
                out.append((np.full(len(best), q), flat[best], scores[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("q", "vec_id", "score"), columns, strict=True)))

    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(block, "q bigint, vec_id bigint, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    members = asked.join(kinds, "v").select(F.col("vec_id").alias("query_id"), "q")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = members.join(top, "q").where("vec_id != query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
