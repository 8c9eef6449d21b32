"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

A row's place in the shuffled order is a keyed permutation of its row number, so shard and slot are
computed, not drawn, and any row's place can be found again from (row number, row count, seed).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelcal.llm.common import mix64, number_rows

#: Rounds of the Feistel network.
ROUNDS = 6


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0 .. n-1 at the given numbers.

    The network acts on the smallest even number of bits that holds n (fewer than 4 n values). Results
    of n and above are permuted again until they fall below n (cycle walking): as the walk follows
    a cycle of the outer permutation that began below n, it ends, and the restriction is a bijection.
    """
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mix64(right + key) & mask)
        return (left << half) | right

    out = once(numbers.astype(np.uint64))
    while len(out_of_range := np.flatnonzero(out >= np.uint64(n))):
        out[out_of_range] = once(out[out_of_range])
    return out.astype(np.int64)


def shuffled_place(row: str | Column, n: int, seed: int) -> Column:
    """Place of row number ``row`` in the shuffled order of n rows."""

    @pandas_udf("bigint")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return place(row)


def shard_rows(df: DataFrame, by: list, shards: int = 8, seed: int = 0) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0 in each shard).

    Rows are numbered in the order of ``by``; row number r goes to place p = permutation(r), shard
    p mod shards and slot p div shards. So shard sizes differ by one at most, whatever keys, texts or
    sizes the rows have. Rows equal in ``by`` are interchangeable. Nulls sort first; an empty table
    gives no rows. Columns named ``shard`` or ``slot`` are replaced.
    """
    kept = df.drop("shard", "slot")
    numbered = number_rows(kept, by, "__row")
    n = numbered.count()
    place = shuffled_place("__row", max(n, 1), seed)
    return (
        numbered.withColumn("__place", place)
        .withColumn("shard", (F.col("__place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"__place div {int(shards)}"))
        .drop("__row", "__place")
    )
