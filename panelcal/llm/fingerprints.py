"""Document fingerprints by SimHash, and their search within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcal.llm.common import Texts, WordTable, mix64, with_text_columns
from panelcal.llm.simhash import signed, vote
from panelcal.session import local_rows

#: Weight of a pair of neighbouring words against that of a character of a single word.
PAIR_WEIGHT = 4
LONGEST = 12


def word_hashes(words: list[bytes]) -> list[np.ndarray]:
    h = xxhash.xxh64_intdigest
    return [np.fromiter((h(w, 1) for w in words), np.uint64, len(words)), np.fromiter((min(len(w), LONGEST) for w in words), np.int64, len(words))]


class Fingerprints:
    """Weighted SimHash of whole texts.

    Terms are the words (runs without white space, A-Z in lower case), each of its length as weight, so
    that short common words say little, and all pairs of neighbouring words. Repeats count. Each term's hash votes
    with its weight for or against each of 64 bits. A text without words has fingerprint 0.
    """

    def __init__(self) -> None:
        self.known = WordTable(word_hashes)

    def of(self, text: bytes | None) -> int:
        words = (text or b"").lower().split()
        if not words:
            return 0
        at = self.known.lookup(words)
        own, weight = self.known.arrays[0][at], self.known.arrays[1][at]
        pairs = mix64(own[:-1] * np.uint64(3) + own[1:])
        return vote(np.concatenate([own, pairs]), np.concatenate([weight, np.full(len(pairs), PAIR_WEIGHT)]))


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a long. Equal texts have equal fingerprints; null is as empty."""

    def make():
        prints = Fingerprints()
        return lambda texts: [np.array([signed(prints.of(t)) for t in texts], np.int64)]

    return with_text_columns(docs, make, "fp bigint", text, keep)


def hexed(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def block_tables(radius: int, blocks: int) -> list[int]:
    """Masks of the permuted tables: each keeps ``blocks - radius`` of the blocks; close fingerprints agree in one at least."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(query, found, distance): for each distinct query fingerprint, all distinct fingerprints within the radius.

    Both tables have a column ``fp``; nulls take no part. Each fingerprint stands once in every block table under its
    masked bits, and a pair that several tables bring together is returned by the first of them alone, so no
    duplicate has to be removed. Equal fingerprints are one, so copies make no pairs.
    """
    masks = [signed(m) for m in block_tables(radius, blocks or radius + 2)]

    def spread(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
        return df.select("fp").where("fp is not null").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("c")).select(name, "c.t", "c.k")

    met = spread(queries, "query").join(spread(fingerprints, "found"), ["t", "k"])
    apart = F.col("query").bitwiseXOR(F.col("found"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    return met.where(F.bit_count(apart) <= radius).where(first == F.col("t")).select("query", "found", F.bit_count(apart).alias("distance"))


def packed_texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, chars, packed): whole texts, compressed, so that shuffling them costs a part of their size."""

    def make():
        press = zstandard.ZstdCompressor(level=3)

        def run(texts: Texts) -> list:
            data = [t or b"" for t in texts]
            return [[press.compress(t) for t in data]]

        return run

    return with_text_columns(docs.withColumn("__order", F.xxhash64(text)), make, "packed binary", text, [id_col, "__order"])


def edit(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and of the next text in ascending id order.

    (id, n_chars, edited_sha256, fp, edited_fp, next_fp). The text after the last is the first; a table of one row
    follows itself. Null texts count as empty, null ids come first, equal ids are ordered by the hash of their texts.
    Ids are cut into ranges of about equal counts at sketched quantiles; one shuffle of compressed texts brings each
    range together, with the first rows of the next range, which a task then reads in order, two texts at a time.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    parts = 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = ids.stat.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (20 * parts))
    edges = F.array(*[F.lit(e).cast("long") for e in sorted({int(c) for c in cuts})])
    part = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e < F.col("id"))))
    # The first row of each range, at most one per partition; it also follows the last row of the range before.
    heads = ids.groupBy(part.alias("p")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "h")).alias("first")).orderBy("p").collect()
    named = [(heads[i - 1].p, h.first.id, h.first.h) for i, h in enumerate(heads)] or [(0, 0, 0)]
    ahead = F.broadcast(local_rows(spark, named, "before int, head_id bigint, head_h bigint"))
    packed = packed_texts(docs, id_col, text).withColumnRenamed(id_col, "id").withColumnRenamed("__order", "h")
    joined = packed.join(ahead, F.col("id").eqNullSafe(F.col("head_id")) & F.col("h").eqNullSafe(F.col("head_h")), "left")
    dealt = joined.select("id", "h", "packed", F.explode(F.array(F.struct(part.alias("p"), F.lit(False).alias("ahead")), F.struct(F.col("before").alias("p"), F.lit(True).alias("ahead")))).alias("e")).where("e.p is not null")
    placed = dealt.select("e.p", "e.ahead", "id", "h", "packed").repartition(parts, "p").sortWithinPartitions("p", "ahead", "id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, unpack = Fingerprints(), zstandard.ZstdDecompressor()
        last: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for p, after, i, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if after and (last is None or last[0] != p):
                    continue  # the range has got its follower
                raw = unpack.decompress(data)
                fp = prints.of(raw)
                content = raw.decode()
                if last is not None and last[0] == p:
                    changed = edit(last[2], content).encode()
                    out.append((last[1], len(last[2]), hashlib.sha256(changed).hexdigest(), signed(last[3]), signed(prints.of(changed)), signed(fp)))
                last = None if after else (p, i, content, fp)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"])

    return placed.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, next_fp bigint").withColumnRenamed("id", id_col)
