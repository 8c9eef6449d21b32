"""What the operators share: whole texts in Arrow batches, a global row order, components of links."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcal.session import local_rows, scratch_path, stored

#: A batch of texts is cut so that one slice holds at most so many bytes, or one text.
#: Words as Python objects take many times their bytes: a task of the quality classifier takes 76 MB with slices of 4 MB, 22 with these.
SLICE_BYTES = 500_000

#: Rows and bytes of texts that go to a Python step at once.
BATCH_ROWS = 1000
BATCH_BYTES = 4_000_000

Texts = list[bytes | None]

#: The C library's call that returns freed pages, where there is one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: What an operator remembers from task to task in a Python worker; the next operator's first task there frees it.
RECALL: dict[str, tuple[dict, ...]] = {}


def cuts(column: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """An Arrow string column in parts of at most ``limit`` bytes, or one text, and where each begins."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, column.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, column.slice(start)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """The texts of an Arrow string column as UTF-8 bytes, a few MB at a time."""
    for start, part in cuts(column, limit):
        yield start, part.cast(pa.binary()).to_pylist()


def wrapped(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct for a Python step or a stored table; ``doc.*`` gives them back. No helper column can bear the name of one."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def aside(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` under numbers, so that no helper column can bear the name of one; ``restored`` gives the names back.

    For joins and groups, where Spark would reason about each field of a struct.
    """
    return [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)]


def restored(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` in their order, from those that ``aside`` numbered."""
    return [F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)]


def short_batches(spark: SparkSession) -> None:
    """From here on the session hands Python steps at most ``BATCH_ROWS`` rows at once, and no further row after ``BATCH_BYTES``.

    Of whole texts the defaults of 10,000 rows and 64 MB are some 30 MB, which a task holds several times: in Spark's buffers outside
    the heap, which double as they grow, and in the worker. Of long texts 1,000 rows alone can be more.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def forget() -> None:
    """Free what the worker's last operator remembered."""
    RECALL.clear()
    trim()


def trim() -> None:
    """Give memory that a task has freed back to the system: idle workers share an executor's memory with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def with_text_columns(
    df: DataFrame,
    make: Callable[[], Callable[[Texts], list]],
    fields: str,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns that a Python function computes from whole texts, an Arrow batch at a time.

    ``make`` is called once per task and returns the function; that takes the UTF-8 texts of a slice
    (null: None) and returns a column (list, numpy or Arrow array) per field of the DDL string ``fields``.
    ``keep`` names the columns that stay (default: all); one that bears the name of a new column is replaced.
    """
    new = T._parse_datatype_string(fields)
    names = [f.name for f in new.fields]
    stay = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in stay] + list(new.fields))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        function = make()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for start, texts in slices(column):
                old = [batch.column(i).slice(start, len(texts)) for i in range(len(stay))]
                made = function(texts)
                columns = [pa.array(x, type=t) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x.cast(t) for x, t in zip(made, arrow.types[len(stay) :], strict=True)]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(old, arrow.types, strict=False)] + columns, schema=arrow)
        function = column = old = made = columns = None
        trim()

    short_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in stay], F.col(text).alias("__whole text")).mapInArrow(run, schema)


class WordTable:
    """Word -> row of feature arrays, filled on demand and emptied when it has grown past ``limit``.

    ``features(words)`` returns one array per feature for a list of new words, so that the dear part
    of a word is done once per task and table, not once per occurrence.
    """

    def __init__(self, features: Callable[[list[bytes]], list[np.ndarray]], limit: int = 400_000) -> None:
        self.features, self.limit = features, limit
        self.rows: dict[bytes, int] = {}
        self.arrays: list[np.ndarray] = []

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words in ``arrays``, which is valid until the next call."""
        if len(self.rows) > self.limit:
            self.rows, self.arrays = {}, []
        found = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(found < 0)
        if len(lost):
            new = list({words[i] for i in lost})
            base = len(self.rows)
            self.rows.update(zip(new, range(base, base + len(new)), strict=True))
            made = self.features(new)
            self.arrays = [np.concatenate([a, b]) for a, b in zip(self.arrays, made, strict=True)] if self.arrays else made
            found[lost] = np.fromiter(map(self.rows.__getitem__, [words[i] for i in lost]), np.int64, len(lost))
        return found


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift-multiply steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(words: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of ``<word>`` and the number of the word each belongs to."""
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))
    hashes, owners, h = [], [], np.zeros(len(text), np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[: len(text) - n + 1] * np.uint64(0x100000001B3) + text[n - 1 :] + np.uint64(n)
        if n in sizes:
            whole = left[: len(h)] >= n
            hashes.append(mix64(h[whole]))
            owners.append(owner[: len(h)][whole])
    return np.concatenate(hashes), np.concatenate(owners)


def number_rows(df: DataFrame, by: list, name: str = "row") -> DataFrame:
    """Global row numbers 0, 1, ... in the order of ``by``, without a one-task window.

    The rows are range-partitioned, sorted and stored once with their position in their partition;
    one count per partition then gives the offsets. Rows equal in ``by`` get any order among them.
    """
    spark = df.sparkSession
    placed = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    counts = sorted(tuple(x) for x in placed.groupBy(part.alias("p")).count().collect())
    starts = accumulate((n for _, n in counts), initial=0)
    offsets = local_rows(spark, [(p, s) for (p, _), s in zip(counts, starts, strict=False)] or [(0, 0)], "__p bigint, __start bigint")
    return placed.join(F.broadcast(offsets), part == F.col("__p")).withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__start")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of the links; root is the smallest node of its component.

    Alternating large-star and small-star steps: each takes a minimum per node (combined before the
    shuffle) and joins it back, so that a node with very many links is a skewed join that Spark splits,
    never one group in a task. A round is written to the shared folder; the loop ends when a round
    changes nothing. Nothing but a count and a checksum comes to the driver.
    """
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Rows of a stored side that a join may broadcast: some 30 MB at a hundred bytes a row.
BROADCAST_ROWS = 250_000


def few(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, which are counted; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def saved(df: DataFrame, name: str) -> DataFrame:
    """``stored`` under this subpackage's prefix."""
    return stored(df, f"llm-{name}")


__all__ = ["Texts", "WordTable", "aside", "components", "cuts", "few", "forget", "mix64", "ngrams", "number_rows", "restored", "saved", "scratch_path", "short_batches", "slices", "trim", "with_text_columns", "wrapped"]
