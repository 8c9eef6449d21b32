"""An index of sorted scores that a stream is joined with, page by page.

The distinct scores of a cell, with the number of rows up to each, are cut into pages of ``PAGE``
entries; the last entries of ``PAGE`` pages make a page of the next level, up to one page a cell. A
lookup is one equi-join and one binary search a level: no row, task or worker ever holds more than a page
of a cell. The same pages answer both questions of a conformal step: how many scores lie below a
value, and which score has a rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcal.operators.ranks import running_totals
from panelcal.session import stored

PAGE = 1024


@dataclass(frozen=True)
class ScoreIndex:
    """``levels`` from the root to the leaves: (cell, page, v, p, base), with the sorted scores, the rows up to each, and the rows before the page."""

    cell: tuple[str, ...]
    levels: tuple[DataFrame, ...]

    def _walk(self, rows: DataFrame, wanted: Column, by: str, out: str) -> DataFrame:
        """Adds the leaf page's arrays and ``out``, how many of its entries lie below ``wanted``."""
        found = rows.withColumn("_page", F.lit(0).cast("bigint"))
        for depth, level in enumerate(self.levels):
            page = level.withColumnsRenamed({"page": "_page", "v": "_v", "p": "_p", "base": "_base"})
            found = found.join(page, [*self.cell, "_page"], "left")
            before = entries_below(F.col(f"_{by}"), wanted)
            if depth == 0:
                found = found.withColumn("_n", F.coalesce(F.element_at("_p", -1), F.lit(0).cast("bigint")))
            if depth < len(self.levels) - 1:
                at = F.least(before, F.size(f"_{by}") - 1)
                found = found.withColumn("_page", F.coalesce(F.col("_page") * PAGE + at, F.lit(0).cast("bigint"))).drop("_v", "_p", "_base")
            else:
                found = found.withColumn(out, before)
        return found.drop("_page")

    def with_counts(self, rows: DataFrame, value: Column, below: str = "below", n: str = "n") -> DataFrame:
        """``rows`` with the number of scores of their cell and of those below ``value``; a cell without scores has none."""
        found = self._walk(rows, value, "v", "_at")
        count = F.when(F.col("_at") > 0, F.get("_p", F.col("_at").cast("int") - 1)).otherwise(F.col("_base"))
        return found.withColumn(below, F.coalesce(count, F.lit(0).cast("bigint"))).withColumn(n, F.col("_n")).drop("_v", "_p", "_base", "_at", "_n")

    def with_score_at(self, rows: DataFrame, rank: str, out: str) -> DataFrame:
        """``rows`` with the score of their cell at a 1-based rank; null where the rank is null or beyond the scores."""
        found = self._walk(rows, F.coalesce(F.col(rank), F.lit(0).cast("bigint")), "p", "_at")
        score = F.get("_v", F.col("_at").cast("int"))
        return found.withColumn(out, F.when(F.col(rank).between(1, F.col("_n")), score)).drop("_v", "_p", "_base", "_at", "_n")


def entries_below(entries: Column, wanted: Column) -> Column:
    """How many entries of a sorted array of at most ``PAGE`` lie below a value, by halving."""
    jumps = F.array(*[F.lit(PAGE >> i) for i in range(PAGE.bit_length())])
    step = lambda at, jump: F.when(F.get(entries, at + jump - 1) < wanted, at + jump).otherwise(at)
    return F.aggregate(jumps, F.lit(0), step)


def index_scores(scores: DataFrame, cell: Sequence[str], score: str = "score") -> ScoreIndex:
    """The stored index of the scores of every cell. Null scores are left out; an empty table has one empty level."""
    cell = list(cell)
    values = scores.where(F.col(score).isNotNull()).groupBy(*cell, F.col(score).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("ties"))
    one = F.lit(1).cast("bigint").alias("one")
    numbered = running_totals(values.select("*", one), cell, "v", {"ties": "p", "one": "ordinal"})
    entries = stored(numbered.select(*cell, F.col("ordinal") - 1, "v", "p", (F.col("p") - F.col("ties")).alias("before")).toDF(*cell, "at", "v", "p", "before"), "score-entries")
    most = (entries.agg(F.max("at")).first()[0] or 0) + 1
    levels = []
    while True:
        group = entries.groupBy(*cell, F.floor(F.col("at") / PAGE).alias("page"))
        # At most PAGE entries of a group, by their numbers.
        pages = group.agg(F.array_sort(F.collect_list(F.struct("v", "p"))).alias("e"), F.min("before").alias("base"))
        level = stored(pages.select(*cell, "page", F.col("e.v").alias("v"), F.col("e.p").alias("p"), "base"), "score-pages")
        levels.insert(0, level)
        if most <= PAGE:
            return ScoreIndex(tuple(cell), tuple(levels))
        entries = level.select(*cell, F.col("page").alias("at"), F.element_at("v", -1).alias("v"), F.element_at("p", -1).alias("p"), F.col("base").alias("before"))
        most = -(-most // PAGE)
