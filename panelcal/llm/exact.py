"""Exact duplicates: groups of a 128-bit content hash, their bytes compared, the smallest stable id kept.

Only the hash, the digest and the id of a row are grouped and joined. Of the texts those alone are
shuffled whose hash another row shares, and of these each once per task: equal texts of a task merge
before the shuffle, so a text that a third of all rows hold moves once per task. Two different texts of
one hash make two groups, whatever the hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcal.llm.common import aside, few, restored, saved

#: Runs of these characters are one space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    """The text with each run of blanks as one space, ends included; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text as binary."""
    return F.unhex(F.md5(text.cast("binary")))


def first_row(row: str, id_col: str) -> Column:
    """The row number of the smallest id, null ids last, equal ids by row number."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")))


def copy_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of ``docs``, repeated rows included.

    Rows are one group if their normalised texts are equal byte for byte; null and empty texts are one
    group, a text of blanks alone is one space. The row of the smallest id is kept; of rows that repeat this id
    one is, and a null id only where the group has no other (``keep_id`` is then null). Other columns of
    ``docs`` are not read, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(text).alias("whole")).withColumn("h", digest(F.col("whole")))
    prints = saved(rows.select("id", "h", F.unhex(F.sha2(F.col("whole").cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "prints")
    grouped = prints.groupBy("h").agg(F.count("*").alias("size"), first_row("row", "id").alias("first"))
    shared = saved(grouped.where("size > 1").select("h", "size", "first"), "shared-hashes")
    small = few(shared)
    texts = rows.join(small.select("h"), "h", "left_semi").groupBy("h", "whole").agg(F.count("*").alias("copies"))
    mixed = saved(texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "mixed-hashes")
    alone = F.struct(F.lit(False).alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    joined = prints.join(small, "h", "left").select("h", "id", "sha", "row", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("first", alone).alias("first"))
    if mixed.isEmpty():
        return placed(joined, id_col)
    # Different texts of one hash: these rows are grouped by their bytes.
    members = saved(rows.join(mixed, "h", "left_semi").withColumn("row", F.monotonically_increasing_id()), "mixed-rows")
    own = members.groupBy("h", "whole").agg(F.count("*").alias("size"), first_row("row", "id").alias("first"))
    apart = members.join(own, ["h", "whole"]).withColumn("sha", F.unhex(F.sha2(F.col("whole").cast("binary"), 256)))
    return placed(joined.join(mixed, "h", "left_anti"), id_col).unionByName(placed(apart, id_col))


def placed(rows: DataFrame, id_col: str) -> DataFrame:
    """The result columns of rows that bear their group's size and first row."""
    return rows.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``copy_groups`` keeps, with their columns.

    The rows that go are looked up by id and digest, so the texts themselves are not shuffled while that
    table is small; of rows equal in id and normalised text any one stays.
    """
    groups = saved(copy_groups(docs, text, id_col).select(F.col(id_col).alias("id"), "keep_id", "kept", F.unhex("text_sha256").alias("sha")), "copy-groups")
    key = lambda rows: rows.select(F.col("id").alias("at"), F.col("sha").alias("of"))
    same = F.col("id").eqNullSafe(F.col("at")) & (F.col("sha") == F.col("of"))
    # The row that stays in a group is of its keep_id, null ids among them.
    gone = few(saved(key(groups.where(~F.col("id").eqNullSafe(F.col("keep_id")))).distinct(), "gone-rows"))
    repeated = saved(key(groups.where(F.col("id").eqNullSafe(F.col("keep_id")))).groupBy("at", "of").count().where("count > 1").drop("count"), "repeated-rows")
    rows = docs.select(*aside(docs), F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("sha"))
    stays = rows.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        once = stays.join(repeated, same, "left_semi").dropDuplicates(["id", "sha"])
        stays = stays.join(repeated, same, "left_anti").unionByName(once)
    return stays.select(*restored(docs))
