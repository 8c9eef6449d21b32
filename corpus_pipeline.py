"""documents -> packed training sequences: filter, deduplicate, pseudonymise, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcal.llm import mixing, neardup, packing, pii, quality
from panelcal.llm.common import aside, restored, saved, wrapped
from panelcal.llm.queries import PII_KEY, held_out, table, tokenizer_path

#: Sources keep their shares to this power: large ones give way to small ones.
TEMPERATURE = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, learned from the labelled and not held-out of these documents, scores below 0.7.

    Null and wordless texts are scored like others, equal texts alike; no documents give none. Columns of any name stay as they are.
    """
    model = quality.fit(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return quality.with_score(docs.select(wrapped(docs), "text"), model, keep=["doc"]).where("predicted = 1").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, similarity 0.8 or more.

    Null and wordless texts are one class; of a class the smallest doc_id stays, of rows that repeat it one. No documents give none.
    Columns of any name stay as they are.
    """
    return neardup.one_per_class(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to pseudonyms of the same format; n_chars follows the new text.

    Null and empty texts stay; equal values get equal pseudonyms. No documents give none. Other columns stay as they are.
    """
    found = pii.pseudonymise(docs.select(wrapped(docs), "text"), PII_KEY, keep=["doc", "text"])
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources interleaved by tempered weights; every document is there, those of small sources again until the largest is used up.

    A written file holds whole stretches of the schedule, in its order. A null source is a source, null texts and ids are
    documents like others; rows equal in id, source and text take the other columns of one of them. No documents give none.
    """
    ids = docs.select("doc_id", "source", F.xxhash64("text").alias("h"))
    mixed = mixing.mix(ids, mixing.tempered_weights(docs, TEMPERATURE), by=["doc_id", "h"])
    once = docs.select(*aside(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of")).dropDuplicates(["id", "of"])
    placed = mixed.join(once, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("of")))
    stretch = F.expr(f"slot div {mixing.RESOLUTION // 10}")
    ordered = placed.withColumn(f"__{docs.columns.index('source')}", F.col("source")).repartition(stretch).sortWithinPartitions("slot", "place")
    return ordered.select(*restored(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document and where each lies in which sequence of 4096.

    Null and empty texts are one end token; repeated rows are documents of their own. No documents give none. Other columns are not read.
    """
    return packing.packed(docs, tokenizer_path(), capacity=4096)


STAGES = [
    ("quality filter", quality_filter),
    ("near duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
    ("packed sequences", packed_sequences),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
