"""Sinks and scans of stored run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcal.operators.quality import one_row_per_entity
from panelcal.schema import ENTITY, ContractError, require

RUN_KEYS = ("experiment", "target", "seed")
PREDICTION_SCHEMA = (
    "experiment string, target string, condition string, seed int, model string, alpha double, entity_id bigint, "
    "y_true_raw double, y_true double, pred_raw double, pred double, lower double, upper double"
)


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = RUN_KEYS, fmt: str = "parquet") -> None:
    """Distributed write that refuses to replace an existing table."""
    require(df, partition_by)
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_run(tables: dict[str, DataFrame], root: str, *, partition_by: Sequence[str] = RUN_KEYS) -> None:
    """All tables of a run set below one root, one folder each."""
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", partition_by=[c for c in partition_by if c in df.columns])


def read_predictions(spark: SparkSession, path: str, *, fmt: str = "parquet", schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """Stored predictions under a declared schema; doubles come back bit for bit."""
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "FAILFAST")
    return reader.load(path)


def in_schema_order(predictions: DataFrame, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """Columns in the declared order, as positional formats (CSV) need them."""
    return predictions.select(*[part.split()[0] for part in schema.split(",")])


def check_predictions(predictions: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Not empty, and one row per entity and cell."""
    empty = predictions.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit("predictions not empty").alias("rule"), (F.col("_n") == 0).cast("bigint").alias("n_bad")
    )
    return empty.unionByName(one_row_per_entity(predictions, cell))


def write_assignment(assignment: DataFrame, path: str) -> None:
    """Split manifest: (seed, entity, role), one folder per seed."""
    require(assignment, ["seed", ENTITY, "role"])
    write_table(assignment, path, partition_by=["seed"])


def write_report(tables: dict[str, DataFrame], root: str, *, fmt: str = "csv") -> DataFrame:
    """Report tables plus their checksum table, which is returned and stored beside them."""
    from panelcal.sources.integrity import file_inventory

    if not tables:
        raise ContractError("no report tables")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", partition_by=[], fmt=fmt)
    sums = file_inventory(spark, [f"{root.rstrip('/')}/{n}" for n in tables], "part-*")
    write_table(sums, f"{root.rstrip('/')}/checksums", partition_by=[])
    return spark.read.parquet(f"{root.rstrip('/')}/checksums")
