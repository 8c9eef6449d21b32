"""The given tables as panels: entity, cycle, settings, sensors and a domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcal.operators.ranks import grouped_position
from panelcal.schema import CYCLE, ENTITY

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")  # settings code, in this order
EVENT_SETTINGS = ("op_setting_1", "op_setting_2", "op_setting_3")
EVENT_SENSORS = ("sensor_1", "sensor_2", "sensor_3")
LINE_SENSORS = ("sensor_1", "sensor_2", "sensor_3", "sensor_4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(column: str, values: tuple[str, ...]):
    out = None
    for i, v in enumerate(values):
        out = F.when(F.col(column) == v, float(i)) if out is None else out.when(F.col(column) == v, float(i))
    return out.otherwise(-1.0)


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entities, their events in time order as cycles.

    Settings: hour, day of week, event type. Sensors: value, the JSON number, a constant (so
    the variance filter has something to drop).
    """
    raw = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    # A user's days bound the window of a very active user.
    ranked = grouped_position(raw, ["user_id"], ["ts", "event_id"], F.to_date("ts"), out=CYCLE)
    return ranked.select(
        (F.col("user_id") + 1).alias(ENTITY),
        F.col(CYCLE).cast("bigint").alias(CYCLE),
        F.hour("ts").cast("double").alias("op_setting_1"),
        (F.dayofweek("ts") - 1).cast("double").alias("op_setting_2"),
        _code("event_type", EVENT_TYPES).alias("op_setting_3"),
        F.col("value").cast("double").alias("sensor_1"),
        F.get_json_object("props", "$.k").cast("double").alias("sensor_2"),
        F.lit(1.0).alias("sensor_3"),
    )


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities, their shipped lines in date order as cycles, regions as domains."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    # Line keys repeat, so every column takes part in the order.
    order = [
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    ranked = grouped_position(lines, ["l_suppkey"], order, F.trunc("l_shipdate", "month"), out=CYCLE)
    domains = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("domain"))
    )
    return ranked.join(domains, "l_suppkey").select(
        "domain",
        (F.col("l_suppkey") + 1).alias(ENTITY),
        F.col(CYCLE).cast("bigint").alias(CYCLE),
        F.col("l_linenumber").cast("double").alias("op_setting_1"),
        _code("l_returnflag", ("A", "N", "R")).alias("op_setting_2"),
        _code("l_linestatus", ("F", "O")).alias("op_setting_3"),
        F.col("l_quantity").alias("sensor_1"),
        F.col("l_extendedprice").alias("sensor_2"),
        F.col("l_discount").alias("sensor_3"),
        F.col("l_tax").alias("sensor_4"),
    )
