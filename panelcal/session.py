"""Session settings and the one place that decides where cut lineage is written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelcal.schema import ContractError

# Settings the library relies on. They are safe to set on a live session.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # 21 sensors x 10 derived columns is beyond the default of 100 fields.
    "spark.sql.codegen.maxFields": "400",
    # The JVM interprets methods beyond 8,000 bytes, as wide stages generate; at this limit Spark evaluates such a stage in small ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A union that reports its children's partitioning can meet a join whose other side was
    # re-planned to another partition count ("Can't zip RDDs"); a plain union cannot.
    "spark.sql.unionOutputPartitioning": "false",
    # The state store that keyed state of several variables needs.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and return the same session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir`` of the session.

    Without that setting a local master gets a temporary folder; on a cluster the executors would each
    write to their own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ContractError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-panelcal-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/panelcal/{name}-{uuid.uuid4().hex}"


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A declared table as a local relation: its size is known to the planner, and no Python
    worker is started to read it."""
    columns = [part.strip().split(" ", 1) for part in re.split(r",(?![^(]*\))", schema)]

    def literal(value: object, kind: str) -> str:
        if value is None:
            return f"cast(null as {kind})"
        text = "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else repr(value) if isinstance(value, float) else str(value)
        return f"cast({text}{'D' if isinstance(value, float) else ''} as {kind})"

    listed = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(row, columns, strict=True)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(n for n, _ in columns)})")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages read the same rows even after an executor is lost."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark).rstrip('/')}/panelcal/checkpoints")
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For tables that several branches of a plan read: the work above is done once, and the
    columnar copy keeps column pruning and filter pushdown, which a checkpoint does not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
