"""Whitespace-separated trajectory and outcome files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcal.functions.expressions import is_finite
from panelcal.operators.ranks import grouped_position
from panelcal.schema import CYCLE, ENTITY, TRAJECTORY, ContractError

LOCATION = ("file", "block", "ordinal")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Non-blank lines with where they came from.

    ``block`` is the start of the file split a line was read in, and ``ordinal`` increases with
    the line order inside it, so (file, block, ordinal) is the order of the file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.text(paths)
        .select(
            F.trim("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("ordinal"),
        )
        .filter(F.length("line") > 0)
    )


def _typed(token: Column, field: T.StructField) -> Column:
    value = token.try_cast("double")
    if isinstance(field.dataType, T.LongType):
        whole = is_finite(value) & (value == F.floor(value))
        return F.when(whole, F.coalesce(token.try_cast("bigint"), value.cast("bigint")))
    return F.when(is_finite(value), value)


def parse_lines(lines: DataFrame, schema: T.StructType = TRAJECTORY) -> DataFrame:
    """Typed columns plus ``reject``: null for a good line, else the reason."""
    tokens = F.split("line", r"\s+")
    fields = schema.fields
    split = lines.withColumn("_t", tokens)
    typed = split.select(
        *[_typed(F.get(F.col("_t"), F.lit(i)), f).alias(f.name) for i, f in enumerate(fields)],
        F.size("_t").alias("_n"),
        *[c for c in lines.columns],
    )
    bad_value = F.lit(False)
    for f in fields:
        bad_value = bad_value | F.col(f.name).isNull()
    bad_key = F.lit(False)
    for f in fields:
        if isinstance(f.dataType, T.LongType) and f.name != "rul":
            bad_key = bad_key | (F.col(f.name) <= 0)
        elif f.name == "rul":
            bad_key = bad_key | (F.col(f.name) < 0)
    reason = (
        F.when(F.col("_n") != len(fields), "field count")
        .when(bad_value, "value is not a finite number of its type")
        .when(bad_key, "value out of range")
    )
    return typed.withColumn("reject", reason).drop("_n")


def scan_trajectories(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = TRAJECTORY,
    *,
    on_reject: str = "raise",
    location: bool = False,
) -> DataFrame:
    """Panel rows of headerless trajectory files.

    A line that breaks the layout fails the job that reads it (``raise``), is left out
    (``drop``), or is kept with its reason in ``reject`` (``keep``).
    """
    parsed = parse_lines(read_lines(spark, path), schema)
    names = [f.name for f in schema.fields]
    if on_reject == "keep":
        return parsed.select(*names, *LOCATION, "line", "reject")
    if on_reject == "raise":
        first = names[0]
        message = F.concat(F.lit("rejected line ("), F.col("reject"), F.lit("): "), F.col("line"))
        parsed = parsed.withColumn(first, F.when(F.col("reject").isNotNull(), F.raise_error(message)).otherwise(F.col(first)))
    elif on_reject == "drop":
        parsed = parsed.filter(F.col("reject").isNull())
    else:
        raise ContractError(f"unknown reject mode: {on_reject}")
    return parsed.select(*names, *(LOCATION if location else ()))


def scan_outcomes(spark: SparkSession, path: str | Sequence[str], *, on_reject: str = "raise") -> DataFrame:
    """Outcome files: line i of a file is the outcome of its entity i.

    Rows (file, entity_id, rul). Line numbers come from per-block counts, so a file of any
    length is numbered without passing through one task.
    """
    schema = T.StructType([T.StructField("rul", T.LongType())])
    parsed = parse_lines(read_lines(spark, path), schema)
    numbered = grouped_position(parsed, ["file"], ["ordinal"], F.col("block"), out=ENTITY)
    bad = F.col("reject").isNotNull()
    if on_reject == "keep":
        return numbered.select("file", ENTITY, "rul", "line", "reject")
    if on_reject != "raise":
        raise ContractError("dropping an outcome line would shift the entities after it")
    message = F.concat(F.lit("rejected outcome ("), F.col("reject"), F.lit("): "), F.col("line"))
    return numbered.select("file", ENTITY, F.when(bad, F.raise_error(message)).otherwise(F.col("rul")).alias("rul"))


def align_outcomes(panel: DataFrame, outcomes: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Outcome per entity of the panel, with ``alignment``: matched, no outcome, or no entity."""
    keys = [*by, ENTITY]
    entities = panel.select(*keys).distinct().withColumn("_p", F.lit(True))
    both = entities.join(outcomes.select(*keys, "rul").withColumn("_o", F.lit(True)), keys, "full_outer")
    state = (
        F.when(F.col("_p") & F.col("_o"), "matched").when(F.col("_p"), "no outcome").otherwise("no entity")
    )
    return both.select(*keys, "rul", state.alias("alignment"))


def write_trajectories(panel: DataFrame, path: str, columns: Sequence[str], *, by: Sequence[str] = ()) -> None:
    """Panel as headerless text, sorted by entity and cycle inside each file.

    Doubles print in their shortest exact form, so a scan reads back the same bits.
    """
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in (ENTITY, CYCLE, *columns)])
    placed = panel.repartition(*by, ENTITY).sortWithinPartitions(*by, ENTITY, CYCLE)
    writer = placed.select(*by, line.alias("value")).write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).text(path)


def profile(panel: DataFrame, sensors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, entities, cycle range, constant sensors and missing values, in one aggregate."""
    missing = None
    for c in panel.columns:
        if c not in by:
            part = F.sum(F.col(c).isNull().cast("bigint"))
            missing = part if missing is None else missing + part
    constant = F.array_compact(
        F.array(*[F.when(F.min(s).eqNullSafe(F.max(s)) & ((F.count(s) == F.count(F.lit(1))) | (F.count(s) == 0)), F.lit(s)) for s in sensors])
    )
    return panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(ENTITY).alias("entities"),
        F.min(CYCLE).alias("cycle_min"),
        F.max(CYCLE).alias("cycle_max"),
        F.concat_ws("|", F.array_sort(constant)).alias("constant_sensors"),
        missing.alias("missing_values"),
    )
