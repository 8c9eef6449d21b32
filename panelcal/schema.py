"""Panel contracts. Names are checked on the plan (free); values by quality rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ENTITY = "entity_id"
CYCLE = "cycle"

# The trajectory file layout and the feature-name contract.
SETTINGS = tuple(f"op_setting_{i}" for i in range(1, 4))
SENSORS = tuple(f"sensor_{i}" for i in range(1, 22))
DERIVED_PATTERN = r"^sensor_(?:[1-9]|1[0-9]|2[01])_(?:delta_1|rolling_(?:mean|std|slope)_[1-9][0-9]*)$"

TRAJECTORY = T.StructType(
    [T.StructField(ENTITY, T.LongType()), T.StructField(CYCLE, T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in (*SETTINGS, *SENSORS)]
)
OUTCOME = T.StructType([T.StructField(ENTITY, T.LongType()), T.StructField("rul", T.LongType())])


class ContractError(ValueError):
    """A table does not have the columns or values its reader relies on."""


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {sorted(missing)}")


def check_feature_columns(df: DataFrame, features: Sequence[str]) -> None:
    """Model inputs: no identifier, only contract names, numeric types."""
    require(df, features)
    if not features:
        raise ContractError("no model features")
    if ENTITY in features:
        raise ContractError("the entity identifier cannot be a model feature")
    allowed = {CYCLE, "cycle_index", *SETTINGS, *SENSORS}
    odd = [c for c in features if c not in allowed and not re.match(DERIVED_PATTERN, c)]
    if odd:
        raise ContractError(f"features outside the contract: {sorted(odd)}")
    types = dict(df.dtypes)
    wrong = [c for c in features if types[c] not in ("double", "float", "bigint", "int")]
    if wrong:
        raise ContractError(f"features that are not numeric: {sorted(wrong)}")


def check_same_features(fitted: Sequence[str], given: Sequence[str]) -> None:
    """The columns at transform time are those of the fit."""
    missing, extra = set(fitted) - set(given), set(given) - set(fitted)
    if missing or extra:
        raise ContractError(f"columns of the fit that are missing here: {sorted(missing)}; columns here that the fit did not have: {sorted(extra)}")
