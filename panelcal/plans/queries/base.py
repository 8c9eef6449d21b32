"""Inputs that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcal.operators import split
from panelcal.operators.features import temporal_features
from panelcal.plans import sql
from panelcal.plans.panels import events_panel, lineitem_panel
from panelcal.plans.workloads import Design, progress_predictor, scored_predictions
from panelcal.session import configure, stored

SEEDS = (13, 37)
ALPHAS = (0.10, 0.25)
PRIMARY = split.CONDITIONS[:1]
SOURCE_DOMAIN = "EUROPE"
DOMAINS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
EVENTS_DESIGN = Design(seeds=SEEDS, conditions=PRIMARY, alphas=ALPHAS, resamples=200, policy="infinite")
LINES_DESIGN = Design(seeds=SEEDS, conditions=PRIMARY, alphas=(0.25, 0.40), resamples=200, policy="infinite", domains=DOMAINS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_panel(configure(spark), sf_dir)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_panel(configure(spark), sf_dir)


def with_next(panel: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Keys, settings and the following cycle; no sensor features."""
    return temporal_features(panel, [], carry=carry, with_next=True)


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stored(with_next(stored(events(spark, sf_dir), "events")), "events-next")
    return scored_predictions(panel, EVENTS_DESIGN, progress_predictor(), name="events")


def line_predictions(spark: SparkSession, sf_dir: str, design: Design = LINES_DESIGN, **options) -> DataFrame:
    panel = stored(with_next(stored(lines(spark, sf_dir), "lines"), ("domain",)), "lines-next")
    return scored_predictions(panel, design, progress_predictor(), keep=["domain"], name="lines", **options)


def is_source():
    return F.col("domain") == SOURCE_DOMAIN


def event_ctes(*more: str) -> list[str]:
    return [sql.EVENTS, sql.roles("ev", SEEDS), sql.cuts("ev", PRIMARY), sql.predictions("ev"), *more]


def line_ctes(*more: str, train_where: str = "TRUE", target_where: str = "FALSE", conditions=PRIMARY, seeds=SEEDS) -> list[str]:
    return [
        sql.LINES,
        sql.roles("li", seeds),
        sql.cuts("li", conditions),
        sql.predictions("li", extra="domain", train_where=train_where, target_where=target_where),
        *more,
    ]
