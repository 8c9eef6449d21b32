"""Registered queries by area; importing this package fills the registry."""

from panelcal.plans.queries import audit, calibration, core, gates, learn, panel, report, streams  # noqa: F401
