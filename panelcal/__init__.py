"""Calibrated prediction intervals on panels of entity trajectories, as Spark jobs."""

__version__ = "0.1.0"
