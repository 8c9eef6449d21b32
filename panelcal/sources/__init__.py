"""Scans, sinks and integrity jobs over trajectory files and stored runs."""
