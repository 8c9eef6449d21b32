"""Operators for preparing training data: sharding, scoring, packing, deduplication, mixing, privacy.

Nothing outside this subpackage imports it.
"""
