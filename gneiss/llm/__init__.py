"""Operators for preparing training data: packing, scans, dedup, formatting, scoring."""
