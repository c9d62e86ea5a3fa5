"""Operators of a training-data pipeline: deduplication, mixing, quality, packing, formatting and scans.

Nothing outside this subpackage imports it; ``queries`` holds its registered
queries and their DuckDB statements.
"""
