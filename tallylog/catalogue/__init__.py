"""Queries over the driver tables, used for checks and benchmarks."""
