"""Whole jobs: the staged run, the queries over the driver tables and their SQL oracles."""
