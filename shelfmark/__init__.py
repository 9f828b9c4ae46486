"""Retrieval-corpus jobs on Spark DataFrames: ingest, search, governance, reports."""

__version__ = "0.1.0"
