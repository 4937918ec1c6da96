"""Temporal event extraction and data-pipeline operators on Spark DataFrames."""
