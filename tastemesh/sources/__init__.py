"""Schemas, CSV and Parquet readers and writers, staged tables."""
