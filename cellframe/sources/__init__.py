"""Readers and writers of annotated matrices, as Parquet."""
