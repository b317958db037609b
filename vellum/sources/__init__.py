"""Stored indexes: generations of Parquet tables under a registry."""
