"""Tidemark: marker-driven table synchronisation and sync analytics on Spark DataFrames."""
