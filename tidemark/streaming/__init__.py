"""Structured Streaming upsert."""
