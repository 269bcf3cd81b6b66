"""Versioned parquet tables and database targets."""
