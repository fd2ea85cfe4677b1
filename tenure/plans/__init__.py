"""Composed plans: the reference's datasets and reports built from operators,
plus the registry of named queries (each with a DuckDB oracle where SQL can
express it)."""
