"""Sources and sinks: driver tables, stand-in views, CSV ingest, parquet/JSON sinks."""
