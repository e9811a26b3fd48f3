"""Scans and sinks: Parquet/CSV/JSON tables, bulk light-curve files, driver-table adapters."""
