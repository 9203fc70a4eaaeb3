"""Sources and sinks: CSV ingestion, gold tables, chart bundles."""
