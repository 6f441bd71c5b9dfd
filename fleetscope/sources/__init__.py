"""Sources and sinks: driver tables, derived telemetry fixtures, ingest operators."""
