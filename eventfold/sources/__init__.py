"""Sources and sinks: NDJSON records, driver tables, summary text, fact and JSON sinks."""
