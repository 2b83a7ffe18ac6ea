"""Structured Streaming forms of ingest: dedup, counts, attributes, changelog (ST1-ST6)."""

from eventfold.streaming.stream import (
    ChangeLogger,
    ProgressLog,
    Reports,
    events_stream,
    ndjson_stream,
    read_sink,
    run_available_now,
    start_stream,
    stream_attribute_changes,
    stream_dedup,
    stream_event_counts,
    stream_latest_attributes,
)

__all__ = [
    "ChangeLogger",
    "ProgressLog",
    "Reports",
    "events_stream",
    "ndjson_stream",
    "read_sink",
    "run_available_now",
    "start_stream",
    "stream_attribute_changes",
    "stream_dedup",
    "stream_event_counts",
    "stream_latest_attributes",
]
