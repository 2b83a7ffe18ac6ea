"""Column expressions shared by the operators (all JVM-side built-ins)."""

from eventfold.functions.expr import (
    atoi,
    canonical_uuid,
    epoch_seconds,
    is_epoch_seconds,
    is_integer_text,
    is_uuid,
    kv_join,
    normalise_event_name,
    sorted_json,
    sorted_map,
)

__all__ = [
    "atoi",
    "canonical_uuid",
    "epoch_seconds",
    "is_epoch_seconds",
    "is_integer_text",
    "is_uuid",
    "kv_join",
    "normalise_event_name",
    "sorted_json",
    "sorted_map",
]
