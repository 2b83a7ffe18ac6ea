"""eventfold: customer event records folded into customer profiles on Spark.

Batch and Structured Streaming DataFrame code. The names below are the
public API (SURVEY section 2.11); README.md maps every operator to them.
"""

from eventfold.operators.attributes import (
    attribute_assertions,
    attribute_state,
    attributes_map,
    last_updated,
    latest_attributes,
    row_last_arrival,
)
from eventfold.operators.changes import attribute_changes, changes_for, latest_change
from eventfold.operators.checks import erase, integrity, validate_new_customers
from eventfold.operators.dedup import dedup_records
from eventfold.operators.events import anonymous_counts, event_counts, events_map
from eventfold.operators.merge import fold, load_state, merge_state, save_state
from eventfold.operators.paging import list_profiles, list_reply_json, page_after, totals
from eventfold.operators.profiles import (
    customer_lookup,
    event_lookup,
    profile_json,
    profile_text,
    profile_wide,
    profiles,
)
from eventfold.operators.reconcile import reconcile, reconcile_long
from eventfold.session import get_spark, scale_conf, shared_dir
from eventfold.sources.records import read_records
from eventfold.sources.summary import read_summary, write_summary

dedup_events = dedup_records

__all__ = [
    "anonymous_counts", "attribute_assertions", "attribute_changes", "attribute_state",
    "attributes_map", "changes_for", "customer_lookup", "dedup_events", "dedup_records",
    "erase", "event_counts", "event_lookup", "events_map", "fold", "get_spark", "integrity",
    "last_updated", "latest_attributes", "latest_change", "list_profiles", "list_reply_json",
    "load_state", "merge_state", "page_after", "profile_json", "profile_text", "profile_wide",
    "profiles", "read_records", "read_summary", "reconcile", "reconcile_long", "row_last_arrival",
    "save_state", "scale_conf", "shared_dir", "totals", "validate_new_customers", "write_summary",
]
