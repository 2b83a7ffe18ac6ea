"""Fixed schemas of the record, profile, change, count and reconcile rows."""

from pyspark.sql import types as T

# JSON shape of one input line (user_id is text in the input).
RAW_RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("timestamp", T.LongType()),
])

# Canonical record after parsing: user_id is an integer, position is the
# byte offset just after the record's line in the input.
RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("timestamp", T.LongType()),
    T.StructField("position", T.LongType()),
])

RECORD_COLUMNS = [f.name for f in RECORD.fields]

PROFILE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("events", T.MapType(T.StringType(), T.LongType())),
    T.StructField("last_updated", T.LongType()),
])

CHANGE = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("old_value", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("position", T.LongType()),
])

COUNTS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("n", T.LongType()),
])

RECONCILE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("actual", T.StringType()),
    T.StructField("status", T.StringType()),
])

# The four attribute columns of the reference's customer
# table, in its column order.
REFERENCE_FIELDS = ("email", "first_name", "last_name", "ip")
