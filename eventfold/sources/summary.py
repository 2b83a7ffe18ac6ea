"""S5 expected-summary scan and S6 summary sink (T2 string order of ids).

Line format: ``<id>,<attr>=<value>,...,<event>=<count>,...`` with keys in
byte order inside each group; a customer without events ends in a comma.
Reading routes a field to the events when its value is an integer, except
``created_at``, which is always an attribute: the format cannot tell an
integer-valued attribute from a count, so such attributes read back as
events (documented limit). A key met twice for one customer and kind keeps
the later field, so an integer-valued attribute named like an event is
overwritten by that event's count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.functions.expr import atoi, is_integer_text, kv_join

# Fixed value: the one integer-valued attribute the summary reader knows.
INTEGER_ATTRIBUTE = "created_at"


def summary_lines(profile: DataFrame) -> DataFrame:
    """(id_text, line) from (id, attributes map, events map)."""
    attrs = kv_join(F.map_entries("attributes"))
    events = kv_join(F.map_entries("events"))
    id_text = F.col("id").cast("string")
    return profile.select(id_text.alias("id_text"),
                          F.concat_ws(",", id_text, attrs, events).alias("line"))


def write_summary(profile: DataFrame, path: str) -> None:
    """Lines sorted by id as text (1, 10, 100, 2): a range-partitioned sort,
    so part files are in order and no single task holds all lines."""
    (summary_lines(profile).orderBy("id_text").select("line")
     .write.mode("overwrite").text(path))


def parse_summary(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines(value) -> (ids(id), long(id, kind, key, value), quarantine(value, reason)).

    A line whose first field is not an integer, or with a non-empty field
    that does not split on '=' into exactly two parts, is quarantined whole.
    """
    fields = F.split(F.col("value"), ",", -1)
    first = fields.getItem(0)
    bad_field = F.exists(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(1))),
                         lambda f: (f != "") & (F.size(F.split(f, "=", -1)) != 2))
    checked = lines.select("value", atoi(first).alias("id"),
                           F.when(F.size(fields) > 1, bad_field).otherwise(F.lit(False)).alias("_bad"))
    reason = (F.when(F.col("id").isNull(), F.lit("id is not an integer"))
              .when(F.col("_bad"), F.lit("field is not key=value")))
    flagged = checked.withColumn("reason", reason)
    quarantine = flagged.filter(F.col("reason").isNotNull()).select("value", "reason")
    good = flagged.filter(F.col("reason").isNull())
    ids = good.select("id")
    kind = lambda k, v: (F.when(k == INTEGER_ATTRIBUTE, F.lit("attribute"))
                         .when(is_integer_text(v), F.lit("event"))
                         .otherwise(F.lit("attribute")))
    def part(f, i):
        return F.try_element_at(F.split(f, "=", -1), F.lit(i))

    pairs = F.transform(
        F.filter(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), lambda f: f != ""),
        lambda f: F.struct(kind(part(f, 1), part(f, 2)).alias("kind"),
                           part(f, 1).alias("key"), part(f, 2).alias("value")))
    # A key given twice on one line keeps its last value (later fields
    # overwrite earlier ones); the line is a whole customer, so this
    # needs no shuffle. Fields are sorted by kind, key and place on the line,
    # and each is compared with the one after it.
    placed = F.array_sort(F.transform(pairs, lambda e, i: F.struct(e["kind"].alias("kind"), e["key"].alias("key"), i.alias("place"), e["value"].alias("value"))))
    # explode of one array: the sorted fields are made once, not in each use
    line = good.select("id", F.explode(F.array(placed)).alias("_p"))
    following = F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1)))
    last = F.zip_with("_p", following, lambda e, o: F.when(o.isNull() | (o["kind"] != e["kind"]) | (o["key"] != e["key"]), e))
    long = line.select("id", F.inline(last)).where(F.col("kind").isNotNull()).select("id", "kind", "key", "value")
    return ids, long, quarantine


def summary_long(profile: DataFrame) -> DataFrame:
    """(id, kind, key, value) of profiles, with kinds as the summary format reads
    them; an event overwrites an attribute of the same kind and key."""
    entries = profile.select("id", F.lit(0).alias("_o"), F.explode("attributes").alias("key", "value")).union(
        profile.select("id", F.lit(1), F.explode("events").alias("key", "value")).withColumn("value", F.col("value").cast("string")))
    kind = F.when((F.col("key") != INTEGER_ATTRIBUTE) & is_integer_text("value"), F.lit("event")).otherwise(F.lit("attribute"))
    return entries.filter(F.col("value").isNotNull()).groupBy("id", kind.alias("kind"), "key").agg(F.max_by("value", "_o").alias("value"))


def read_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_summary(spark.read.text(path))


def summary_profiles(ids: DataFrame, long: DataFrame) -> DataFrame:
    """(id, attributes map, events map) from parsed summary parts. An id on
    several lines has their entries merged; a key present on more than one
    of them keeps the greatest value (line order is not kept)."""
    merged = long.groupBy("id", "kind", "key").agg(F.max("value").alias("value"))
    attrs = (merged.filter(F.col("kind") == "attribute").groupBy("id")
             .agg(F.map_from_entries(F.array_sort(F.collect_list(
                 F.struct("key", "value")))).alias("attributes")))
    events = (merged.filter(F.col("kind") == "event").groupBy("id")
              .agg(F.map_from_entries(F.array_sort(F.collect_list(
                  F.struct("key", atoi("value").alias("value"))))).alias("events")))
    return (ids.distinct().join(attrs, "id", "left").join(events, "id", "left")
            .select("id",
                    F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
                    F.coalesce("events", F.create_map().cast("map<string,bigint>")).alias("events")))
