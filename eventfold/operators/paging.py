"""T3 pagination and A9 totals over a profile DataFrame.

``list_profiles`` mirrors the list reply: page rows plus a one-row meta
frame. Offset paging reads (page * per_page) rows per partition at most;
for deep paging use ``page_after`` (keyset: a filter on the sort key,
pushed down, then a top-k), which costs the same for every page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.operators.events import event_records
from eventfold.operators.profiles import profiles_of

# Reply defaults for page and page size.
DEFAULT_PAGE = 1
DEFAULT_PER_PAGE = 25


def _positive(v, default: int) -> int:
    try:
        v = int(v)
    except (TypeError, ValueError):
        return default
    return v if v > 0 else default


def page_params(page=None, per_page=None) -> tuple[int, int]:
    """Values that are missing, not integers or <= 0 fall back to the defaults."""
    return _positive(page, DEFAULT_PAGE), _positive(per_page, DEFAULT_PER_PAGE)


def list_profiles(profile: DataFrame, page=None, per_page=None,
                  order_by: str = "id") -> tuple[DataFrame, DataFrame]:
    """(page rows ordered by ``order_by``, meta(page, per_page, total)).

    An empty page reports page 1, as the list reply does.
    """
    page, per_page = page_params(page, per_page)
    skip = (page - 1) * per_page
    rows = profile.orderBy(order_by).offset(skip).limit(per_page)
    # The page is empty exactly when the offset reaches the total.
    meta = (profile.agg(F.count(F.lit(1)).alias("total"))
            .select(F.when(F.col("total") <= skip, F.lit(1)).otherwise(F.lit(page)).alias("page"),
                    F.lit(per_page).alias("per_page"), F.col("total")))
    return rows, meta


def page_after(profile: DataFrame, last_key=None, per_page=None,
               order_by: str = "id") -> DataFrame:
    """Keyset page: the next ``per_page`` rows after ``last_key``."""
    _, per_page = page_params(None, per_page)
    src = profile if last_key is None else profile.filter(F.col(order_by) > F.lit(last_key))
    return src.orderBy(order_by).limit(per_page)


def totals(profile: DataFrame) -> DataFrame:
    """Number of customers and of their events, one row."""
    return profile.agg(F.count(F.lit(1)).alias("customers"),
                       F.coalesce(F.sum("n_events"), F.lit(0)).cast("bigint").alias("events"))


def record_totals(records: DataFrame) -> DataFrame:
    """A9/A11 from raw records in one pass: (customers, customer_events,
    records, unique_records, anonymous_events), one row.

    Copies of an id meet once (R1: the first one's type and user count), then
    one row a user is left, and then one. Only type, user and position are
    shuffled; every step combines before its shuffle.
    """
    first = records.groupBy("id").agg(F.min_by(F.struct("type", "user_id"), "position").alias("_r"), F.count(F.lit(1)).alias("_copies"))
    user, kind = F.col("_r.user_id"), F.col("_r.type")
    by_user = first.groupBy(user.alias("user_id")).agg(
        F.coalesce(F.max(kind == "attributes"), F.lit(False)).alias("_customer"), F.count_if(kind == "event").alias("_events"),
        F.count(F.lit(1)).alias("_unique"), F.sum("_copies").alias("_records"))
    named = F.col("user_id").isNotNull()
    total = lambda column, where=F.lit(True): F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0)).cast("bigint")
    return by_user.agg(F.count_if(named & F.col("_customer")).alias("customers"),
                       total("_events", named & F.col("_customer")).alias("customer_events"),
                       total("_records").alias("records"), total("_unique").alias("unique_records"),
                       total("_events", ~named).alias("anonymous_events"))


def list_reply_json(profile_json: DataFrame, page=None, per_page=None) -> DataFrame:
    """S8 list reply as one JSON text row:
    ``{"customers":[<profile>,...],"meta":{"page":..,"per_page":..,"total":..}}``.

    ``profile_json`` is (id, json) per customer (``profile_json``). The
    page's rows (at most ``per_page``) and the one-row meta are unioned and
    folded by one tiny aggregation, so no join pairs them up.
    """
    rows, meta = list_profiles(profile_json, page, per_page)
    parts = (rows.select(F.col("id"), F.col("json"), F.lit(None).cast("string").alias("meta"))
             .unionByName(meta.select(F.lit(None).cast("bigint").alias("id"),
                                      F.lit(None).cast("string").alias("json"),
                                      F.to_json(F.struct("page", "per_page", "total")).alias("meta"))))
    folded = parts.agg(
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "json")))).alias("_c"),
        F.max("meta").alias("_m"))
    customers = F.array_join(F.transform("_c", lambda c: c["json"]), ",")
    return folded.select(F.concat(F.lit('{"customers":['), customers, F.lit('],"meta":'),
                                  F.col("_m"), F.lit("}")).alias("json"))


def write_page_index(ids: DataFrame, path: str, per_file: int = 1_000_000) -> DataFrame:
    """T3 index over unique ``id``s: files of id ranges under ``path``/ids, and
    (file, n, before) of each under ``path``/files. A page is then one or two
    files, found by the running counts, whatever its number; no page reads or
    folds the rest. Built once for a set of customers."""
    spark = ids.sparkSession
    ranged = ids.select("id").where("id is not null")
    n = max(1, -(-ranged.count() // per_file))
    ranged.repartitionByRange(n, "id").sortWithinPartitions("id").write.mode("error").parquet(f"{path}/ids")
    files = (spark.read.schema("id bigint").parquet(f"{path}/ids")
             .groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_first")))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files.select("file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.mode("error").parquet(f"{path}/files")
    return spark.read.parquet(f"{path}/files")


def page_ids(spark: SparkSession, path: str, page=None, per_page=None) -> tuple[DataFrame, dict]:
    """(ids of a page, meta): only the files that hold the page are read."""
    page, per_page = page_params(page, per_page)
    files = spark.read.schema("file string, n bigint, before bigint").parquet(f"{path}/files")
    total = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    skip = (page - 1) * per_page
    held = files.where((F.col("before") < skip + per_page) & (F.col("before") + F.col("n") > skip)).orderBy("before").collect()
    meta = {"page": 1 if total <= skip else page, "per_page": per_page, "total": total}
    if not held:
        return spark.createDataFrame([], "id bigint"), meta
    ids = spark.read.schema("id bigint").parquet(*[r["file"] for r in held])
    return ids.orderBy("id").offset(skip - held[0]["before"]).limit(per_page), meta


def indexed_page(records: DataFrame, path: str, page=None, per_page=None) -> DataFrame:
    """A page of profiles from deduplicated records: the page's ids come from the
    index, and only their records are folded."""
    return profiles_of(records, page_ids(records.sparkSession, path, page, per_page)[0])


def list_events(records: DataFrame, page=None, per_page=None) -> DataFrame:
    """A page of event records in order of arrival (then id)."""
    page, per_page = page_params(page, per_page)
    return event_records(records).orderBy("position", "id").offset((page - 1) * per_page).limit(per_page)


def events_after(records: DataFrame, position: int, per_page=None) -> DataFrame:
    """P8 by key: the next events after a position, at the same cost for any."""
    _, per_page = page_params(None, per_page)
    return event_records(records).where(F.col("position") > position).orderBy("position", "id").limit(per_page)
