"""S1-S4 NDJSON record scan with positions, P2 user routing, P14 ids, S3 quarantine.

``read_records`` returns (valid, quarantine). A line is valid only if it is
exactly one JSON object whose fields have the record's types: id a string;
type, name and user_id strings or absent/null; timestamp an integer or
absent/null; data an object of string (or null) values, or absent/null.
The check parses ``{"r":<line>,"__end__":1}`` as a variant: text after the
object, a second object, a truncated or empty line all break the wrapper.
Duplicate keys are refused by the variant parser (quarantined).

``position`` is the byte offset just after the line, newline included, in
the concatenation of the input files in path order (for one file: the
offset in that file). Lines are read with ``lineSep="\\n"`` so a CR stays in
the value and is counted; it is stripped before parsing. Offsets come from
a prefix sum inside each file split (per partition, no shuffle) plus a base
per split, computed from per-split byte totals (one row per split).
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.functions.expr import atoi, canonical_uuid, is_uuid, normalise_event_name
from eventfold.schema import RAW_RECORD, RECORD_COLUMNS

# Functions of this module run inside Python workers (Arrow / state API);
# pickle them by value so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The split-base table is broadcast only when its estimated size (paths plus
# three longs per split) is at most this; beyond it the join shuffles.
BROADCAST_BYTES = 128 * 1024 * 1024

_STRINGY = ("STRING", "VOID")
_INTEGER = ("TINYINT", "SMALLINT", "INT", "BIGINT")
_FIELDS = ("id", "type", "name", "user_id", "timestamp", "data")


def _optional(kind: Column, allowed) -> Column:
    return kind.isNull() | kind.isin(*allowed)


def checked_lines(lines: DataFrame) -> DataFrame:
    """Adds the record fields read from one variant parse, and ``reason``
    (NULL when the line is a well-typed record).

    The steps are separate projections over materialised columns: each
    line is parsed once, and no CASE branch re-parses it. A filter on ``reason``
    would be moved below them, with a copy of the parse for each of its
    branches; it stays above, as ``reason`` has a random part (never taken).
    """
    wrapped = F.concat(F.lit('{"r":'), F.col("value"), F.lit(',"__end__":1}'))
    step1 = lines.withColumn("w_", F.try_parse_json(wrapped))
    step2 = step1.select(
        "*",
        F.size(F.try_variant_get("w_", "$", "map<string,variant>")).alias("nkeys_"),
        F.try_variant_get("w_", "$.__end__", "int").alias("end_"),
        F.variant_get("w_", "$.r", "variant").alias("r_"))
    kinds = [F.schema_of_variant(F.variant_get("r_", f"$.{f}", "variant")).alias(f"k_{f}")
             for f in _FIELDS]
    step3 = step2.select("*", F.schema_of_variant("r_").alias("k_r"), *kinds,
                         F.try_variant_get("r_", "$.data", "map<string,variant>").alias("m_"))
    data_ok = (F.col("k_data").isNull() | (F.col("k_data") == "VOID")
               | (F.col("k_data").startswith("OBJECT")
                  & F.forall(F.map_values("m_"), lambda x: F.schema_of_variant(x).isin(*_STRINGY))))
    reason = (F.when(F.col("w_").isNull() | (F.col("nkeys_") != 2) | ~F.col("end_").eqNullSafe(F.lit(1)),
                     F.lit("not one JSON object"))
              .when(~F.col("k_r").startswith("OBJECT"), F.lit("not a JSON object"))
              .when(F.coalesce(F.col("k_id"), F.lit("")) != "STRING", F.lit("id missing or not a string"))
              .when(~_optional(F.col("k_type"), _STRINGY), F.lit("type is not a string"))
              .when(~_optional(F.col("k_name"), _STRINGY), F.lit("name is not a string"))
              .when(~_optional(F.col("k_user_id"), _STRINGY), F.lit("user_id is not a string"))
              .when(~_optional(F.col("k_timestamp"), _INTEGER + ("VOID",)),
                    F.lit("timestamp is not an integer"))
              .when(~data_ok, F.lit("data is not an object of strings")))
    step4 = step3.select(
        "*", F.when(F.rand(0) + 1 < 0, F.lit("")).otherwise(reason).alias("reason"),
        F.try_variant_get("r_", "$.id", "string").alias("f_id"),
        F.try_variant_get("r_", "$.type", "string").alias("f_type"),
        F.try_variant_get("r_", "$.name", "string").alias("f_name"),
        F.try_variant_get("r_", "$.user_id", "string").alias("f_user_id"),
        F.try_variant_get("r_", "$.timestamp", "bigint").alias("f_timestamp"),
        F.try_variant_get("r_", "$.data", "map<string,string>").alias("f_data"))
    keep = [c for c in lines.columns] + ["reason"] + [f"f_{f}" for f in _FIELDS]
    return step4.select(*keep)


#: File names that Spark's text reader uncompresses (fixed values).
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)\z"


def _prefix_bytes(batches):
    """Per partition, running byte count inside each (file, split) in read
    order, carried across Arrow batches. Works on Arrow arrays and numpy:
    the line text passes through without becoming Python objects."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    carry_key, carry = None, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            yield batch.append_column("_in_split", pa.array([], pa.int64()))
            continue
        nb = batch.column("_nbytes").to_numpy(zero_copy_only=False).astype(np.int64)
        blk = batch.column("_block").to_numpy(zero_copy_only=False)
        files = batch.column("_file")
        change = np.zeros(n, dtype=bool)
        change[0] = True
        if n > 1:
            same_file = pc.equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            change[1:] = (blk[1:] != blk[:-1]) | ~same_file
        cs = np.cumsum(nb)
        run = np.cumsum(change) - 1
        out = cs - (cs - nb)[change][run]
        first_key = (files[0].as_py(), int(blk[0]))
        if first_key == carry_key:
            out[run == 0] += carry
        carry_key, carry = (files[n - 1].as_py(), int(blk[n - 1])), int(out[-1])
        yield batch.append_column("_in_split", pa.array(out, pa.int64()))


def lines_with_positions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, source, position, file_position) for every line, CR stripped from value.

    ``file_position`` is the end of the line in its own file, in bytes of text:
    for a compressed file, of the uncompressed text. ``position`` adds the text
    of all files before it in path order. A byte-order mark counts.
    """
    raw = (spark.read.option("lineSep", "\n").text(path)
           .select("value",
                   F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.col("_metadata.file_size").alias("_fsize"),
                   (F.octet_length("value") + 1).cast("bigint").alias("_nbytes")))
    schema = T.StructType(raw.schema.fields + [T.StructField("_in_split", T.LongType())])
    local = raw.mapInArrow(_prefix_bytes, schema)
    # One row per split. Both uses below have the same aggregate, so its
    # exchange is reused.
    splits = (raw.groupBy("_file", "_block")
              .agg(F.sum("_nbytes").alias("_split_bytes"), F.max("_fsize").alias("_fsize")))
    # Spark drops a byte-order mark and counts a newline after the last line; the
    # size of an uncompressed file shows both. That of a compressed one says nothing.
    # Base of a split = bytes of every earlier split of the same file;
    # file base = sizes of every earlier file in path order. The file list
    # is ordered in one window: it is one row per input file, the same
    # list the driver already holds to plan the scan, not the data.
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(F.max("_fsize").alias("_fsize"), F.sum("_split_bytes").alias("_bytes"))
    packed = F.lower("_file").rlike(COMPRESSED)
    files = files.withColumn("_fsize", F.when(packed, F.col("_bytes")).otherwise(F.col("_fsize"))) \
        .withColumn("_mark", F.when(~packed & (F.col("_fsize") - F.col("_bytes")).between(2, 3), 3).otherwise(0))
    file_base = files.withColumn(
        "_file_base", F.coalesce(F.sum("_fsize").over(
            Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = (splits.withColumn("_split_base", F.coalesce(F.sum("_split_bytes").over(in_file), F.lit(0)))
             .drop("_fsize").join(file_base.select("_file", "_file_base", "_fsize", "_mark"), "_file")
             .select("_file", "_block", (F.col("_split_base") + F.col("_mark")).alias("_split_base"), "_file_base", "_fsize"))
    # splits are bounded by the scan's plan: a file makes one for each partition's bytes, and one more
    files_ = raw.inputFiles()
    each = max(1, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if (size // each + 8 * len(files_) + 8) * (max(map(len, files_), default=0) + 64) <= BROADCAST_BYTES:
        bases = F.broadcast(bases)
    out = local.drop("_fsize").join(bases, ["_file", "_block"])
    # A last line without a newline is one byte shorter than counted.
    in_file_pos = F.least(F.col("_split_base") + F.col("_in_split"), F.col("_fsize"))
    return out.select(F.regexp_replace("value", "\r$", "").alias("value"),
                      F.col("_file").alias("source"),
                      (F.col("_file_base") + in_file_pos).alias("position"),
                      in_file_pos.alias("file_position"))


def reached(lines: DataFrame) -> DataFrame:
    """(source, offset): how far each file has been read, to resume from."""
    return lines.groupBy("source").agg(F.max("file_position").alias("offset"))


def raw_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines -> (records, quarantine) before user routing: ids and user_id are
    the text of the input, whatever they hold."""
    extra = [c for c in ("source", "position") if c in lines.columns]
    checked = checked_lines(lines)
    raw = checked.filter(F.col("reason").isNull()).select(*[F.col(f"f_{f}").alias(f) for f in RAW_RECORD.fieldNames()], *extra)
    return raw, checked.filter(F.col("reason").isNotNull()).select("value", *extra, "reason")


def parse_lines(lines: DataFrame, require_uuid: bool = False,
                canonical_ids: bool = False, normalise_names: bool = False
                ) -> tuple[DataFrame, DataFrame]:
    """lines(value, [source], [position]) -> (records, quarantine(value, ..., reason)).

    ``normalise_names`` lower-cases event names and removes spaces (F17).
    """
    return split_decoded(decode_lines(lines, require_uuid, canonical_ids, normalise_names))


def decode_lines(lines: DataFrame, require_uuid: bool = False, canonical_ids: bool = False,
                 normalise_names: bool = False) -> DataFrame:
    """Every line decoded once: the record's columns, ``reason`` (NULL for a
    valid record), and the text of the line where it is not valid. Written, it
    serves records, quarantine and counts without parsing again."""
    extra = [c for c in ("source", "position", "file_position") if c in lines.columns]
    checked = checked_lines(lines)
    uid = F.col("f_user_id")
    uid_num = atoi(uid)
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when(uid.isNotNull() & (uid != "") & uid_num.isNull(),
                    F.lit("user_id is not an integer")))
    if require_uuid:
        reason = reason.when(~is_uuid(F.col("f_id")), F.lit("id is not a UUID"))
    rid = canonical_uuid(F.col("f_id")) if canonical_ids else F.col("f_id")
    return checked.withColumn("reason", reason).select(
        "reason", F.when(F.col("reason").isNotNull(), F.col("value")).alias("value"),
        rid.alias("id"), F.col("f_type").alias("type"),
        (normalise_event_name("f_name") if normalise_names else F.col("f_name")).alias("name"),
        uid_num.alias("user_id"), F.col("f_data").alias("data"), F.col("f_timestamp").alias("timestamp"),
        *([F.col("position")] if "position" in extra else [F.lit(None).cast("bigint").alias("position")]),
        *[F.col(c) for c in extra if c != "position"])


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of decoded lines."""
    extra = [c for c in ("source",) if c in decoded.columns]
    valid = decoded.filter(F.col("reason").isNull()).select(*RECORD_COLUMNS, *extra)
    quarantine = decoded.filter(F.col("reason").isNotNull()).select("value", *extra, "position", "reason")
    return valid, quarantine


def read_records(spark: SparkSession, path: str | list[str], start: int | DataFrame = 0,
                 require_uuid: bool = False, canonical_ids: bool = False,
                 normalise_names: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantine) from NDJSON files.

    ``start`` resumes (S4): with a frame (source, offset), as ``reached``
    makes, each file's lines that end beyond its own offset are read, and files
    without one are read whole, wherever they stand in path order. A number is
    an offset into all files in path order; it suits one file.
    """
    lines = lines_with_positions(spark, path)
    if isinstance(start, DataFrame):
        lines = lines.join(start.select("source", F.col("offset").alias("_from")), "source", "left") \
            .filter(F.col("file_position") > F.coalesce("_from", F.lit(0))).drop("_from")
    elif start:
        lines = lines.filter(F.col("position") > F.lit(start))
    valid, quarantine = parse_lines(lines, require_uuid, canonical_ids, normalise_names)
    return valid.select(*RECORD_COLUMNS, "source"), quarantine


def records_to_ndjson(records: DataFrame) -> DataFrame:
    """The reverse of parsing: one JSON line per record (value), user_id as text."""
    body = F.struct("id", "type", "name", F.col("user_id").cast("string").alias("user_id"),
                    "data", "timestamp")
    return records.select(F.to_json(body).alias("value"))
