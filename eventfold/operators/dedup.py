"""A1 dedup by id and J5 insert-if-absent against stored history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_records(records: DataFrame, history: DataFrame | None = None,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """One row per ``id``; the copy with the smallest ``position`` wins.

    Planned as one sort aggregation keyed on ``id`` with a partial
    (map-side) step, so an id written many times is collapsed before the
    shuffle. ``columns`` names what the caller needs besides ``id`` and
    ``position``: only these are sorted and shuffled (all, if not given). ``history`` (any DataFrame with an ``id`` column) removes ids
    that were stored by an earlier batch (left anti join).
    """
    if columns is not None:
        records = records.select("id", *[c for c in columns if c not in ("id", "position")], "position")
    cols = records.columns
    others = [c for c in cols if c != "id"]
    # The whole row sits in one struct, so every consumer of the result
    # sees the same aggregate and Spark reuses its shuffle (no pruning of
    # struct fields happens through an aggregate).
    firsts = F.min_by(F.struct(*others), "position").alias("_r")
    out = (records.groupBy("id").agg(firsts)
           .select("id", *[F.col(f"_r.{c}").alias(c) for c in others])
           .select(*cols))
    if history is not None:
        out = out.join(history.select("id"), "id", "left_anti").select(*cols)
    return out
