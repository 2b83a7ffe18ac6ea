from eventfold.schema import RECORD


def recs(spark, rows):
    """rows: (id, type, name, user_id, data, timestamp, position) tuples."""
    return spark.createDataFrame(rows, RECORD)


def attr(rid, user, data, ts, pos):
    return (rid, "attributes", None, user, data, ts, pos)


def event(rid, user, name, ts, pos, data=None):
    return (rid, "event", name, user, data or {}, ts, pos)


def rows_set(df, cols=None):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((v is not None, v) for v in t))
