"""DuckDB SQL for every registered query, written independently of the Spark code.

Each string starts from the pre-registered driver views (``events``,
``customer``). ``RECORDS`` is the SQL form of the records adapter
(eventfold.sources.tables.records_from_events), in long form: attribute
records carry their (key, value) pair as ``akey`` / ``aval`` (and ``akey2`` /
``aval2``, a key that sorts behind), event records their data pair ('k', k);
``pairs`` has one row a pair.
"""

RECORDS = """
base AS (
  SELECT event_id, user_id, event_type,
         json_extract_string(props, '$.k') AS k,
         epoch_us(ts) // 1000000 AS tsec,
         CASE WHEN event_id % 500 = 499 THEN NULL
              WHEN event_id % 60 = 11 THEN user_id + 10000000
              ELSE user_id END AS event_user
  FROM events
),
recs AS (
  SELECT 'a-' || CAST(event_id AS VARCHAR) AS id, 'attributes' AS type,
         CAST(NULL AS VARCHAR) AS name, user_id, event_type AS akey, k AS aval,
         CASE WHEN event_id % 3 = 0 AND event_type IS NOT NULL THEN 'zone' END AS akey2,
         'zone-' || CAST(event_id % 11 AS VARCHAR) AS aval2,
         CASE WHEN event_id % 70 <> 3 THEN tsec END AS timestamp, event_id * 6 AS position
  FROM base
  UNION ALL
  SELECT 'e-' || CAST(event_id AS VARCHAR), 'event', event_type, event_user,
         'k', k, NULL, NULL, tsec, event_id * 6 + 1
  FROM base
  UNION ALL
  SELECT 'e-' || CAST(event_id AS VARCHAR), 'event', event_type, event_user,
         'k', k, NULL, NULL, tsec,
         (CASE WHEN event_id % 40 = 0 THEN event_id ELSE event_id + 1000 END) * 6 + 2
  FROM base WHERE event_id % 20 = 0
  UNION ALL
  SELECT 'd-' || CAST(event_id AS VARCHAR), 'attributes', NULL, user_id,
         event_type, 'old-' || k, NULL, NULL, tsec - 10000000, event_id * 6 + 3
  FROM base WHERE event_id % 10 = 3 AND event_type IS NOT NULL
  UNION ALL
  SELECT 'n-' || CAST(event_id AS VARCHAR), 'attributes', NULL,
         CASE WHEN event_id % 200 = 7 THEN user_id ELSE user_id + 30000000 END,
         'zone', NULL, NULL, NULL,
         CASE WHEN event_id % 200 = 7 THEN tsec + 1 END, event_id * 6 + 4
  FROM base WHERE event_id % 100 = 7
),
pairs AS (
  SELECT id, type, user_id, timestamp, position, akey, aval FROM recs
  UNION ALL
  SELECT id, type, user_id, timestamp, position, akey2, aval2 FROM recs WHERE akey2 IS NOT NULL
),
dedup AS (
  SELECT * FROM recs
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY position) = 1
),
assertions AS (
  SELECT user_id, akey AS key, aval AS value, COALESCE(timestamp, 0) AS timestamp, position
  FROM (SELECT * FROM pairs
        QUALIFY row_number() OVER (PARTITION BY id, akey ORDER BY position) = 1)
  WHERE type = 'attributes' AND user_id IS NOT NULL AND akey IS NOT NULL AND aval IS NOT NULL
),
latest AS (
  SELECT * FROM assertions
  QUALIFY row_number() OVER (PARTITION BY user_id, key
                             ORDER BY timestamp DESC, position DESC) = 1
),
counts AS (
  SELECT user_id, name, count(*) AS n
  FROM dedup WHERE type = 'event' AND user_id IS NOT NULL
  GROUP BY user_id, name
),
lu AS (
  SELECT user_id, max(COALESCE(timestamp, 0)) AS last_updated
  FROM dedup WHERE type = 'attributes' AND user_id IS NOT NULL
  GROUP BY user_id
),
attr_text AS (
  SELECT user_id, string_agg(key || '=' || value, ',' ORDER BY key) AS attributes
  FROM latest GROUP BY user_id
),
event_text AS (
  SELECT user_id,
         string_agg(COALESCE(name, '') || '=' || CAST(n AS VARCHAR), ',' ORDER BY COALESCE(name, '')) AS events,
         CAST(sum(n) AS BIGINT) AS n_events
  FROM counts GROUP BY user_id
),
r5 AS (
  SELECT lu.user_id AS id, COALESCE(a.attributes, '') AS attributes,
         COALESCE(e.events, '') AS events, COALESCE(e.n_events, 0) AS n_events,
         lu.last_updated AS last_updated
  FROM lu
  LEFT JOIN attr_text a ON a.user_id = lu.user_id
  LEFT JOIN event_text e ON e.user_id = lu.user_id
),
changes AS (
  SELECT user_id, key AS name, old_value, value, timestamp, position FROM (
    SELECT *, lag(value) OVER (PARTITION BY user_id, key ORDER BY position) AS old_value
    FROM assertions)
  WHERE old_value IS NULL OR old_value <> value
)
"""


def with_records(body: str, ctes: str = "") -> str:
    """``WITH <records adapter>[, <ctes>] <body>``."""
    extra = (",\n" + ctes.strip()) if ctes.strip() else ""
    return "WITH " + RECORDS.strip() + extra + "\n" + body.strip()


ORACLE: dict[str, str] = {}

ORACLE["customer_profile"] = with_records("""
SELECT c.c_custkey AS id,
       COALESCE(a.attributes, '') AS attributes,
       COALESCE(e.events, '') AS events,
       COALESCE(e.n_events, 0) AS n_events,
       lu.last_updated AS last_updated
FROM customer c
LEFT JOIN lu ON lu.user_id = c.c_custkey
LEFT JOIN attr_text a ON a.user_id = c.c_custkey
LEFT JOIN event_text e ON e.user_id = c.c_custkey
""")

ORACLE["record_profiles"] = with_records("SELECT * FROM r5")

DATA_JSON = """CASE WHEN akey IS NULL THEN '{}'
            WHEN aval IS NULL THEN '{"' || akey || '":null}'
            ELSE '{"' || akey || '":"' || aval || '"'
                 || CASE WHEN akey2 IS NULL THEN '' ELSE ',"' || akey2 || '":"' || aval2 || '"' END
                 || '}' END"""

ORACLE["dedup_events"] = with_records(f"""
SELECT id, type, name, user_id, timestamp, position, {DATA_JSON} AS data_json FROM dedup
""")

ORACLE["event_counts"] = with_records("SELECT user_id, name, n FROM counts")

ORACLE["anonymous_events"] = with_records("""
SELECT name, count(*) AS n FROM dedup
WHERE type = 'event' AND user_id IS NULL GROUP BY name
""")

ORACLE["latest_attributes"] = with_records(
    "SELECT user_id, key, value, timestamp, position FROM latest")
ORACLE["latest_attributes_ranked"] = ORACLE["latest_attributes"]

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

ORACLE["row_last_arrival"] = with_records(
    "SELECT user_id, "
    + ", ".join(f"COALESCE(CASE WHEN akey = '{t}' THEN aval END, '') AS {t}" for t in EVENT_TYPES)
    + """
FROM dedup WHERE type = 'attributes' AND user_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY position DESC) = 1
""")

ORACLE["profile_wide"] = with_records(
    "SELECT c.c_custkey AS id, "
    + ", ".join(f"COALESCE(w.{t}, '') AS {t}" for t in EVENT_TYPES)
    + """, COALESCE(e.n_events, 0) AS n_events
FROM customer c
LEFT JOIN (SELECT user_id, """
    + ", ".join(f"max(CASE WHEN key = '{t}' THEN value END) AS {t}" for t in EVENT_TYPES)
    + """ FROM latest GROUP BY user_id) w ON w.user_id = c.c_custkey
LEFT JOIN event_text e ON e.user_id = c.c_custkey
""")

ORACLE["attribute_changes"] = with_records("SELECT * FROM changes")

ORACLE["attribute_changes_event_time"] = with_records("""
SELECT user_id, key AS name, old_value, value, timestamp, position FROM (
  SELECT *, lag(value) OVER (PARTITION BY user_id, key ORDER BY timestamp, position) AS old_value
  FROM assertions)
WHERE old_value IS NULL OR old_value <> value
""")

ORACLE["customer_changes"] = with_records("""
SELECT * FROM changes WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)
""")

ORACLE["attribute_changes_balanced"] = ORACLE["attribute_changes_event_time"]

ORACLE["latest_change"] = with_records("""
SELECT user_id, name, old_value, value, timestamp, position FROM changes
QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY position DESC) = 1
""")

ORACLE["profile_page"] = with_records("""
SELECT id, attributes, events, n_events FROM r5 ORDER BY id LIMIT 25 OFFSET 50
""")

ORACLE["profile_page_meta"] = with_records("""
SELECT CASE WHEN count(*) <= 50 THEN 1 ELSE 3 END AS page, 25 AS per_page, count(*) AS total
FROM r5
""")

ORACLE["profile_page_after"] = with_records("""
SELECT id, attributes, events, n_events FROM r5 WHERE id > 50 ORDER BY id LIMIT 25
""")

ORACLE["totals"] = with_records("""
SELECT 'customers' AS metric, CAST(count(*) AS BIGINT) AS value FROM r5
UNION ALL SELECT 'customer_events', CAST(COALESCE(sum(n_events), 0) AS BIGINT) FROM r5
UNION ALL SELECT 'records', CAST(count(*) AS BIGINT) FROM recs
UNION ALL SELECT 'unique_records', CAST(count(*) AS BIGINT) FROM dedup
UNION ALL SELECT 'anonymous_events', CAST(count(*) AS BIGINT) FROM dedup
          WHERE type = 'event' AND user_id IS NULL
""")

ORACLE["last_updated"] = with_records("SELECT user_id, last_updated FROM lu")

ORACLE["orphan_events"] = with_records("""
SELECT id, user_id, name FROM dedup d
WHERE type = 'event' AND user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = d.user_id)
""")

ORACLE["key_uniqueness"] = with_records("""
SELECT 'records' AS tbl, id AS key, count(*) AS n FROM recs GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT 'customer', CAST(c_custkey AS VARCHAR), count(*) FROM customer
GROUP BY c_custkey HAVING count(*) > 1
""")

ORACLE["valid_customers"] = """
WITH req AS (
  SELECT c_custkey AS id,
         CASE WHEN c_acctbal >= 0
              THEN lower(replace(c_name, '#', '.')) || '@example.com' ELSE '' END AS email,
         CAST(c_custkey * 100003 AS VARCHAR) AS created
  FROM customer
), chk AS (
  SELECT *, email IS NOT NULL AND email <> '' AS ok,
         regexp_matches(created, '^[+-]?[0-9]+$')
           AND TRY_CAST(created AS BIGINT) > 99999999
           AND TRY_CAST(created AS BIGINT) < 10000000000 AS is_ts
  FROM req
)
SELECT id,
       CASE WHEN ok THEN 'valid' ELSE 'rejected' END AS status,
       CASE WHEN ok THEN NULL ELSE 'email attribute is required' END AS reason,
       CASE WHEN ok THEN email END AS email,
       CASE WHEN ok THEN (CASE WHEN is_ts THEN created ELSE '1700000000' END) END AS created_at
FROM chk
"""

ORACLE["customer_upserts"] = with_records("""
SELECT user_id, key, value, timestamp FROM (
  SELECT user_id, key, value, timestamp, position FROM assertions
  UNION ALL
  SELECT id, 'email', email, 1700000000, id FROM req WHERE ok
  UNION ALL
  SELECT id, 'created_at', CASE WHEN is_ts THEN created ELSE '1700000000' END, 1700000000, id
  FROM req WHERE ok
)
QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY timestamp DESC, position DESC) = 1
""", ctes="""
req0 AS (
  SELECT c_custkey AS id,
         CASE WHEN c_acctbal >= 0
              THEN lower(replace(c_name, '#', '.')) || '@example.com' ELSE '' END AS email,
         CAST(c_custkey * 100003 AS VARCHAR) AS created
  FROM customer
),
req AS (
  SELECT *, email IS NOT NULL AND email <> '' AS ok,
         regexp_matches(created, '^[+-]?[0-9]+$')
           AND TRY_CAST(created AS BIGINT) > 99999999
           AND TRY_CAST(created AS BIGINT) < 10000000000 AS is_ts
  FROM req0
)
""")

ORACLE["erase"] = with_records("""
SELECT user_id, name, n FROM counts k
WHERE NOT EXISTS (SELECT 1 FROM customer c
                  WHERE c.c_mktsegment = 'AUTOMOBILE' AND c.c_custkey = k.user_id)
""")

ORACLE["summary_lines"] = with_records("""
SELECT CAST(id AS VARCHAR) AS id_text,
       CAST(id AS VARCHAR) || ',' || attributes || ',' || events AS line
FROM r5
""")

PROFILE_JSON = """
pj AS (
  SELECT l.user_id AS id,
         '{"id":' || CAST(l.user_id AS VARCHAR)
         || ',"attributes":{' || COALESCE(a.j, '') || '}'
         || ',"events":{' || COALESCE(e.j, '') || '}'
         || ',"last_updated":' || CAST(COALESCE(l.last_updated, 0) AS VARCHAR) || '}' AS json
  FROM lu l
  LEFT JOIN (SELECT user_id, string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) AS j
             FROM latest GROUP BY user_id) a ON a.user_id = l.user_id
  LEFT JOIN (SELECT user_id, string_agg('"' || COALESCE(name, '') || '":' || CAST(n AS VARCHAR), ','
                                        ORDER BY COALESCE(name, '')) AS j
             FROM counts GROUP BY user_id) e ON e.user_id = l.user_id
)
"""

ORACLE["profile_json"] = with_records("SELECT id, json FROM pj", ctes=PROFILE_JSON)

ORACLE["profile_page_json"] = with_records("""
SELECT '{"customers":[' || COALESCE(string_agg(json, ',' ORDER BY id), '') || '],"meta":'
       || '{"page":' || CASE WHEN (SELECT count(*) FROM pj) <= 50 THEN 1 ELSE 3 END
       || ',"per_page":25,"total":' || CAST((SELECT count(*) FROM pj) AS VARCHAR) || '}}' AS json
FROM (SELECT * FROM pj ORDER BY id LIMIT 25 OFFSET 50) page
""", ctes=PROFILE_JSON)

ORACLE["customer_lookup"] = with_records("""
SELECT * FROM r5 WHERE id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)
""")

ORACLE["event_lookup"] = with_records("""
SELECT id, type, name, user_id, timestamp FROM dedup
WHERE id IN (SELECT id FROM recs GROUP BY id HAVING count(*) > 1)
""")

ORACLE["summary_roundtrip"] = with_records("""
SELECT id, kind, key, value FROM (
  SELECT user_id AS id,
         CASE WHEN key = 'created_at' THEN 'attribute'
              WHEN regexp_matches(value, '^[+-]?[0-9]+$') THEN 'event'
              ELSE 'attribute' END AS kind,
         key, value, 1 AS field_group
  FROM latest WHERE user_id IN (SELECT user_id FROM lu)
  UNION ALL
  SELECT user_id, 'event', COALESCE(name, ''), CAST(n AS VARCHAR), 2 FROM counts
  WHERE user_id IN (SELECT user_id FROM lu)
)
-- attributes are written before events on a line; a later field with the
-- same kind and key overwrites an earlier one
QUALIFY row_number() OVER (PARTITION BY id, kind, key ORDER BY field_group DESC) = 1
""")

RECONCILE = """
SELECT COALESCE(x.id, y.id) AS id, COALESCE(x.kind, y.kind) AS kind, COALESCE(x.key, y.key) AS key,
       x.value AS expected, y.value AS actual,
       CASE WHEN y.value IS NULL THEN 'missing_key'
            WHEN x.value IS NULL THEN 'extra_key' ELSE 'mismatch' END AS status
FROM exp_long x FULL OUTER JOIN act_long y
  ON x.id = y.id AND x.kind = y.kind AND x.key = y.key
WHERE x.value IS DISTINCT FROM y.value
  AND COALESCE(x.id, y.id) IN (SELECT id FROM exp_ids INTERSECT SELECT id FROM act_ids)
UNION ALL
SELECT COALESCE(e.id, a.id), 'customer', NULL, NULL, NULL,
       CASE WHEN a.id IS NULL THEN 'missing_customer' ELSE 'extra_customer' END
FROM exp_ids e FULL OUTER JOIN act_ids a ON e.id = a.id
WHERE e.id IS NULL OR a.id IS NULL
"""

RECONCILE_CTES = """
obs_attr AS (
  SELECT user_id, akey AS key, aval AS value FROM pairs
  WHERE type = 'attributes' AND user_id IS NOT NULL AND akey IS NOT NULL AND aval IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, akey ORDER BY position DESC) = 1
),
act_ids AS (SELECT DISTINCT user_id AS id FROM recs WHERE type = 'attributes' AND user_id IS NOT NULL),
obs_events AS (
  SELECT COALESCE(user_id, 0) AS user_id, COALESCE(name, '') AS key, count(*) AS n
  FROM recs WHERE type = 'event' GROUP BY 1, 2
),
act_long AS (
  SELECT user_id AS id, 'attribute' AS kind, key, value FROM obs_attr
  UNION ALL
  SELECT user_id, 'event', key, CAST(n AS VARCHAR) FROM obs_events
  WHERE user_id IN (SELECT id FROM act_ids)
),
exp_ids AS (SELECT user_id AS id FROM lu),
exp_long AS (
  SELECT user_id AS id, 'attribute' AS kind, key, value FROM latest
  WHERE user_id IN (SELECT id FROM exp_ids)
  UNION ALL
  SELECT user_id, 'event', COALESCE(name, ''), CAST(n AS VARCHAR) FROM counts
  WHERE user_id IN (SELECT id FROM exp_ids)
)
"""

ORACLE["reconcile_observed"] = with_records(RECONCILE, ctes=RECONCILE_CTES)

# Expected: every row of the customer table; actual: the observed records, in
# which one event name was changed on the way.
ORACLE["reconcile_customers"] = with_records(RECONCILE, ctes=RECONCILE_CTES.replace(
    "exp_ids AS (SELECT user_id AS id FROM lu)", "exp_ids AS (SELECT c_custkey AS id FROM customer)").replace(
    "COALESCE(name, '') AS key, count(*)", "CASE WHEN name = 'error' THEN 'fault' ELSE COALESCE(name, '') END AS key, count(*)"))

ORACLE["merged_attributes"] = ORACLE["latest_attributes"]
ORACLE["merged_event_counts"] = ORACLE["event_counts"]
ORACLE["merged_changes"] = ORACLE["attribute_changes"]

BAD_LINE = ("type = 'event' AND name = 'error' AND user_id IS NOT NULL "
            "AND TRY_CAST(aval AS INTEGER) >= 90")

ORACLE["ndjson_records"] = with_records(f"""
SELECT id, type, name, user_id, timestamp, {DATA_JSON} AS data_json
FROM recs WHERE NOT COALESCE({BAD_LINE}, false)
""")

ORACLE["ndjson_quarantine"] = with_records(f"""
SELECT id, CASE CAST(aval AS INTEGER)
             WHEN 91 THEN 'id missing or not a string'
             WHEN 92 THEN 'type is not a string'
             WHEN 93 THEN 'name is not a string'
             WHEN 94 THEN 'timestamp is not an integer'
             WHEN 95 THEN 'data is not an object of strings'
             WHEN 96 THEN 'not one JSON object'
             WHEN 97 THEN 'not a JSON object'
             ELSE 'user_id is not a string' END AS reason
FROM recs WHERE COALESCE({BAD_LINE}, false)
""")

ORACLE["stream_event_counts"] = ORACLE["event_counts"]
ORACLE["stream_latest_attributes"] = ORACLE["latest_attributes"]
ORACLE["stream_attribute_changes"] = ORACLE["attribute_changes"]
ORACLE["stream_dedup"] = with_records("SELECT id, type, name, user_id, timestamp FROM dedup")
# All copies arrive within the hour, and no record is dropped as too old.
ORACLE["stream_dedup_watermark"] = ORACLE["stream_dedup"]
for name in ("stream_event_counts", "stream_latest_attributes", "stream_attribute_changes",
             "stream_dedup", "stream_dedup_watermark"):
    ORACLE[f"{name}_batches"] = ORACLE[name]

ORACLE["ndjson_raw"] = with_records(f"""
SELECT id, type, name, CAST(user_id AS VARCHAR) AS user_id, timestamp, {DATA_JSON} AS data_json
FROM recs WHERE NOT COALESCE({BAD_LINE}, false)
""")

# The line of each record, and the bytes up to its end (newline included).
LINES = f"""
lines AS (
  SELECT id, position AS place,
         '{{"id":"' || id || '","type":"' || type || '"' || COALESCE(',"name":"' || name || '"', '')
         || COALESCE(',"user_id":"' || CAST(user_id AS VARCHAR) || '"', '') || ',"data":' || {DATA_JSON}
         || COALESCE(',"timestamp":' || CAST(timestamp AS VARCHAR), '') || '}}' AS line
  FROM recs
),
placed AS (
  SELECT id, CAST(sum(strlen(line) + 1) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position FROM lines
)
"""

ORACLE["ndjson_positions"] = with_records("SELECT id, position FROM placed", ctes=LINES)

ORACLE["ndjson_resume"] = with_records("""
SELECT id, position, CASE WHEN position <= (SELECT max(position) FROM placed) // 2 THEN 1 ELSE 2 END AS pass FROM placed
""", ctes=LINES)

ORACLE["uuid_records"] = with_records("""
SELECT id, uuid, position % 6 <> 5 AS valid, CASE WHEN position % 6 <> 5 THEN h ELSE uuid END AS canonical
FROM (SELECT *, CASE position % 6 WHEN 0 THEN plain WHEN 1 THEN upper(plain) WHEN 2 THEN '{' || plain || '}'
                     WHEN 3 THEN 'urn:uuid:' || plain WHEN 4 THEN h ELSE substr(plain, 1, 35) END AS uuid
      FROM (SELECT id, position, md5(id) AS h, substr(md5(id), 1, 8) || '-' || substr(md5(id), 9, 4) || '-' || substr(md5(id), 13, 4)
                   || '-' || substr(md5(id), 17, 4) || '-' || substr(md5(id), 21, 12) AS plain FROM dedup))
""")

ORACLE["normalised_event_counts"] = ORACLE["event_counts"]

ORACLE["event_page"] = with_records("""
SELECT id, name, user_id, timestamp, position FROM dedup WHERE type = 'event' ORDER BY position, id LIMIT 25 OFFSET 50
""")

ORACLE["events_after"] = with_records("""
SELECT id, name, user_id, timestamp, position FROM dedup WHERE type = 'event' AND position > 1000 ORDER BY position, id LIMIT 25
""")

ORACLE["profile_page_indexed"] = ORACLE["profile_page"]
ORACLE["reconcile_digest"] = ORACLE["reconcile_customers"]

ORACLE["integrity"] = with_records("""
SELECT 'orphan_event' AS "check", id, user_id FROM recs r
WHERE type = 'event' AND user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.user_id)
UNION ALL
SELECT 'orphan_change', CAST(position AS VARCHAR), user_id FROM changes k
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = k.user_id)
UNION ALL
SELECT 'duplicate_customer', CAST(c_custkey AS VARCHAR), NULL FROM customer GROUP BY c_custkey HAVING count(*) > 1
UNION ALL
SELECT 'duplicate_record', id, NULL FROM recs GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT 'duplicate_change', CAST(position AS VARCHAR) || ':' || name, NULL FROM changes GROUP BY position, name HAVING count(*) > 1
""")

ORACLE["store_attributes"] = ORACLE["latest_attributes"]
ORACLE["store_profiles"] = ORACLE["profile_json"]

NUMBERED = """
numbered AS (
  SELECT row_number() OVER (ORDER BY position, user_id, name) AS change_id, user_id, name, old_value, value, timestamp, position
  FROM changes
)
"""

ORACLE["store_changes"] = with_records("SELECT * FROM numbered", ctes=NUMBERED)
ORACLE["changes_by_id"] = with_records("SELECT * FROM numbered WHERE change_id BETWEEN 101 AND 300", ctes=NUMBERED)
ORACLE["stream_ndjson_changes"] = with_records(
    "SELECT change_id, user_id, name, old_value, value, timestamp FROM numbered", ctes=NUMBERED)

ORACLE["erase_state"] = with_records("""
SELECT part, user_id, count(*) AS n FROM (
  SELECT 'records' AS part, user_id FROM dedup
  UNION ALL SELECT 'latest', user_id FROM latest
  UNION ALL SELECT 'counts', user_id FROM counts
  UNION ALL SELECT 'customers', user_id FROM lu
  UNION ALL SELECT 'logged', user_id FROM (SELECT DISTINCT user_id, key FROM assertions)
  UNION ALL SELECT 'changes', user_id FROM changes
) WHERE user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
GROUP BY part, user_id
""")

ORACLE["merged_changes_event_time"] = ORACLE["attribute_changes_event_time"]
for name in ("stream_event_counts", "stream_latest_attributes"):
    ORACLE[f"{name}_upserts"] = ORACLE[name]
