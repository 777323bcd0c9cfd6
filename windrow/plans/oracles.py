"""SQL for each query, in DuckDB's dialect, written apart from the Spark code."""

# One reading per event. epoch_ms() would round to the nearest millisecond; the time is cut.
_SENSOR = """
sensor AS (
  SELECT ts, event_id, user_id,
         '00000000-0000-4000-8000-' || lpad(lower(to_hex(user_id)), 12, '0') AS "deviceId",
         epoch_us(ts) // 1000 AS timestamp_ms,
         value AS power,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS "rotorSpeed",
         value - 20 AS "windSpeed"
  FROM events)"""

_METRICS = _SENSOR + """,
metrics AS (
  SELECT ts, event_id, "deviceId", timestamp_ms, 'power' AS name, power AS value FROM sensor
  UNION ALL
  SELECT ts, event_id, "deviceId", timestamp_ms, 'rotorSpeed', "rotorSpeed" FROM sensor
  UNION ALL
  SELECT ts, event_id, "deviceId", timestamp_ms, 'windSpeed', "windSpeed" FROM sensor),
checked AS (SELECT *, value >= 0 AND NOT isnan(value) AS is_valid FROM metrics)"""

_FLAT = '"deviceId", timestamp_ms, name, value'

# Mean of a list, folded value by value; i is 2 at the second value.
_MEAN = "list_reduce(l, lambda a, x, i: a + (x - a) / i)"


def _windows(rows: str, n: int = 5, key: str = "", having: str = "") -> str:
    """Windows of n rows over a table with value, ts and event_id."""
    by = f'PARTITION BY "{key}" ' if key else ""
    col = f'"{key}", ' if key else ""
    return f"""
placed AS (
  SELECT {col}value, row_number() OVER ({by}ORDER BY ts, event_id) - 1 AS pos FROM {rows}),
grouped AS (
  SELECT {col}pos // {n} AS "window", count(*) AS "rows", max(pos) AS last_pos,
         list(value ORDER BY pos) AS l
  FROM placed GROUP BY ALL {having}),
windows AS (SELECT {col}"window", "rows", {_MEAN} AS average, last_pos FROM grouped)"""


def _valid(name: str) -> str:
    return f"{name}_valid AS (SELECT * FROM checked WHERE is_valid AND name = '{name}')"


_ROTOR = f"WITH {_METRICS}, {_valid('rotorSpeed')}"
_WIND = f"WITH {_METRICS}, {_valid('windSpeed')}"
_AVERAGES = 'SELECT "window", "rows", average FROM windows'

_READING = 'event_id, "deviceId", timestamp_ms, power, "rotorSpeed", "windSpeed"'

# Documents with the fault that goes with the rotor speed, and the checks on their text.
_JSON = _SENSOR + """,
parts AS (
  SELECT *, CAST("rotorSpeed" AS INT) AS k,
         CASE CAST("rotorSpeed" AS INT) WHEN 6 THEN '"x"' WHEN 9 THEN '"A-B-C-D-E"'
              ELSE '"' || "deviceId" || '"' END AS id_text,
         CASE CAST("rotorSpeed" AS INT) WHEN 3 THEN '"' || timestamp_ms || '"'
              WHEN 8 THEN timestamp_ms || '.75' WHEN 11 THEN '1e40'
              ELSE CAST(timestamp_ms AS VARCHAR) END AS time_text,
         CASE CAST("rotorSpeed" AS INT) WHEN 4 THEN '"' || power || '"' WHEN 7 THEN 'null'
              ELSE CAST(power AS VARCHAR) END AS power_text
  FROM sensor),
whole AS (
  SELECT *, '{"deviceId":' || id_text || ',"timestamp":' || time_text
            || CASE WHEN k = 13 THEN ',"extra":[1,{"a":"]"}]' ELSE '' END
            || ',"measurements":{"power":' || power_text || ',"rotorSpeed":' || "rotorSpeed"
            || CASE WHEN k = 5 THEN '' ELSE ',"windSpeed":' || "windSpeed" END || '}}' AS text
  FROM parts),
payloads AS (
  SELECT *, CASE k WHEN 1 THEN 'not json ' || text WHEN 2 THEN left(text, length(text) - 1)
                   WHEN 10 THEN text || ' x' WHEN 12 THEN '[' || text || ']' ELSE text END AS payload
  FROM whole),
documents_ AS (
  SELECT *, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS doc FROM payloads),
judged AS (
  SELECT *, CASE
    WHEN doc IS NULL OR json_type(doc) <> 'OBJECT' THEN 'not a JSON object'
    WHEN NOT regexp_full_match(doc ->> '$.deviceId', '[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}')
      THEN 'bad deviceId'
    WHEN json_type(doc, '$.timestamp') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      OR CAST(doc ->> '$.timestamp' AS DOUBLE) > 9e15 THEN 'bad timestamp'
    WHEN coalesce(json_type(doc, '$.measurements.power'), '') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')
      OR json_type(doc, '$.measurements.windSpeed') IS NULL THEN 'bad measurements'
    END AS fault
  FROM documents_)"""

_AVRO = _SENSOR + """,
judged AS (
  SELECT *, CAST("rotorSpeed" AS INT) AS k,
         CASE CAST("rotorSpeed" AS INT)
           WHEN 1 THEN 'null payload' WHEN 2 THEN 'truncated or malformed body'
           WHEN 3 THEN 'trailing bytes' WHEN 4 THEN 'truncated or malformed body'
           WHEN 5 THEN 'truncated or malformed body' WHEN 6 THEN 'bad deviceId' END AS fault
  FROM sensor)"""

_PADDED = "'0000000a-000b-000c-000d-00000000000e'"

_AVRO_KEPT = f"""
kept AS (
  SELECT ts, event_id, CASE WHEN k = 9 THEN {_PADDED} ELSE "deviceId" END AS "deviceId",
         timestamp_ms, power, "rotorSpeed", "windSpeed"
  FROM judged WHERE fault IS NULL)"""

# The dataflow over the Avro payloads.
_FLOW = f"""{_AVRO}, {_AVRO_KEPT},
metrics AS (
  SELECT ts, event_id, "deviceId", timestamp_ms, 'power' AS name, power AS value FROM kept
  UNION ALL SELECT ts, event_id, "deviceId", timestamp_ms, 'rotorSpeed', "rotorSpeed" FROM kept
  UNION ALL SELECT ts, event_id, "deviceId", timestamp_ms, 'windSpeed', "windSpeed" FROM kept),
checked AS (SELECT *, value >= 0 AND NOT isnan(value) AS is_valid FROM metrics),
{_valid('rotorSpeed')}"""

_FLOW_COUNTS = f"""
WITH {_FLOW}
SELECT 'sensordata' AS topic, count(*) AS "rows" FROM kept
UNION ALL SELECT 'metics', count(*) FROM metrics
UNION ALL SELECT 'valid-metics', count(*) FROM checked WHERE is_valid
UNION ALL SELECT 'invalid-metics', count(*) FROM checked WHERE NOT is_valid
UNION ALL SELECT 'rotor-data', count(*) FROM rotorSpeed_valid
UNION ALL SELECT 'rejects', count(*) FROM judged WHERE fault IS NOT NULL
UNION ALL SELECT 'averages', CAST(ceil(count(*) / 5.0) AS BIGINT) FROM rotorSpeed_valid"""

_METRIC_TEXT = """'{"deviceId":"' || "deviceId" || '","timestamp":' || timestamp_ms || ',"name":"' || name
       || '","value":' || value || '}'"""

_HOUR = "epoch_us(ts) // 3600000000"

SQL = {
    "flatten_metrics": f"WITH {_METRICS} SELECT {_FLAT} FROM metrics",
    "valid_metrics": f"WITH {_METRICS} SELECT {_FLAT} FROM checked WHERE is_valid",
    "invalid_metrics": f"""
        WITH {_METRICS}
        SELECT {_FLAT}, 'All measurements must be positive numbers!' AS error
        FROM checked WHERE NOT is_valid""",
    "validation_summary": f"""
        WITH {_METRICS} SELECT name, is_valid, count(*) AS metrics FROM checked GROUP BY ALL""",
    "routed_topics": f"""
        WITH {_METRICS}
        SELECT {_FLAT}, CASE WHEN is_valid THEN 'valid-metics' ELSE 'invalid-metics' END AS topic
        FROM checked""",
    "balance_validation": """
        WITH accounts AS (
          SELECT 'customer' AS owner, c_custkey AS id, c_acctbal AS value FROM customer
          UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier)
        SELECT owner, '00000000-0000-4000-8000-' || lpad(lower(to_hex(id)), 12, '0') AS "deviceId",
               value, value >= 0 AS is_valid,
               CASE WHEN value < 0 THEN 'All measurements must be positive numbers!' END AS error
        FROM accounts""",
    "lineitem_validation_summary": """
        WITH m AS (
          SELECT 'power' AS name, l_quantity AS value FROM lineitem
          UNION ALL SELECT 'rotorSpeed', l_extendedprice / 100 FROM lineitem
          UNION ALL SELECT 'windSpeed', l_discount - 0.05::DOUBLE FROM lineitem)
        SELECT name, value >= 0 AS is_valid, count(*) AS metrics FROM m GROUP BY ALL""",
    "rotor_speed": f"{_ROTOR} SELECT {_FLAT} FROM rotorSpeed_valid",
    "rotor_window_avg": f"{_ROTOR}, {_windows('rotorSpeed_valid')} {_AVERAGES}",
    "rotor_window_avg_full_only": (
        f"{_ROTOR}, {_windows('rotorSpeed_valid', having='HAVING count(*) = 5')} {_AVERAGES}"
    ),
    "wind_window_avg": f"{_WIND}, {_windows('windSpeed_valid')} {_AVERAGES}",
    "wide_window_avg": f"{_WIND}, {_windows('windSpeed_valid', 60)} {_AVERAGES}",
    "device_window_avg": f"""
        {_WIND}, {_windows('windSpeed_valid', key='deviceId')}
        SELECT "deviceId", "window", "rows", average FROM windows""",
    "window_commit_positions": f"""
        {_WIND}, {_windows('windSpeed_valid')} SELECT "window", last_pos FROM windows""",
    "lineitem_rotor_window_avg": f"""
        WITH placed AS (
          SELECT l_extendedprice / 100 AS value,
                 row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos
          FROM lineitem WHERE l_extendedprice >= 0),
        grouped AS (
          SELECT pos // 5 AS "window", count(*) AS "rows", list(value ORDER BY pos) AS l
          FROM placed GROUP BY ALL)
        SELECT "window", "rows", {_MEAN} AS average FROM grouped""",
    "demand_batches": """
        WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events)
        SELECT event_id, pos, pos // 5 AS batch, (pos + 1) % 5 = 0 AS asks_next FROM p""",
    "valid_lines": f"""
        WITH {_METRICS} SELECT 'Current metric is ' || {_METRIC_TEXT} AS line
        FROM checked WHERE is_valid""",
    "invalid_lines": f"""
        WITH {_METRICS}
        SELECT 'Invalid metric detected! {{"metric":' || {_METRIC_TEXT}
               || ',"error":"All measurements must be positive numbers!"}}' AS line
        FROM checked WHERE NOT is_valid""",
    "average_lines": f"""
        {_WIND}, {_windows('windSpeed_valid')}
        SELECT 'Average rotorspeed is: ' || average AS line FROM windows""",
    "json_roundtrip": f"WITH {_SENSOR} SELECT {_READING} FROM sensor",
    "json_ingest": f"""
        WITH {_JSON}
        SELECT event_id, CASE WHEN k = 9 THEN {_PADDED} ELSE doc ->> '$.deviceId' END AS "deviceId",
               timestamp_ms, CAST(doc ->> '$.measurements.power' AS DOUBLE) AS power,
               CAST(doc ->> '$.measurements.rotorSpeed' AS DOUBLE) AS "rotorSpeed",
               CAST(doc ->> '$.measurements.windSpeed' AS DOUBLE) AS "windSpeed"
        FROM judged WHERE fault IS NULL""",
    "json_rejects": f"WITH {_JSON} SELECT event_id, fault FROM judged WHERE fault IS NOT NULL",
    "json_number_times": f"""
        WITH {_SENSOR}
        SELECT event_id, CASE event_id % 6 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE timestamp_ms END AS timestamp_ms,
               CASE event_id % 6 WHEN 4 THEN 'bad timestamp' END AS fault
        FROM sensor""",
    "avro_roundtrip": f"WITH {_SENSOR} SELECT {_READING} FROM sensor",
    "avro_ingest": f"WITH {_AVRO}, {_AVRO_KEPT} SELECT {_READING} FROM kept",
    "avro_rejects": f"WITH {_AVRO} SELECT event_id, fault FROM judged WHERE fault IS NOT NULL",
    "generic_ingest": f"WITH {_METRICS} SELECT {_FLAT} FROM metrics",
    "reject_summary": f"""
        SELECT 'json' AS codec, coalesce(fault, 'kept') AS outcome, count(*) AS payloads
        FROM (WITH {_JSON} SELECT fault FROM judged) GROUP BY ALL
        UNION ALL
        SELECT 'avro', coalesce(fault, 'kept'), count(*)
        FROM (WITH {_AVRO} SELECT fault FROM judged) GROUP BY ALL""",
    "uuid_forms": """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN
                 lpad(lower(to_hex(event_id)), 8, '0') || '-' || lpad(lower(to_hex(user_id)), 4, '0')
                 || '-000a-0000-' || lpad(lower(to_hex(event_id * 1000003)), 12, '0') END AS id
        FROM events""",
    "millis_roundtrip": """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN -(epoch_us(ts) // 1000) END AS millis FROM events""",
    "record_lines": """
        WITH r AS (
          SELECT 'readings-' || user_id % 4 AS topic_partition, event_id AS "offset",
                 strftime(ts, '%H:%M:%S:%g UTC %d %b %Y') AS "time", CAST(user_id AS INT) AS "key",
                 props AS value
          FROM events)
        SELECT *, 'Received message: topic-partition=' || topic_partition || ' offset=' || "offset"
                  || ' timestamp=' || "time" || ' key=' || "key" || ' value=' || value AS line
        FROM r""",
    "kafka_payload_frame": """
        SELECT CAST(NULL AS VARCHAR) AS key_hex, hex(encode(props)) AS value_hex FROM events""",
    "kafka_keyed_frame": """
        WITH n AS (SELECT c_name, CAST(floor(c_acctbal) AS BIGINT) AS number FROM customer)
        SELECT lpad(to_hex(CASE WHEN number < 0 THEN number + 4294967296 ELSE number END), 8, '0') AS key_hex,
               c_name AS value
        FROM n""",
    "admit_quota": f"""
        WITH r AS (
          SELECT event_id, {_HOUR} AS "window",
                 row_number() OVER (PARTITION BY {_HOUR} ORDER BY ts, event_id) AS turn
          FROM events)
        SELECT event_id, "window", turn <= 10 AS admitted FROM r""",
    "schedule_quota": f"""
        WITH p AS (
          SELECT event_id, {_HOUR} AS "window", row_number() OVER (ORDER BY ts, event_id) - 1 AS pos
          FROM events),
        lanes AS (SELECT *, pos // 10 AS lap, pos % 10 AS lane FROM p)
        SELECT event_id, "window",
               lap + max("window" - lap) OVER (PARTITION BY lane ORDER BY lap) AS slot
        FROM lanes""",
    "assign_targets": """
        SELECT event_id, CAST(7000 + (row_number() OVER (ORDER BY ts, event_id) - 1) % 3 AS INT) AS target
        FROM events""",
    "hits_per_target": """
        WITH t AS (SELECT unnest([7000, 7001, 7002, 7003]) AS target),
        a AS (SELECT 7000 + (row_number() OVER (ORDER BY ts, event_id) - 1) % 3 AS target FROM events)
        SELECT t.target, count(a.target) AS hits FROM t LEFT JOIN a USING (target) GROUP BY t.target""",
    "nation_hits": """
        SELECT n_nationkey AS target, count(c_custkey) AS hits
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
    "spread_balance": """
        SELECT CAST(4 AS BIGINT) AS partitions, count(*) AS "rows", true AS balanced FROM events""",
    "pipeline_counts": _FLOW_COUNTS,
    "pipeline_averages": f"{_ROTOR}, {_windows('rotorSpeed_valid')} {_AVERAGES}",
    "topic_roundtrip_stream": f"WITH {_METRICS} SELECT {_FLAT} FROM checked WHERE is_valid",
    "limited_ingest_stream": f"WITH {_AVRO}, {_AVRO_KEPT} SELECT {_READING} FROM kept",
    "limited_ingest_counts": f"""
        WITH {_AVRO} SELECT coalesce(fault, 'kept') AS outcome, count(*) AS payloads FROM judged GROUP BY ALL""",
    "fanout_stream": f"""
        WITH {_FLOW}
        SELECT 'valid-metics' AS topic, {_FLAT} FROM checked WHERE is_valid
        UNION ALL SELECT 'rotor-data', {_FLAT} FROM rotorSpeed_valid""",
    "resume_stream": f"WITH {_FLOW}, {_windows('rotorSpeed_valid')} {_AVERAGES}",
    "chained_stream_counts": _FLOW_COUNTS,
    "stream_window_avg": f"{_WIND}, {_windows('windSpeed_valid')} {_AVERAGES}",
    "device_stream_window_avg": f"""
        {_WIND}, {_windows('windSpeed_valid', key='deviceId', having='HAVING count(*) = 5')}
        SELECT "deviceId", "window", "rows", average FROM windows""",
}

# A stream must give the rows of the table.
SQL["demand_batches_stream"] = SQL["demand_batches"]
SQL["admit_quota_stream"] = SQL["admit_quota"]
SQL["schedule_quota_stream"] = SQL["schedule_quota"]
SQL["hits_per_target_stream"] = SQL["hits_per_target"]
SQL["device_stream_all_windows"] = SQL["device_window_avg"]
SQL["device_stream_every_window"] = f"""
    {_WIND}, {_windows('windSpeed_valid', key='deviceId')}
    SELECT "deviceId", "window", "rows", average, last_pos FROM windows"""
SQL["demand_ingest_stream"] = f"""
    WITH {_AVRO}
    SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 999 AS batch, coalesce(fault, 'kept') AS outcome
    FROM judged"""
SQL["followed_topic_stream"] = f"WITH {_FLOW} SELECT {_FLAT} FROM checked WHERE is_valid"
SQL["outcome_counts_stream"] = SQL["limited_ingest_counts"]
SQL["line_topics_stream"] = f"""
    WITH {_FLOW}
    SELECT 'Current metric is ' || {_METRIC_TEXT} AS line FROM checked WHERE is_valid
    UNION ALL
    SELECT 'Invalid metric detected! {{"metric":' || {_METRIC_TEXT}
           || ',"error":"All measurements must be positive numbers!"}}'
    FROM checked WHERE NOT is_valid"""
# Metrics of events by 11 have no number, bodies of events by 13 are cut short.
_GENERIC = f"""
WITH {_METRICS},
sent AS (SELECT * REPLACE (value >= 0 AND event_id % 11 <> 0 AS is_valid) FROM checked),
kept AS (SELECT * FROM sent WHERE event_id % 13 <> 0),
rotor AS (SELECT * FROM kept WHERE is_valid AND name = 'rotorSpeed')"""
SQL["generic_pipeline_counts"] = f"""
    {_GENERIC}
    SELECT 'kept' AS topic, count(*) AS "rows" FROM kept
    UNION ALL SELECT 'truncated or malformed body', count(*) FROM sent WHERE event_id % 13 = 0
    UNION ALL SELECT 'metics', count(*) FROM kept
    UNION ALL SELECT 'valid-metics', count(*) FROM kept WHERE is_valid
    UNION ALL SELECT 'invalid-metics', count(*) FROM kept WHERE NOT is_valid
    UNION ALL SELECT 'rotor-data', count(*) FROM rotor
    UNION ALL SELECT 'averages', CAST(ceil(count(*) / 5.0) AS BIGINT) FROM rotor"""
SQL["generic_pipeline_averages"] = f"{_GENERIC}, {_windows('rotor')} {_AVERAGES}"
SQL["admit_quota_queue"] = f"""
    WITH RECURSIVE r AS (
      SELECT event_id, {_HOUR} AS "window",
             row_number() OVER (PARTITION BY {_HOUR} ORDER BY ts, event_id) - 1 AS turn
      FROM events),
    counts AS (SELECT "window", count(*) AS n, row_number() OVER (ORDER BY "window") AS i FROM r GROUP BY "window"),
    depths AS (
      SELECT i, "window", n, CAST(0 AS BIGINT) AS depth FROM counts WHERE i = 1
      UNION ALL
      SELECT c.i, c."window", c.n,
             greatest(0, greatest(0, d.depth + least(d.n, greatest(0, 10 - d.depth)) - 4) - 4 * (c."window" - d."window" - 1))
      FROM depths d JOIN counts c ON c.i = d.i + 1)
    SELECT event_id, "window", depth, turn < 10 - depth AS admitted FROM r JOIN depths USING ("window")"""
