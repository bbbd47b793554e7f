"""DuckDB SQL for the registered queries, over the same Parquet tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

AS_OF = "(SELECT max(ts) FROM events)"

# ---- The derived tables, as common table expressions --------------------------------------

# The status rules, labels and compass points below.
_STATUS = """CASE WHEN nav_status = 1 THEN 'ANCHORED' WHEN nav_status = 5 THEN 'MOORED'
    WHEN nav_status = 0 AND coalesce(sog_knots, 0) = 0 THEN 'STOPPED'
    WHEN nav_status IN (0, 8) AND coalesce(sog_knots, 0) > 0 THEN 'UNDERWAY' ELSE 'UNKNOWN' END"""

_MMSI = """CASE WHEN user_id % 25 = 0 THEN 'BAD' || CAST(user_id AS VARCHAR)
    ELSE CAST(200000000 + user_id AS VARCHAR) END"""


def _reports(mmsi: str, latitude: str, longitude: str) -> str:
    return f"""SELECT event_id AS seq, ts, user_id, value, CAST(event_id AS VARCHAR) AS event_id,
    '1.0' AS schema_version, 'PositionReport' AS message_type, {mmsi} AS mmsi,
    CASE WHEN user_id % 10 = 3 THEN NULL ELSE 'VESSEL ' || CAST(user_id AS VARCHAR) END AS ship_name,
    {latitude} AS latitude, {longitude} AS longitude,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value % CAST(25 AS DOUBLE) END AS sog_knots,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE ((event_id * 45) % 7400) / CAST(20 AS DOUBLE) END AS cog_degrees,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id % 360 AS DOUBLE) END AS true_heading,
    CASE WHEN event_id % 257 = 0 THEN NULL ELSE CAST(event_id % 257 - 128 AS DOUBLE) END AS rate_of_turn,
    CASE WHEN (event_id * 5) % 17 = 16 THEN NULL ELSE CAST((event_id * 5) % 17 AS INTEGER) END AS nav_status,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS position_accuracy,
    event_id % 2 = 0 AS raim, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' +0000 UTC' AS event_time,
    epoch_us(ts) / CAST(1000000 AS DOUBLE) + value - CAST(5 AS DOUBLE) AS ingested_at,
    'aisstream' AS source FROM events"""


POSITIONS = "positions AS (" + _reports(
    _MMSI,
    "(1200000 + ((user_id * 37) % 40) * 3000 + (event_id % 7) * 500) / CAST(1000000 AS DOUBLE)",
    "(103600000 + ((user_id * 53) % 40) * 3000 + (event_id % 5) * 500) / CAST(1000000 AS DOUBLE)") + ")"

_K = "(event_id % 1000003)"
_LAT = f"({_K} * {_K} * 31 + {_K} * 17) % 3989"
_LON = f"({_K} * {_K} * 13 + {_K} * 7) % 4001"
FLEET_POSITIONS = "positions AS (" + _reports(
    "CAST(200000000 + event_id AS VARCHAR)",
    f"""CASE WHEN event_id % 3 = 0 THEN (1250000 + {_LAT} * 2) / CAST(1000000 AS DOUBLE)
        ELSE (1000000 + {_LAT} * 500) / CAST(1000000 AS DOUBLE) END""",
    f"""CASE WHEN event_id % 3 = 0 THEN (103750000 + {_LON} * 2) / CAST(1000000 AS DOUBLE)
        ELSE (103000000 + {_LON} * 500) / CAST(1000000 AS DOUBLE) END""") + ")"

STATE = f"""state AS (SELECT mmsi, ship_name, latitude, longitude, sog_knots, cog_degrees, true_heading,
    rate_of_turn, nav_status, {_STATUS} AS status, ts AS last_seen_at, {AS_OF} AS updated_at
    FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY seq DESC) AS rn FROM positions)
    WHERE rn = 1)"""
AGED = f"""aged AS (SELECT * REPLACE (CASE WHEN last_seen_at < {AS_OF} - INTERVAL 720 MINUTE
    AND status <> 'STALE' THEN 'STALE' ELSE status END AS status) FROM state)"""
TRACK = """track AS (SELECT mmsi, event_id, latitude, longitude, sog_knots, ts AS event_time,
    date_trunc('hour', ts) AS partition_hour FROM positions)"""
ARCHIVE = """archive AS (SELECT *, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS HH,
    ingested_at - epoch_us(ts) / CAST(1000000 AS DOUBLE) AS latency FROM positions)"""

VALID = "regexp_full_match(mmsi, '[0-9]{9}')"

_NAV = """CASE nav_status WHEN 0 THEN 'Underway' WHEN 1 THEN 'At Anchor' WHEN 2 THEN 'Not Under Command'
    WHEN 3 THEN 'Restricted Manoeuverability' WHEN 4 THEN 'Constrained by Draught' WHEN 5 THEN 'Moored'
    WHEN 6 THEN 'Aground' WHEN 7 THEN 'Engaged in Fishing' WHEN 8 THEN 'Underway Sailing'
    WHEN 14 THEN 'AIS-SART' WHEN 15 THEN 'Undefined'
    ELSE CASE WHEN nav_status IS NULL THEN 'Unknown' ELSE 'Reserved' END END"""
_NAV_SHORT = """CASE nav_status WHEN 0 THEN 'Underway' WHEN 1 THEN 'At Anchor'
    WHEN 2 THEN 'Not under command' WHEN 3 THEN 'Restricted' WHEN 4 THEN 'By draught'
    WHEN 5 THEN 'Moored' WHEN 6 THEN 'Aground' WHEN 7 THEN 'Fishing' WHEN 8 THEN 'Sailing'
    WHEN 14 THEN 'AIS-SART' WHEN 15 THEN 'Unknown'
    ELSE CASE WHEN nav_status IS NULL THEN 'Unknown' ELSE 'Reserved' END END"""
_COMPASS = """['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW',
    'W', 'WNW', 'NW', 'NNW']"""


def add(name: str, body: str, *ctes: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + body


def lambert(source: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """A sub-select of ``source`` with the spheroid distance as ``d``."""
    f = "(1 / CAST(298.257223563 AS DOUBLE))"
    u = f"atan((1 - {f}) * tan(radians({{}})))"
    return f"""(SELECT *, CASE WHEN h <= 0 THEN 0 ELSE CAST(6378137 AS DOUBLE) * (s - {f} / 2 * (
        (s - sin(s)) * power(sin((u1 + u2) / 2) * cos((u2 - u1) / 2) / cos(s / 2), 2)
      + (s + sin(s)) * power(cos((u1 + u2) / 2) * sin((u2 - u1) / 2) / sin(s / 2), 2))) END AS d
    FROM (SELECT *, 2 * asin(sqrt(least(1, h))) AS s
    FROM (SELECT *, power(sin((u2 - u1) / 2), 2)
        + cos(u1) * cos(u2) * power(sin(radians({lon2} - {lon1}) / 2), 2) AS h
    FROM (SELECT *, {u.format(lat1)} AS u1, {u.format(lat2)} AS u2 FROM {source}))))"""


# ---- Sources and scalar rules -------------------------------------------------------------

add("positions", """SELECT event_id, schema_version, message_type, mmsi, ship_name, latitude, longitude,
    sog_knots, cog_degrees, true_heading, rate_of_turn, nav_status, position_accuracy, raim,
    event_time, ingested_at, source FROM positions""", POSITIONS)
add("filter_subscription", """SELECT event_id, mmsi, latitude, longitude FROM positions
    WHERE (latitude BETWEEN 1.2 AND 1.25 AND longitude BETWEEN 103.6 AND 103.66)
       OR (latitude BETWEEN 1.26 AND 1.30 AND longitude BETWEEN 103.68 AND 103.72)""", POSITIONS)
add("valid_mmsi", f"""SELECT {VALID} AS valid, count(*) AS events, count(DISTINCT mmsi) AS vessels
    FROM positions GROUP BY 1""", POSITIONS)
add("derive_status", f"SELECT event_id, {_STATUS} AS status FROM positions", POSITIONS)
add("decode_rot", """SELECT event_id,
    CASE WHEN abs(rate_of_turn) < 127 THEN round(4.733 * sqrt(abs(rate_of_turn)), 1) END AS rot_deg_min,
    CASE WHEN abs(rate_of_turn) >= 127 THEN CASE WHEN rate_of_turn > 0 THEN 'port' ELSE 'starboard' END
         WHEN rate_of_turn > 0 THEN 'starboard' WHEN rate_of_turn IS NOT NULL THEN 'port' END AS direction,
    CASE WHEN rate_of_turn IS NULL THEN 0.0 WHEN abs(rate_of_turn) >= 127 THEN 10.0
         ELSE round(4.733 * sqrt(abs(rate_of_turn)), 1) END AS effective,
    CASE WHEN abs(rate_of_turn) < 127
         THEN round(power(abs(rate_of_turn) / CAST(4.733 AS DOUBLE), 2), 1) END AS itu_deg_min,
    CASE WHEN rate_of_turn > 0 THEN 'starboard' WHEN rate_of_turn < 0 THEN 'port' END AS itu_direction
    FROM positions""", POSITIONS)
add("nav_labels", f"""SELECT nav_status, {_NAV} AS label, {_NAV_SHORT} AS short_label, count(*) AS count
    FROM positions GROUP BY nav_status""", POSITIONS)
add("geodesic_distance", f"""SELECT event_id, round(d, 4) AS lambert_m,
    round(2 * CAST(6371008.8 AS DOUBLE) * asin(sqrt(power(sin(radians(lat0 - latitude) / 2), 2)
        + cos(radians(latitude)) * cos(radians(lat0)) * power(sin(radians(lon0 - longitude) / 2), 2))), 4)
        AS haversine_m,
    round(sqrt((latitude - lat0) * (latitude - lat0) + (longitude - lon0) * (longitude - lon0)), 9)
        AS planar_deg
    FROM {lambert('''(SELECT *, CAST(1.25 AS DOUBLE) AS lat0, CAST(103.65 AS DOUBLE) AS lon0
        FROM positions)''', 'latitude', 'longitude', 'lat0', 'lon0')}""", POSITIONS)

# ---- Ingest -------------------------------------------------------------------------------

_FRAMES = """frames AS (SELECT *, seq % 23 AS k, CASE WHEN seq % 23 = 4 THEN ts + INTERVAL 2 HOUR
    WHEN seq % 23 = 5 THEN ts - INTERVAL 7 HOUR ELSE ts END AS said FROM positions)"""
_TOLD = """told AS (SELECT *, array_to_string(list_sort(list_filter(CASE
    WHEN k = 9 THEN ['payload is not a JSON object']
    WHEN k = 14 THEN ['unsupported MessageType: ''Bogus''']
    WHEN k = 6 THEN [NULL]
    ELSE [
      CASE WHEN k = 0 THEN 'missing PositionReport key: Cog' END,
      CASE WHEN k = 2 THEN 'invalid Latitude: 95.0' WHEN k = 15 THEN 'invalid Latitude: ''1.2''' END,
      CASE WHEN k = 3 THEN 'unparseable time_utc: ''not-a-date''' END,
      CASE WHEN k = 7 THEN 'missing top-level key: MetaData' END,
      CASE WHEN k IN (7, 11) THEN 'MetaData is not an object' END,
      CASE WHEN k = 10 THEN 'invalid Longitude: None' END,
      CASE WHEN k = 12 THEN 'Message.PositionReport is not an object' END,
      CASE WHEN k = 8 THEN 'invalid Sog: -1' WHEN k <> 12 AND sog_knots IS NULL THEN 'invalid Sog: None' END
    ] END, lambda x: x IS NOT NULL)), '; ') AS errors,
    CASE WHEN k IN (3, 7, 9, 11, 13) THEN NULL ELSE said END AS event_ts FROM frames)"""
_SKEW = """CASE WHEN event_ts IS NULL THEN 'unparseable_timestamp'
    WHEN epoch_us(event_ts) / CAST(1000000 AS DOUBLE) - ingested_at > 60 THEN 'future_timestamp'
    WHEN epoch_us(event_ts) / CAST(1000000 AS DOUBLE) - ingested_at < -21600 THEN 'stale_timestamp' END"""
_ROUTED = f"""routed AS (SELECT *, CASE WHEN k IN (6, 9, 14) THEN 'skip' WHEN reason IS NULL THEN 'publish'
    ELSE 'dlq' END AS route FROM (SELECT *, CASE WHEN k IN (6, 9, 14) THEN NULL
    WHEN errors <> '' THEN 'validation_failed' ELSE {_SKEW} END AS reason FROM told))"""
_INGEST = (POSITIONS, _FRAMES, _TOLD, _ROUTED)

add("validate_frames", "SELECT seq AS event_id, errors = '' AS valid, errors FROM told",
    POSITIONS, _FRAMES, _TOLD)
add("read_frames", """SELECT CASE k WHEN 6 THEN 'ShipStaticData' WHEN 14 THEN 'Bogus'
    ELSE 'PositionReport' END AS message_type, count(*) AS frames,
    round(min(ingested_at), 3) AS first_arrival, round(max(ingested_at), 3) AS last_arrival
    FROM frames WHERE k <> 9 GROUP BY 1""", POSITIONS, _FRAMES)
add("position_reports", "SELECT seq AS event_id FROM frames WHERE k NOT IN (6, 9, 14)", POSITIONS, _FRAMES)
add("skew_gate", f"""SELECT seq AS event_id, event_ts, {_SKEW} AS reason,
    CAST(trunc((ingested_at - coalesce(epoch_us(event_ts) / CAST(1000000 AS DOUBLE), 0)) * 1000) AS BIGINT)
    AS latency_ms FROM told""", POSITIONS, _FRAMES, _TOLD)
add("normalize_frames", """SELECT schema_version, message_type, mmsi, ship_name, latitude, longitude, sog_knots,
    CASE WHEN k = 1 THEN NULL ELSE cog_degrees END AS cog_degrees, true_heading, rate_of_turn, nav_status,
    seq % 2 = 1 AS position_accuracy, raim, event_time, ingested_at, source,
    mmsi AS raw_mmsi, latitude AS raw_latitude, ingested_at AS raw_received_at
    FROM routed WHERE route = 'publish'""", *_INGEST)
add("ingest_routes", "SELECT route, reason, count(*) AS frames FROM routed GROUP BY route, reason", *_INGEST)
add("event_id", """SELECT count(*) AS frames, count(*) AS ids, count(*) AS well_formed, count(*) AS by_arrival,
    count(*) AS by_content FROM frames WHERE k <> 9""", POSITIONS, _FRAMES)
add("ingest_records", """SELECT CASE route WHEN 'publish' THEN 'ais.raw' ELSE 'ais.dlq' END AS topic,
    route = 'publish' AS keyed, reason, CASE WHEN route = 'dlq' THEN 'ingestion' END AS service,
    count(*) AS records,
    count(DISTINCT CASE WHEN reason = 'validation_failed' THEN NULL ELSE mmsi END) AS vessels
    FROM routed WHERE route <> 'skip' GROUP BY 1, 2, 3, 4""", *_INGEST)

_DAMAGED = """damaged AS (SELECT *, seq % 29 AS n, CASE seq % 29 WHEN 1 THEN 'latitude' WHEN 2 THEN 'nav_status'
    WHEN 6 THEN 'value' ELSE '' END AS bad FROM positions WHERE seq % 29 <> 7)"""
_POISON = """CASE WHEN n = 6 THEN 'row_build_failed: value' WHEN n IN (1, 2, 4) THEN 'db_insert_failed' END"""
add("decode_log", """SELECT bad, count(*) AS records, count(*) FILTER (WHERE n NOT IN (4, 6)) AS with_id,
    count(*) FILTER (WHERE n NOT IN (1, 6)) AS with_latitude,
    count(*) FILTER (WHERE n NOT IN (5, 6)) AS with_longitude,
    count(*) FILTER (WHERE n <> 6 AND (n = 3 OR sog_knots IS NOT NULL)) AS with_speed,
    count(*) FILTER (WHERE n NOT IN (2, 6) AND nav_status IS NOT NULL) AS with_nav
    FROM damaged GROUP BY bad""", POSITIONS, _DAMAGED)
add("split_poison", f"""SELECT 'archive' AS target,
    CASE WHEN bad <> '' THEN 'parquet_serialization_failed' END AS reason, count(*) AS records
    FROM damaged GROUP BY 2
    UNION ALL SELECT 'state', {_POISON}, count(*) FROM damaged GROUP BY 2""", POSITIONS, _DAMAGED)
add("dlq_records", f"""SELECT 'ais.dlq' AS topic, {_POISON} AS reason, 'stream_processor' AS service,
    CASE WHEN n = 6 THEN NULL ELSE mmsi END AS mmsi FROM damaged WHERE n IN (1, 2, 4, 6)""",
    POSITIONS, _DAMAGED)

# ---- State and track ----------------------------------------------------------------------

add("latest_state", "SELECT * FROM state", POSITIONS, STATE)
add("latest_state_by_event_time", f"""SELECT mmsi, latitude, longitude, {_STATUS} AS status,
    ts AS last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, seq DESC) AS rn
    FROM positions) WHERE rn = 1""", POSITIONS)
add("upsert_state", """SELECT * REPLACE (CASE WHEN last_seen_at < TIMESTAMP '2024-01-16 00:00:00'
    THEN TIMESTAMP '2024-01-16 00:00:00' ELSE updated_at END AS updated_at) FROM state""",
    POSITIONS, STATE)
_SUMMARY = """mmsi, ship_name, latitude, longitude, sog_knots, cog_degrees, true_heading, nav_status,
    status, last_seen_at"""
add("list_vessels", f"SELECT {_SUMMARY} FROM state ORDER BY mmsi", POSITIONS, STATE)
add("vessel_detail", f"""SELECT {_SUMMARY}, rate_of_turn, updated_at FROM state
    WHERE mmsi = '200000007'""", POSITIONS, STATE)
add("build_track", """SELECT mmsi, event_id, latitude, longitude, sog_knots, event_time, partition_hour,
    longitude AS lon, latitude AS lat FROM track""", POSITIONS, TRACK)
add("dedup_track", "SELECT mmsi, event_id, sog_knots FROM track", POSITIONS, TRACK)
add("append_track", """SELECT mmsi, event_id, event_time FROM track
    WHERE event_time >= TIMESTAMP '2024-01-16 00:00:00'""", POSITIONS, TRACK)
add("vessel_track", f"""SELECT event_time, latitude, longitude, sog_knots FROM track
    WHERE mmsi = '200000007' AND event_time > {AS_OF} - INTERVAL 168 HOUR
    ORDER BY event_time, event_id""", POSITIONS, TRACK)
add("track_points", "SELECT mmsi, count(*) AS points FROM track GROUP BY mmsi", POSITIONS, TRACK)
add("hourly_counts", """SELECT partition_hour, count(*) AS events FROM track GROUP BY partition_hour""",
    POSITIONS, TRACK)
add("track_linestring", """SELECT mmsi, partition_hour AS since, CAST(count(*) AS INTEGER) AS points,
    '{"type":"Feature","geometry":{"type":"LineString","coordinates":['
    || string_agg('[' || CAST(longitude AS VARCHAR) || ',' || CAST(latitude AS VARCHAR) || ']', ','
       ORDER BY event_time, event_id) || ']},"properties":{}}' AS feature
    FROM track GROUP BY mmsi, partition_hour""", POSITIONS, TRACK)
add("geojson_features", """SELECT mmsi, 'Point' AS geometry, longitude AS lon, latitude AS lat, status,
    CASE WHEN mmsi = '200000007' THEN 'true' ELSE 'false' END AS selected
    FROM aged WHERE status IS DISTINCT FROM 'STALE'""", POSITIONS, STATE, AGED)

# ---- Fleet reports ------------------------------------------------------------------------

_KPIS = f"""count(*) AS total,
    count(*) FILTER (WHERE last_seen_at > {AS_OF} - INTERVAL 45 MINUTE) AS fresh,
    count(*) FILTER (WHERE status = 'STALE') AS stale,
    count(*) FILTER (WHERE coalesce(sog_knots, 0) > 0.5) AS moving,
    count(*) FILTER (WHERE coalesce(sog_knots, 0) <= 0.5) AS idle,
    count(*) FILTER (WHERE status = 'ANCHORED') AS anchored,
    count(*) FILTER (WHERE status = 'MOORED') AS moored,
    round(avg(sog_knots), 6) AS avg_sog, max(sog_knots) AS max_sog"""
_EVENTS = f"SELECT count(*) AS events_window FROM track WHERE event_time > {AS_OF} - INTERVAL 12 HOUR"
_FASTEST = f"""SELECT mmsi, ship_name, sog_knots FROM state WHERE {VALID}
    ORDER BY sog_knots DESC NULLS LAST, mmsi LIMIT 1"""
_BY_STATUS = f"""SELECT status, count(*) AS count FROM aged WHERE {VALID} GROUP BY status"""
add("fleet_kpis", f"SELECT {_KPIS} FROM aged WHERE {VALID}", POSITIONS, STATE, AGED)
add("events_window", _EVENTS, POSITIONS, TRACK)
add("status_counts", _BY_STATUS + " ORDER BY count DESC, status", POSITIONS, STATE, AGED)
add("fastest_vessel", _FASTEST, POSITIONS, STATE)
add("fleet_summary", f"""SELECT {_KPIS}, ({_EVENTS}) AS events_window,
    (SELECT mmsi FROM ({_FASTEST})) AS fastest_mmsi, (SELECT sog_knots FROM ({_FASTEST})) AS fastest_sog,
    (SELECT '[' || string_agg('{{"status":"' || status || '","count":' || CAST(count AS VARCHAR) || '}}', ','
        ORDER BY count DESC, status) || ']' FROM ({_BY_STATUS})) AS status_list
    FROM aged WHERE {VALID}""", POSITIONS, STATE, AGED, TRACK)
_BUCKETS = f"""SELECT CASE WHEN sog_knots < 0 THEN 0 WHEN sog_knots >= 20 THEN 21
    ELSE CAST(floor(sog_knots) AS INTEGER) + 1 END AS b, count(*) AS count
    FROM state WHERE {VALID} AND sog_knots IS NOT NULL GROUP BY 1"""
_SPEED = f"""round(avg(sog_knots), 6) AS avg_sog, round(quantile_cont(sog_knots, 0.5), 6) AS p50_sog,
    max(sog_knots) AS max_sog, count(*) AS sample_n FROM state WHERE {VALID} AND sog_knots IS NOT NULL"""
add("speed_histogram", f"""SELECT CAST(b - 1 AS DOUBLE) AS bucket_min,
    CASE WHEN b <= 20 THEN CAST(b AS DOUBLE) END AS bucket_max, count FROM ({_BUCKETS}) ORDER BY b""",
    POSITIONS, STATE)
add("speed_stats", f"SELECT {_SPEED}", POSITIONS, STATE)
add("speed_distribution", f"""SELECT (SELECT '[' || string_agg('{{"bucket_min":' || CAST(b - 1 AS VARCHAR)
    || '.0,"bucket_max":' || CASE WHEN b <= 20 THEN CAST(b AS VARCHAR) || '.0' ELSE 'null' END
    || ',"count":' || CAST(count AS VARCHAR) || '}}', ',' ORDER BY b) || ']' FROM ({_BUCKETS})) AS buckets,
    {_SPEED}""", FLEET_POSITIONS, STATE)
_NAV_BUCKETS = f"""SELECT arg_max(nav_status, n * 100 - nav_status) AS code, label,
    CAST(sum(n) AS BIGINT) AS count FROM (SELECT nav_status, {_NAV} AS label, count(*) AS n
    FROM state WHERE {VALID} GROUP BY nav_status) GROUP BY label"""
add("nav_distribution", _NAV_BUCKETS + " ORDER BY count DESC, label", POSITIONS, STATE)
add("nav_report", f"""SELECT '[' || string_agg('{{"code":' || coalesce(CAST(code AS VARCHAR), 'null')
    || ',"label":"' || label || '","count":' || CAST(count AS VARCHAR) || '}}', ','
    ORDER BY count DESC, label) || ']' AS buckets, CAST(sum(count) AS BIGINT) AS total
    FROM ({_NAV_BUCKETS})""", FLEET_POSITIONS, STATE)
_ROSE = f"""SELECT s * CAST(22.5 AS DOUBLE) AS sector_deg, {_COMPASS}[s + 1] AS label, count(*) AS count,
    round(avg(sog_knots), 6) AS avg_sog
    FROM (SELECT *, CAST(round_even(cog_degrees / 22.5, 0) AS INTEGER) % 16 AS s FROM aged
    WHERE {VALID} AND status IS DISTINCT FROM 'STALE' AND cog_degrees >= 0 AND cog_degrees < 360) GROUP BY s"""
add("flow_rose", _ROSE + " ORDER BY sector_deg", POSITIONS, STATE, AGED)
add("flow_dense", f"""SELECT i * CAST(22.5 AS DOUBLE) AS sector_deg, {_COMPASS}[i + 1] AS label,
    coalesce(r.count, 0) AS count, r.avg_sog FROM range(16) t(i)
    LEFT JOIN ({_ROSE}) r ON r.sector_deg = i * CAST(22.5 AS DOUBLE) ORDER BY 1""", POSITIONS, STATE, AGED)
add("maneuvering", f"""SELECT * FROM (SELECT mmsi, ship_name, rate_of_turn,
    CASE WHEN abs(rate_of_turn) < 127 THEN round(4.733 * sqrt(abs(rate_of_turn)), 1) END AS rot_deg_min,
    CASE WHEN abs(rate_of_turn) >= 127 THEN CASE WHEN rate_of_turn > 0 THEN 'port' ELSE 'starboard' END
         WHEN rate_of_turn > 0 THEN 'starboard' ELSE 'port' END AS direction, sog_knots, nav_status
    FROM state WHERE {VALID} AND rate_of_turn IS NOT NULL
    ORDER BY abs(rate_of_turn) DESC, mmsi LIMIT 100) WHERE coalesce(rot_deg_min, 10.0) >= 5""",
    POSITIONS, STATE)
add("cumulative_share", f"""SELECT code, label, count,
    round((upto - count) / total * 2 * pi() - pi() / 2, 6) AS start_angle,
    round(upto / total * 2 * pi() - pi() / 2, 6) AS end_angle
    FROM (SELECT *, CAST(sum(count) OVER () AS DOUBLE) AS total,
    CAST(sum(count) OVER (ORDER BY count DESC, label ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto
    FROM ({_NAV_BUCKETS}))""", POSITIONS, STATE)
add("share_of_max", f"""SELECT status, count, round(CAST(count AS DOUBLE) / top, 6) AS share,
    CAST(least(4, floor(CAST(count AS DOUBLE) / top * 5)) AS INTEGER) AS color_index
    FROM (SELECT *, greatest(max(count) OVER (), 1) AS top FROM ({_BY_STATUS}))""", POSITIONS, STATE, AGED)
add("visible_count", """SELECT count(*) AS visible FROM aged WHERE status IS DISTINCT FROM 'STALE'""",
    POSITIONS, STATE, AGED)
add("age_buckets", f"""SELECT mmsi, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || ' min ago'
    ELSE (m // 60) || ' h ago' END AS age FROM (SELECT mmsi,
    greatest(0, (epoch_us({AS_OF}) - epoch_us(last_seen_at)) // 60000000) AS m FROM state)""",
    POSITIONS, STATE)
add("map_symbols", """SELECT mmsi, coalesce(nullif(ship_name, ''), 'Vessel ' || mmsi) AS name,
    CASE status WHEN 'UNDERWAY' THEN '#22c55e' WHEN 'ANCHORED' THEN '#f59e0b' WHEN 'MOORED' THEN '#a855f7'
    WHEN 'STOPPED' THEN '#ef4444' WHEN 'STALE' THEN '#94a3b8' ELSE '#64748b' END AS color,
    coalesce(cog_degrees, true_heading, 0) AS rotation FROM aged""", POSITIONS, STATE, AGED)

# ---- Proximity ----------------------------------------------------------------------------

_SIDE = "mmsi, ship_name, latitude, longitude, sog_knots, status"


def _near(lat: float, lon: float, radius: float) -> str:
    source = f"(SELECT *, CAST({lat} AS DOUBLE) AS lat0, CAST({lon} AS DOUBLE) AS lon0 FROM state)"
    return f"""SELECT {_SIDE}, round(d, 3) AS distance_m
    FROM {lambert(source, 'latitude', 'longitude', 'lat0', 'lon0')} WHERE round(d, 3) <= {radius}
    ORDER BY round(d, 3), mmsi LIMIT 100"""


def _pairs(condition: str) -> str:
    source = f"""(SELECT a.mmsi AS a_mmsi, b.mmsi AS b_mmsi, a.latitude AS alat, a.longitude AS alon,
        b.latitude AS blat, b.longitude AS blon FROM state a JOIN state b ON a.mmsi < b.mmsi
        WHERE regexp_full_match(a.mmsi, '[0-9]{{9}}') AND regexp_full_match(b.mmsi, '[0-9]{{9}}')
        AND {condition})"""
    return lambert(source, "alat", "alon", "blat", "blon")


def _planar(radius: int) -> str:
    m = f"(CAST({radius} AS DOUBLE) / 111000)"
    return f"""abs(a.latitude - b.latitude) < {m} AND abs(a.longitude - b.longitude) < {m}
        AND sqrt((a.latitude - b.latitude) * (a.latitude - b.latitude)
               + (a.longitude - b.longitude) * (a.longitude - b.longitude)) <= {m}"""


_TOP = "ORDER BY round(d, 3), a_mmsi, b_mmsi LIMIT 50"
add("nearby", _near(1.25, 103.65, 3000), POSITIONS, STATE)
add("nearby_fleet", _near(1.2541, 103.7542, 20000), FLEET_POSITIONS, STATE)
add("nearby_many", f"""SELECT point_id, mmsi, rank, round(d, 3) AS distance_m FROM (
    SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(d, 3), mmsi) AS rank
    FROM {lambert('''(SELECT p.event_id AS point_id, p.latitude AS lat0, p.longitude AS lon0, s.mmsi,
        s.latitude, s.longitude FROM positions p JOIN state s
        ON abs(p.latitude - s.latitude) < 0.006 AND abs(p.longitude - s.longitude) < 0.006)''',
        'latitude', 'longitude', 'lat0', 'lon0')}
    WHERE round(d, 3) <= 500) WHERE rank <= 5""", POSITIONS, STATE)
add("conflicts", f"""SELECT a_mmsi, b_mmsi, round(d, 3) AS distance_m
    FROM {_pairs(_planar(500))} {_TOP}""", POSITIONS, STATE)
add("conflicts_fleet", f"""SELECT a_mmsi, b_mmsi, round(d, 3) AS distance_m
    FROM {_pairs(_planar(500))} {_TOP}""", FLEET_POSITIONS, STATE)
add("conflicts_geodesic", f"""SELECT a_mmsi, b_mmsi, round(d, 3) AS distance_m FROM {_pairs(
    "abs(a.latitude - b.latitude) < 0.004 AND abs(a.longitude - b.longitude) < 0.004")}
    WHERE round(d, 3) <= 300 {_TOP}""", FLEET_POSITIONS, STATE)
add("conflict_severity", f"""SELECT a_mmsi, b_mmsi, round(d, 3) AS distance_m,
    CASE WHEN d < 150 THEN 'hi' WHEN d < 350 THEN 'mid' ELSE 'low' END AS severity,
    CASE WHEN d < 1000 THEN CAST(CAST(floor(d + 0.5) AS BIGINT) AS VARCHAR) || ' m'
    ELSE printf('%.2f km', d / 1000) END AS distance_text
    FROM {_pairs(_planar(2000))} ORDER BY round(d, 3), a_mmsi, b_mmsi LIMIT 20""", POSITIONS, STATE)

# ---- Archive and data quality -------------------------------------------------------------


def _hours(hours: int) -> str:
    return f"date_trunc('hour', ts) >= date_trunc('hour', {AS_OF} - INTERVAL {hours} HOUR)"


def _arrived(hours: int) -> str:
    return f"""{_hours(hours)} AND ingested_at >= epoch_us({AS_OF} - INTERVAL {hours} HOUR)
    / CAST(1000000 AS DOUBLE)"""


def _rank(where: str, k: str) -> str:
    return f"""(SELECT round(latency, 6) FROM (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS k,
    count(*) OVER () AS n FROM archive WHERE latency >= 0 AND {where}) WHERE k = {k})"""


_P50, _P95 = "n // 2", "CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT)"


def _latency(hours: int) -> str:
    return f"""round_even(avg(latency) FILTER (WHERE latency >= 0), 1) AS avg_s,
    {_rank(_arrived(hours), _P50)} AS p50_s, {_rank(_arrived(hours), _P95)} AS p95_s,
    round(max(latency) FILTER (WHERE latency >= 0), 6) AS max_s,
    count(*) FILTER (WHERE latency < 0) AS events_negative_latency"""


add("archive_partitions", """SELECT dt, HH, count(*) AS events, count(*) FILTER (WHERE raim) AS raim
    FROM archive GROUP BY dt, HH""", POSITIONS, ARCHIVE)
add("in_window", f"SELECT dt, HH, count(*) AS events FROM archive WHERE {_hours(24)} GROUP BY dt, HH",
    POSITIONS, ARCHIVE)
add("data_quality", f"""SELECT 168 AS window_hours, count(*) AS events_processed,
    (SELECT count(DISTINCT dt || HH) FROM archive WHERE {_hours(168)}) AS hours_scanned,
    count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS missing_position,
    count(*) FILTER (WHERE sog_knots IS NULL) AS missing_sog,
    count(*) FILTER (WHERE cog_degrees IS NULL) AS missing_cog,
    count(*) FILTER (WHERE latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180)
    AS invalid_coordinates, {_latency(168)} FROM archive WHERE {_arrived(168)}""", POSITIONS, ARCHIVE)
add("latency_stats", f"SELECT {_latency(24)} FROM archive WHERE {_arrived(24)}", POSITIONS, ARCHIVE)
add("latency_ranks", f"""SELECT rank_name, k, round(latency, 6) AS value FROM (SELECT latency,
    row_number() OVER (ORDER BY latency) - 1 AS k, count(*) OVER () AS n FROM archive WHERE latency >= 0)
    JOIN (VALUES ('p50'), ('p95')) r(rank_name)
    ON k = CASE rank_name WHEN 'p50' THEN {_P50} ELSE {_P95} END""", POSITIONS, ARCHIVE)
add("archive_roundtrip", f"""SELECT dt, HH, count(*) AS events, round(sum(latitude), 4) AS latitude_sum
    FROM archive WHERE {_hours(168)} GROUP BY dt, HH""", POSITIONS, ARCHIVE)
add("archive_replay", """SELECT dt, HH, count(*) AS events, count(DISTINCT event_id) AS ids
    FROM archive GROUP BY dt, HH""", POSITIONS, ARCHIVE)
add("archive_expiry", f"""SELECT count(DISTINCT dt) FILTER (WHERE old) AS days_dropped,
    count(*) FILTER (WHERE NOT old) AS events_left, min(dt) FILTER (WHERE NOT old) AS first_day
    FROM (SELECT dt, CAST(dt AS TIMESTAMP) + INTERVAL 1 DAY <= {AS_OF} - INTERVAL 7 DAY AS old FROM archive)""",
    POSITIONS, ARCHIVE)
add("missing_motion", f"""SELECT count(*) FILTER (WHERE sog_knots IS NULL)
    + count(*) FILTER (WHERE cog_degrees IS NULL) AS missing_motion FROM archive WHERE {_arrived(168)}""",
    POSITIONS, ARCHIVE)
add("sample_frames", "SELECT least(100, count(*)) AS frames FROM frames WHERE k <> 9", POSITIONS, _FRAMES)

# ---- Retention ----------------------------------------------------------------------------

_OLD = f"< {AS_OF} - INTERVAL 24 HOUR"
add("mark_stale", "SELECT mmsi, status FROM aged", POSITIONS, STATE, AGED)
add("purge_state", f"SELECT mmsi, last_seen_at FROM state WHERE NOT (last_seen_at {_OLD})",
    POSITIONS, STATE)
add("expire_track", f"SELECT mmsi, event_id, event_time FROM track WHERE NOT (event_time {_OLD})",
    POSITIONS, TRACK)
add("retention_report", f"""SELECT true AS dry_run,
    (SELECT count(*) FROM track WHERE event_time {_OLD}) AS track_aging_count,
    count(*) FILTER (WHERE last_seen_at < {AS_OF} - INTERVAL 45 MINUTE) AS stale_candidates,
    count(*) FILTER (WHERE last_seen_at {_OLD}) AS stale_purge_candidates FROM aged""",
    POSITIONS, STATE, AGED, TRACK)
add("retention_outcome", f"""SELECT false AS dry_run,
    (SELECT count(*) FROM track WHERE event_time {_OLD}) AS track_deleted,
    count(*) FILTER (WHERE last_seen_at < {AS_OF} - INTERVAL 45 MINUTE AND status <> 'STALE') AS stale_marked,
    count(*) FILTER (WHERE last_seen_at {_OLD}) AS stale_purged FROM aged""", POSITIONS, STATE, AGED, TRACK)

# ---- Streams ------------------------------------------------------------------------------

_PUBLISHED = "published AS (SELECT * FROM routed WHERE route = 'publish')"
add("stream_ingest", """SELECT CASE route WHEN 'publish' THEN 'ais.raw' ELSE 'ais.dlq' END AS topic,
    count(*) AS records, count(DISTINCT CASE route WHEN 'publish' THEN mmsi END) AS vessels
    FROM routed WHERE route <> 'skip' GROUP BY 1""", *_INGEST)
add("stream_state", f"""SELECT mmsi, latitude, longitude, sog_knots, {_STATUS} AS status,
    ts AS last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ingested_at DESC) AS rn
    FROM published) WHERE rn = 1""", *_INGEST, _PUBLISHED)
add("stream_track", """SELECT date_trunc('hour', ts) AS partition_hour, count(*) AS points,
    count(DISTINCT mmsi) AS vessels FROM published GROUP BY 1""", *_INGEST, _PUBLISHED)
add("stream_archive", """SELECT strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS HH, count(*) AS events
    FROM published GROUP BY 1, 2""", *_INGEST, _PUBLISHED)
_STATE_POISON = "CASE WHEN n = 6 THEN 'row_build_failed: value' ELSE 'db_insert_failed' END"
add("stream_dlq", f"""SELECT reason, service, count(*) AS records FROM (
    SELECT 'parquet_serialization_failed' AS reason, 'raw_sink' AS service FROM damaged WHERE n IN (1, 2, 6)
    UNION ALL SELECT {_STATE_POISON}, unnest(['stream_processor', 'track_writer']) FROM damaged
    WHERE n IN (1, 2, 4, 6)) GROUP BY ALL""", POSITIONS, _DAMAGED)
add("archive_compaction", f"""SELECT sum(n)::BIGINT AS events, sum(n)::BIGINT AS ids,
    count(*) FILTER (WHERE closed) AS closed_hours, 1 AS most_files FROM (
    SELECT date_trunc('hour', ts) AS h, count(*) AS n,
    date_trunc('hour', ts) + INTERVAL 1 HOUR <= {AS_OF} - INTERVAL 21660 SECOND AS closed FROM events GROUP BY ALL)""")
add("stream_stale", """SELECT mmsi, round(max(arrived), 3) AS silent_since, round(max(arrived) + 2700, 3) AS stale_at, count(*) AS reports
    FROM (SELECT *, sum(begins) OVER (PARTITION BY mmsi ORDER BY arrived) AS session FROM (
      SELECT mmsi, ingested_at AS arrived, CASE WHEN ingested_at - lag(ingested_at) OVER (PARTITION BY mmsi ORDER BY ingested_at)
        <= 2700 THEN 0 ELSE 1 END AS begins FROM positions))
    GROUP BY mmsi, session HAVING max(arrived) + 2700 <= (SELECT max(ingested_at)
      - ceil((max(ingested_at) - min(ingested_at)) / 4) FROM positions)""", POSITIONS)
add("stream_hourly", """SELECT date_trunc('hour', ts) AS partition_hour, count(*) AS events FROM published GROUP BY 1""",
    *_INGEST, _PUBLISHED)
add("stream_counters", """SELECT job, count(*) FILTER (WHERE n <> 7) AS rows, count(*) FILTER (WHERE n IN (1, 2, 6)) AS poisoned,
    CASE job WHEN 'archive' THEN count(*) FILTER (WHERE n NOT IN (1, 2, 6, 7))
             WHEN 'track' THEN count(*) FILTER (WHERE n NOT IN (1, 2, 4, 5, 6, 7)) END AS written,
    true AS stored, true AS all_vessels
    FROM (SELECT seq % 29 AS n, unnest(['archive', 'state', 'track']) AS job FROM positions) GROUP BY job""", POSITIONS)

# ---- The same as SQL ----------------------------------------------------------------------

add("sql_rules", f"""SELECT event_id, {_STATUS} AS status,
    CASE WHEN abs(rate_of_turn) < 127 THEN round(4.733 * sqrt(abs(rate_of_turn)), 1) END AS rot_deg_min,
    CASE WHEN abs(rate_of_turn) >= 127 THEN CASE WHEN rate_of_turn > 0 THEN 'port' ELSE 'starboard' END
         WHEN rate_of_turn > 0 THEN 'starboard' WHEN rate_of_turn IS NOT NULL THEN 'port' END AS direction,
    {_NAV} AS label, {VALID} AS valid, ts AS event_ts,
    CASE WHEN epoch_us(ts) / CAST(1000000 AS DOUBLE) - (ingested_at - 40) > 60 THEN 'future_timestamp'
         WHEN epoch_us(ts) / CAST(1000000 AS DOUBLE) - (ingested_at - 40) < -21600 THEN 'stale_timestamp' END AS reason,
    round(d, 4) AS lambert_m
    FROM {lambert('''(SELECT *, CAST(1.25 AS DOUBLE) AS lat0, CAST(103.65 AS DOUBLE) AS lon0
        FROM positions)''', 'latitude', 'longitude', 'lat0', 'lon0')}""", POSITIONS)
add("sql_nearby", ORACLES["nearby"])
add("sql_vessel_track", ORACLES["vessel_track"])
