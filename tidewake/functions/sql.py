"""The rules and two endpoints as temporary SQL functions, made from the same Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import geo, times, vessel

_ROT = "STRUCT<rot_deg_min: DOUBLE, direction: STRING, effective: DOUBLE>"
_POINTS = ("lat1 DOUBLE", "lon1 DOUBLE", "lat2 DOUBLE", "lon2 DOUBLE")


def _scalars() -> dict[str, tuple[tuple[str, ...], str, Column]]:
    """name: (parameters, result type, expression over columns named like the parameters)."""
    return {
        "vessel_status": (("nav_status INT", "sog_knots DOUBLE"), "STRING", vessel.derive_status()),
        "vessel_heading": (("heading DOUBLE",), "DOUBLE", vessel.heading("heading")),
        "vessel_turn_rate": (("turn DOUBLE",), "DOUBLE", vessel.rate_of_turn("turn")),
        "decode_turn": (("rate_of_turn DOUBLE",), _ROT, vessel.decode_rot()),
        "nav_label": (("nav_status INT",), "STRING", vessel.nav_label()),
        "compass_point": (("cog DOUBLE",), "STRING", vessel.compass_label(vessel.compass_sector("cog"))),
        "valid_mmsi": (("mmsi STRING",), "BOOLEAN", vessel.valid_mmsi()),
        "event_instant": (("event_time STRING",), "TIMESTAMP", times.parse_event_time("event_time")),
        "skew_reason": (("event_ts TIMESTAMP", "ingested_at DOUBLE"), "STRING", times.classify_skew("event_ts", "ingested_at")),
        "distance_metres": (_POINTS, "DOUBLE", geo.geodesic_m("lat1", "lon1", "lat2", "lon2")),
        "conflict_severity": (("distance_m DOUBLE",), "STRING", vessel.severity()),
    }


def body(spark: SparkSession, parameters: tuple[str, ...], expression: Column) -> str:
    """SQL text of an expression over columns named like the parameters."""
    names = [p.split(" ", 1) for p in parameters]
    typed = spark.range(1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in names])
    return typed.select(expression.alias("v"))._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession, state: str | None = None, track: str | None = None) -> list[str]:
    """Create the functions in this session and return their names.

    ``state`` and ``track`` name views with a state and a track table. With them come the table functions
    ``vessels_nearby(lat, lon, radius_m)`` and ``vessel_track(vessel, as_of, hours)``.
    """
    names = []
    for name, (parameters, result, expression) in _scalars().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(parameters)}) RETURNS {result} "
                  f"RETURN {body(spark, parameters, expression)}")
        names.append(name)
    if state:
        reach = f"radius_m / {geo.MIN_METRES_PER_LAT_DEGREE}"
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION vessels_nearby(lat DOUBLE, lon DOUBLE, radius_m DOUBLE)
            RETURNS TABLE(mmsi STRING, ship_name STRING, latitude DOUBLE, longitude DOUBLE, sog_knots DOUBLE, status STRING,
                distance_m DOUBLE)
            RETURN SELECT * FROM (SELECT mmsi, ship_name, latitude, longitude, sog_knots, status,
                distance_metres(latitude, longitude, vessels_nearby.lat, vessels_nearby.lon) AS distance_m
              FROM {state} WHERE latitude BETWEEN vessels_nearby.lat - {reach} AND vessels_nearby.lat + {reach})
            WHERE round(distance_m, 3) <= radius_m ORDER BY round(distance_m, 3), mmsi LIMIT 100""")
        names.append("vessels_nearby")
    if track:
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION vessel_track(vessel STRING, as_of TIMESTAMP, hours INT)
            RETURNS TABLE(event_time TIMESTAMP, latitude DOUBLE, longitude DOUBLE, sog_knots DOUBLE)
            RETURN SELECT event_time, latitude, longitude, sog_knots FROM {track}
            WHERE mmsi = vessel_track.vessel
              AND partition_hour >= date_trunc('HOUR', vessel_track.as_of - make_interval(0, 0, 0, 0, vessel_track.hours))
              AND event_time > vessel_track.as_of - make_interval(0, 0, 0, 0, vessel_track.hours)
            ORDER BY event_time, event_id""")
        names.append("vessel_track")
    return names
