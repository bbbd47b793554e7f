"""Fixture builders shared by the tests."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from tidewake.schemas import EVENT_SCHEMA, STATE_SCHEMA

T0 = datetime(2025, 3, 4, 9, 0)
ARRIVED = T0.replace(tzinfo=timezone.utc).timestamp()
VESSEL = "244010203"
ABSENT = object()


def feed_time(at: datetime) -> str:
    return at.strftime("%Y-%m-%d %H:%M:%S.%f +0000 UTC")


def _present(fields: dict) -> dict:
    return {k: v for k, v in fields.items() if v is not ABSENT}


def meta(mmsi=VESSEL, name="  NOORDSTER ", at=feed_time(T0)) -> dict:
    """A frame's meta data; ``ABSENT`` leaves a key out."""
    return _present({"MMSI": mmsi, "ShipName": name, "time_utc": at})


def position(lat=51.95, lon=4.05, sog=11.5, cog=275.5, heading=511, turn=-128, nav=0, accuracy=1, raim=False) -> dict:
    """A frame's position report; ``ABSENT`` leaves a key out."""
    return _present({"Latitude": lat, "Longitude": lon, "Sog": sog, "Cog": cog, "TrueHeading": heading,
                     "RateOfTurn": turn, "NavigationalStatus": nav, "PositionAccuracy": accuracy, "Raim": raim})


def frame(kind="PositionReport", about=None, report=None, message=None) -> dict:
    """A frame of the given parts, valid ones where none are given."""
    return _present({"MessageType": kind, "MetaData": meta() if about is None else about,
                     "Message": message if message is not None
                     else {"PositionReport": position() if report is None else report}})


def frames_df(spark, frames, received_at=ARRIVED):
    """Frames as (n, value, received_at); ``received_at`` of the base time by default."""
    rows = [(i, f if isinstance(f, str) else json.dumps(f), received_at) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "n int, value string, received_at double")


def event(**values) -> tuple:
    base = {"event_id": "e1", "schema_version": "1.0", "message_type": "PositionReport",
            "mmsi": "200000001", "ship_name": "A", "latitude": 1.0, "longitude": 103.0,
            "sog_knots": 5.0, "cog_degrees": 90.0, "true_heading": 91.0, "rate_of_turn": 0.0,
            "nav_status": 0, "position_accuracy": True, "raim": False,
            "event_time": feed_time(T0), "ingested_at": ARRIVED, "source": "aisstream", "raw": "{}"}
    assert set(values) <= set(base), values
    return tuple({**base, **values}[n] for n in EVENT_SCHEMA.names)


def events_df(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def vessel(mmsi, lat=1.0, lon=103.0, sog=5.0, cog=90.0, nav=0, status="UNDERWAY", seen=T0, rot=None,
           name=None) -> tuple:
    return (mmsi, name, lat, lon, sog, cog, None, rot, nav, (lon, lat), status, seen, seen)


def state_df(spark, rows):
    return spark.createDataFrame(rows, STATE_SCHEMA)


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def minutes(n: float) -> timedelta:
    return timedelta(minutes=n)
