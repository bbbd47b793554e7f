"""Per-vessel scalar rules: status, sentinels, turn rate, labels and display text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewake.functions.times import as_column, as_of_column

# ---- Fixed values -------------------------------------------------------------------------
NO_HEADING = 511
NO_RATE_OF_TURN = -128
FRESH_MINUTES = 45
MMSI_PATTERN = "^[0-9]{9}$"

NAV_LABELS = {
    0: "Underway",
    1: "At Anchor",
    2: "Not Under Command",
    3: "Restricted Manoeuverability",
    4: "Constrained by Draught",
    5: "Moored",
    6: "Aground",
    7: "Engaged in Fishing",
    8: "Underway Sailing",
    14: "AIS-SART",
    15: "Undefined",
}
NAV_SHORT_LABELS = {
    0: "Underway",
    1: "At Anchor",
    2: "Not under command",
    3: "Restricted",
    4: "By draught",
    5: "Moored",
    6: "Aground",
    7: "Fishing",
    8: "Sailing",
    14: "AIS-SART",
    15: "Unknown",
}
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
           "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
STATUS_COLORS = {
    "UNDERWAY": "#22c55e",
    "ANCHORED": "#f59e0b",
    "MOORED": "#a855f7",
    "STOPPED": "#ef4444",
    "STALE": "#94a3b8",
    "UNKNOWN": "#64748b",
}
# Turn-rate field: 4.733 * sqrt(rate); 127 and above means "faster than the sensor reads".
ROT_FACTOR = 4.733
ROT_SATURATED = 127
ROT_FAST_DEG_MIN = 10.0
SEVERITY_HIGH_M = 150
SEVERITY_MID_M = 350
# -------------------------------------------------------------------------------------------


def _lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.try_element_at(pairs, key)


def valid_mmsi(mmsi="mmsi") -> Column:
    return as_column(mmsi).rlike(MMSI_PATTERN)


def heading(value) -> Column:
    return F.nullif(as_column(value).cast("double"), F.lit(float(NO_HEADING)))


def rate_of_turn(value) -> Column:
    return F.nullif(as_column(value).cast("double"), F.lit(float(NO_RATE_OF_TURN)))


def derive_status(nav_status="nav_status", sog_knots="sog_knots") -> Column:
    nav = as_column(nav_status)
    sog = F.coalesce(as_column(sog_knots), F.lit(0.0))
    return (F.when(nav == 1, "ANCHORED")
            .when(nav == 5, "MOORED")
            .when((nav == 0) & (sog == 0), "STOPPED")
            .when(nav.isin(0, 8) & (sog > 0), "UNDERWAY")
            .otherwise("UNKNOWN"))


def is_stale(status="status") -> Column:
    return as_column(status).eqNullSafe(F.lit("STALE"))


def decode_rot(value="rate_of_turn", mode: str = "reference") -> Column:
    """STRUCT<rot_deg_min, direction, effective> of the coded rate of turn.

    ``reference`` applies the encoding factor to the coded value, and names the side the other
    way round once the sensor is saturated. ``itu`` inverts the code, (x / 4.733)^2, with one
    sign rule throughout (positive is starboard, zero has no direction).
    """
    value = as_column(value)
    size = F.abs(value)
    saturated = size >= ROT_SATURATED
    fast = F.lit(ROT_FAST_DEG_MIN)
    if mode == "reference":
        rate = F.round(F.lit(ROT_FACTOR) * F.sqrt(size), 1)
        side = (F.when(saturated, F.when(value > 0, "port").otherwise("starboard"))
                .when(value > 0, "starboard").when(value.isNotNull(), "port"))
    elif mode == "itu":
        rate = F.round(F.pow(size / F.lit(ROT_FACTOR), F.lit(2.0)), 1)
        side = F.when(value > 0, "starboard").when(value < 0, "port")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    rate = F.when(~saturated, rate)
    effective = (F.when(value.isNull(), F.lit(0.0)).when(saturated, fast).otherwise(rate))
    return F.struct(rate.alias("rot_deg_min"), side.alias("direction"), effective.alias("effective"))


def nav_label(code="nav_status") -> Column:
    code = as_column(code)
    return F.when(code.isNull(), "Unknown").otherwise(
        F.coalesce(_lookup(NAV_LABELS, code), F.lit("Reserved")))


def nav_short_label(code="nav_status") -> Column:
    code = as_column(code)
    return F.when(code.isNull(), "Unknown").otherwise(
        F.coalesce(_lookup(NAV_SHORT_LABELS, code), F.lit("Reserved")))


def compass_sector(cog="cog_degrees") -> Column:
    """16-point sector of a course; ties go to the even sector, and the last half wraps to north."""
    return F.pmod(F.rint(as_column(cog) / F.lit(22.5)).cast("int"), F.lit(16))


def compass_label(sector) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in COMPASS]), as_column(sector).cast("int") + 1)


def status_color(status="status") -> Column:
    return F.coalesce(_lookup(STATUS_COLORS, as_column(status)), F.lit(STATUS_COLORS["UNKNOWN"]))


def severity(distance_m="distance_m") -> Column:
    d = as_column(distance_m)
    return F.when(d < SEVERITY_HIGH_M, "hi").when(d < SEVERITY_MID_M, "mid").otherwise("low")


def minutes_since(last_seen_at="last_seen_at", as_of=None) -> Column:
    seen = as_column(last_seen_at)
    micros = F.unix_micros(as_of_column(as_of)) - F.unix_micros(seen.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(micros / F.lit(60e6))).cast("long")


def age_bucket(last_seen_at="last_seen_at", as_of=None) -> Column:
    """"now", "N min ago" or "N h ago"; NULL when never seen."""
    seen = as_column(last_seen_at)
    minutes = minutes_since(seen, as_of)
    return F.when(seen.isNotNull(), F.when(minutes < 1, F.lit("now"))
                  .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
                  .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h ago"))))


def distance_text(distance_m="distance_m") -> Column:
    d = as_column(distance_m)
    return (F.when(d < 1000, F.concat(F.floor(d + 0.5).cast("string"), F.lit(" m")))
            .when(d.isNotNull(), F.format_string("%.2f km", d / F.lit(1000.0))))


def display_name(ship_name="ship_name", mmsi="mmsi") -> Column:
    return F.coalesce(F.nullif(as_column(ship_name), F.lit("")),
                      F.concat(F.lit("Vessel "), as_column(mmsi)))


def icon_rotation(cog="cog_degrees", true_heading="true_heading") -> Column:
    return F.coalesce(as_column(cog), as_column(true_heading), F.lit(0.0))
