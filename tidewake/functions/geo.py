"""Points, distances on the WGS84 spheroid, and the grid cells of the proximity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.times import as_column

# ---- Fixed values -------------------------------------------------------------------------
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
MEAN_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111_000
# -------------------------------------------------------------------------------------------

# One degree of latitude is 110 574 m (equator) to 111 694 m (pole); one degree of longitude is
# never longer than 111 320 m. The two bounds below leave room for rounding.
MIN_METRES_PER_LAT_DEGREE = 110_500.0
MAX_METRES_PER_DEGREE = 111_800.0
MIN_CURVATURE_RADIUS_M = 6_335_000.0


def point(lon="longitude", lat="latitude") -> Column:
    return F.struct(as_column(lon).alias("lon"), as_column(lat).alias("lat"))


def planar_degrees(lat1, lon1, lat2, lon2) -> Column:
    dlat = as_column(lat1) - as_column(lat2)
    dlon = as_column(lon1) - as_column(lon2)
    return F.sqrt(dlat * dlat + dlon * dlon)


def reduced_latitude(lat) -> Column:
    """Latitude on the auxiliary sphere, in radians."""
    return F.atan(F.lit(1 - WGS84_F) * F.tan(F.radians(as_column(lat))))


def _half_square(lat1: Column, lat2: Column, dlon: Column) -> Column:
    """sin^2 of half the central angle (haversine); all in radians."""
    a, b = F.sin((lat2 - lat1) / 2), F.sin(dlon / 2)
    return F.least(F.lit(1.0), a * a + F.cos(lat1) * F.cos(lat2) * b * b)


def lambert_m(u1: Column, u2: Column, h: Column) -> Column:
    """Lambert's long-line formula: the spherical arc on reduced latitudes ``u1`` and ``u2`` plus
    the flattening term; ``h`` is sin^2 of half that arc."""
    arc, sine = 2 * F.asin(F.sqrt(h)), 2 * F.sqrt(h * (1 - h))
    sin_p, sin_q = F.sin((u1 + u2) / 2), F.sin((u2 - u1) / 2)
    pp, qq = sin_p * sin_p, sin_q * sin_q
    x = (arc - sine) * pp * (1 - qq) / (1 - h)
    y = (arc + sine) * (1 - pp) * qq / h
    bent = F.lit(WGS84_A) * (arc - F.lit(WGS84_F / 2) * (x + y))
    return F.when(h <= 0, F.lit(0.0)).when(h >= 1, F.lit(WGS84_A) * arc).otherwise(bent)


def geodesic_m(lat1, lon1, lat2, lon2, method: str = "lambert") -> Column:
    """Metres between two points.

    ``lambert`` (default) is closed-form and stays in generated code; ``haversine`` uses the mean
    sphere (up to 0.56 % off).
    """
    lat1, lon1, lat2, lon2 = (as_column(c) for c in (lat1, lon1, lat2, lon2))
    dlon = F.radians(lon2 - lon1)
    if method == "lambert":
        u1, u2 = reduced_latitude(lat1), reduced_latitude(lat2)
        return lambert_m(u1, u2, _half_square(u1, u2, dlon))
    if method == "haversine":
        h = _half_square(F.radians(lat1), F.radians(lat2), dlon)
        return F.lit(2 * MEAN_RADIUS_M) * F.asin(F.sqrt(h))
    raise ValueError(f"unknown method {method!r}")


def with_geodesic(df: DataFrame, name: str, lat1: str, lon1: str, lat2: str, lon2: str,
                  method: str = "lambert") -> DataFrame:
    """``df`` with the distance as a column, in steps so that each sub-term is evaluated once."""
    if method != "lambert":
        return df.withColumn(name, geodesic_m(lat1, lon1, lat2, lon2, method))
    step = df.withColumns({"_u1": reduced_latitude(lat1), "_u2": reduced_latitude(lat2)})
    dlon = F.radians(F.col(lon2) - F.col(lon1))
    step = step.withColumn("_hs", _half_square(F.col("_u1"), F.col("_u2"), dlon))
    return (step.withColumn(name, lambert_m(F.col("_u1"), F.col("_u2"), F.col("_hs")))
            .drop("_u1", "_u2", "_hs"))


# ---- Grid for "within D metres" -----------------------------------------------------------
# Latitude bands at least D high, each cut into equal longitude cells at least as wide as D is
# there. Whatever lies within D of a point is then in the same or a neighbouring band, and in
# the same or a neighbouring cell of that band; cells wrap around the +-180 meridian.

def lat_span_degrees(distance_m: Column) -> Column:
    """Degrees of latitude that certainly cover ``distance_m``."""
    return distance_m / F.lit(MIN_METRES_PER_LAT_DEGREE)


def band_of(lat: Column, height: Column) -> Column:
    return F.floor((lat + 90) / height).cast("long")


def cells_in_band(band: Column, height: Column, distance_m: Column,
                  max_span: Column | None = None) -> Column:
    """How many longitude cells a band has (1, or at least 3, so neighbours never coincide)."""
    edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90)) + height
    shrink = F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-12))
    half = F.sin(distance_m / F.lit(2 * MIN_CURVATURE_RADIUS_M)) / shrink
    span = F.degrees(2 * F.asin(F.least(half, F.lit(1.0)))) * F.lit(1 + 1e-9)
    if max_span is not None:
        span = F.least(span, max_span * F.lit(1 + 1e-9))
    count = F.floor(F.lit(360.0) / span).cast("long")
    return F.when(count < 3, F.lit(1).cast("long")).otherwise(count)


def cell_in_band(lon: Column, count: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * count).cast("long"), count)
