"""Radius search and close pairs.

The joins are equi-joins on grid cells (``functions.geo``). Two exact reductions keep them from
enumerating the pairs of a crowded place when only the closest ones are asked for:

* Of the vessels at one exact position only the first by mmsi can appear in the answer (the
  distances are the same and ties go by mmsi), so each position keeps as many as the answer has
  rows, plus one for pairs.
* A cell with enough vessels proves that enough pairs lie within its diagonal, so nothing farther
  than that needs looking at. The search distance is lowered to the finest grid level that
  proves it; where one level finer there are too few vessels per cell, the crowd is spread thin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions import geo, vessel

# ---- Fixed values -------------------------------------------------------------------------
NEARBY_LIMIT = 100
CONFLICT_LIMIT = 50
CONFLICT_RADIUS_M = 500
CONFLICT_MAX_RADIUS_M = 20000
# -------------------------------------------------------------------------------------------

LEVELS = 9
LEVEL_FACTOR = 4
SIDE = ["mmsi", "ship_name", "latitude", "longitude", "sog_knots", "status"]
MILLIMETRE = 0.001
HALF_WAY_ROUND_M = 20_037_509.0  # nothing is farther away


def _by_distance(distance: str) -> Column:
    """Distances that differ by less than a millimetre are ties."""
    return F.round(F.col(distance), 3)


def _check(name: str, value: float, low: float, high: float, open_low: bool = False) -> None:
    if value is None or not (low < value if open_low else low <= value) or value > high:
        raise ValueError(f"{name} must be {'above' if open_low else 'at least'} {low}"
                         f" and at most {high}, got {value}")


def _first_per_position(rows: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` rows per exact position, lowest mmsi first (limited before the shuffle)."""
    w = W.partitionBy("latitude", "longitude").orderBy("mmsi")
    return rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= keep).drop("_at")


def _level_cells(top_side: float) -> Column:
    """A row's (level, x, y) on square grids of ``top_side`` degrees and finer."""
    return F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"),
                 F.floor(F.col("latitude") / F.lit(top_side / LEVEL_FACTOR**k)).alias("x"),
                 F.floor(F.col("longitude") / F.lit(top_side / LEVEL_FACTOR**k)).alias("y"))
        for k in range(LEVELS)]))


def _diagonal_m(level: Column, top_side: float) -> Column:
    """No two points of a cell of this level are farther apart than this."""
    widest = top_side * 2**0.5 * geo.MAX_METRES_PER_DEGREE
    return F.lit(widest) / F.pow(F.lit(float(LEVEL_FACTOR)), level) + F.lit(2 * MILLIMETRE)


def search_distance(rows: DataFrame, reach_m: float, top_side: float, pairs: int) -> DataFrame:
    """One row: a distance within which at least ``pairs`` qualifying pairs lie, at most ``reach_m``."""
    cells = rows.select(_level_cells(top_side).alias("c")).select("c.*")
    full = cells.groupBy("level", "x", "y").agg(F.count("*").cast("double").alias("n"))
    proven = full.groupBy("level").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    finest = F.max(F.when(F.col("p") >= pairs, F.col("level")))
    return proven.agg(F.coalesce(F.least(_diagonal_m(finest, top_side), F.lit(float(reach_m))),
                                 F.lit(float(reach_m))).alias("distance"))


def conflicts(state: DataFrame, radius_m: float = CONFLICT_RADIUS_M, limit: int = CONFLICT_LIMIT,
              mode: str = "planar", method: str = "lambert") -> DataFrame:
    """The closest pairs of valid vessels: ``a`` and ``b`` (a.mmsi < b.mmsi) and ``distance_m``.

    ``planar`` keeps pairs whose distance in plain degrees is within ``radius_m`` / 111 km, so the
    reach shrinks east-west with latitude and stops at the +-180 meridian. ``geodesic`` keeps
    pairs within ``radius_m`` metres, across the meridian too.
    """
    _check("radius_m", radius_m, 0, CONFLICT_MAX_RADIUS_M, open_low=True)
    _check("limit", limit, 1, float("inf"))
    margin = radius_m / geo.METRES_PER_DEGREE
    if mode == "planar":
        reach, top_side = margin * geo.MAX_METRES_PER_DEGREE, margin / 2
        max_span = F.lit(margin)
    elif mode == "geodesic":
        reach, max_span = float(radius_m), None
        top_side = radius_m / geo.MAX_METRES_PER_DEGREE / 2
    else:
        raise ValueError(f"unknown mode {mode!r}")

    placed = state.filter(vessel.valid_mmsi() & F.col("latitude").isNotNull()
                          & F.col("longitude").isNotNull()).select(*SIDE)
    rows = _first_per_position(placed, limit + 1)
    rows = rows.withColumn("_d", search_distance(rows, reach, top_side, limit).scalar())
    rows = rows.withColumn("_h", geo.lat_span_degrees(F.col("_d")))
    rows = rows.withColumn("_band", geo.band_of(F.col("latitude"), F.col("_h")))

    def cells(band: Column) -> Column:
        return geo.cells_in_band(band, F.col("_h"), F.col("_d"), max_span)

    def cell(band: Column) -> Column:
        return geo.cell_in_band(F.col("longitude"), cells(band))

    # A pair is met once: from the lower band, or in the same band from the western cell.
    here, above = F.col("_band"), F.col("_band") + 1
    rows = rows.withColumns({"_n": cells(here), "_n_above": cells(above)})
    rows = rows.withColumns({"_cell": geo.cell_in_band(F.col("longitude"), F.col("_n")),
                             "_cell_above": geo.cell_in_band(F.col("longitude"), F.col("_n_above"))})
    east = F.pmod(F.col("_cell") + 1, F.col("_n"))
    probes = [F.struct(here.alias("band"), F.col("_cell").alias("cell"), F.lit(True).alias("same")),
              F.struct(here.alias("band"), F.when(F.col("_n") > 1, east).alias("cell"),
                       F.lit(False).alias("same"))]
    probes += [F.struct(above.alias("band"), F.pmod(F.col("_cell_above") + d, F.col("_n_above")).alias("cell"),
                        F.lit(False).alias("same")) for d in (-1, 0, 1)]
    p = (rows.select(*[F.col(c).alias("p_" + c) for c in SIDE], "_h",
                     F.explode(F.array_distinct(F.array(*probes))).alias("_c"))
         .select(*["p_" + c for c in SIDE], "_h", "_c.*").filter("cell IS NOT NULL"))
    q = rows.select(*[F.col(c).alias("q_" + c) for c in SIDE], F.col("_band").alias("band"),
                    F.col("_cell").alias("cell"))
    dlat = F.abs(F.col("p_latitude") - F.col("q_latitude"))
    dlon = F.abs(F.col("p_longitude") - F.col("q_longitude"))
    near = (~F.col("same") | (F.col("p_mmsi") < F.col("q_mmsi"))) & (dlat <= F.col("_h"))
    if mode == "planar":
        near = (near & (dlat < margin) & (dlon < margin)
                & (F.sqrt(dlat * dlat + dlon * dlon) <= margin))
    pairs = geo.with_geodesic(p.join(q, ["band", "cell"]).filter(near), "distance_m", "p_latitude",
                              "p_longitude", "q_latitude", "q_longitude", method)
    # Whatever the grid let through beyond the search distance sorts behind the answer.
    first, second = F.least("p_mmsi", "q_mmsi"), F.greatest("p_mmsi", "q_mmsi")
    top = pairs.orderBy(_by_distance("distance_m"), first, second).limit(limit)
    if mode == "geodesic":
        top = top.filter(_by_distance("distance_m") <= radius_m)
    one = F.struct(*[F.col("p_" + c).alias(c) for c in SIDE])
    two = F.struct(*[F.col("q_" + c).alias(c) for c in SIDE])
    ordered = F.col("p_mmsi") < F.col("q_mmsi")
    return top.select(F.when(ordered, one).otherwise(two).alias("a"),
                      F.when(ordered, two).otherwise(one).alias("b"), "distance_m")


def nearby(state: DataFrame, lat: float, lon: float, radius_m: float,
           limit: int = NEARBY_LIMIT, method: str = "lambert") -> DataFrame:
    """Vessels within ``radius_m`` metres of a point, closest first.

    The box of plain comparisons in front of the distance reaches the Parquet scan.
    """
    _check("lat", lat, -90, 90)
    _check("lon", lon, -180, 180)
    _check("radius_m", radius_m, 0, float("inf"), open_low=True)
    dlat = radius_m / geo.MIN_METRES_PER_LAT_DEGREE
    box = F.col("latitude").between(lat - dlat, lat + dlat)
    dlon = _longitude_reach(lat, dlat, radius_m)
    if -180 <= lon - dlon and lon + dlon <= 180:
        box = box & F.col("longitude").between(lon - dlon, lon + dlon)
    rows = state.filter(box).select(*SIDE, F.lit(float(lat)).alias("_lat"), F.lit(float(lon)).alias("_lon"))
    measured = geo.with_geodesic(rows, "distance_m", "latitude", "longitude", "_lat", "_lon", method)
    # Vessels beyond the radius sort last, so they can be cut off after the limit.
    return (measured.select(*SIDE, "distance_m").orderBy(_by_distance("distance_m"), "mmsi")
            .limit(limit).filter(_by_distance("distance_m") <= radius_m))


def _longitude_reach(lat: float, dlat: float, radius_m: float) -> float:
    """Degrees of longitude that certainly cover the radius; 360 when a pole is in reach."""
    from math import asin, cos, degrees, radians, sin

    edge = abs(lat) + dlat
    if edge >= 90 or radius_m > 5_000_000:
        return 360.0
    ratio = sin(radius_m / (2 * geo.MIN_CURVATURE_RADIUS_M)) / cos(radians(edge))
    return 360.0 if ratio >= 1 else degrees(2 * asin(ratio)) * (1 + 1e-9)


def search_reach(points: DataFrame, rows: DataFrame, radius_m: float, limit: int) -> DataFrame:
    """``points`` with ``level`` and ``_d``: a distance within which ``limit`` vessels of ``rows`` certainly lie, or the radius.

    A grid cell that holds ``limit`` vessels proves its diagonal to points inside it, and twice that to points in
    the cells around it, so a point beside a crowd looks no farther than the crowd's edge. ``level`` numbers the distances.
    """
    top_side = radius_m / geo.MAX_METRES_PER_DEGREE / 2
    crowded = (rows.select(_level_cells(top_side).alias("c")).groupBy("c")
               .agg(F.count("*").alias("n")).filter(F.col("n") >= limit).select("c.*"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = crowded.withColumn("s", F.explode(steps))
    own = (F.col("s.i") == 0) & (F.col("s.j") == 0)
    marked = around.groupBy("level", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y")).agg(
        F.min(F.when(own, 1).otherwise(2)).alias("times"))
    cells = points.select("point_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).select(
        "point_id", _level_cells(top_side).alias("c")).select("point_id", "c.*")
    reach = F.col("times") * _diagonal_m(F.col("level"), top_side)
    best = (cells.join(marked, ["level", "x", "y"]).groupBy("point_id")
            .agg(F.min(F.struct(reach.alias("d"), (F.col("level") * 2 + F.col("times")).alias("level"))).alias("b")))
    radius = F.lit(float(radius_m))
    return (points.join(best, "point_id", "left")
            .withColumn("level", F.when(F.col("b.d") < radius, F.col("b.level")).otherwise(0).cast("int"))
            .withColumn("_d", F.when(F.col("level") > 0, F.col("b.d")).otherwise(radius)).drop("b"))


def nearby_many(points: DataFrame, state: DataFrame, radius_m: float,
                limit: int = NEARBY_LIMIT, method: str = "lambert") -> DataFrame:
    """``nearby`` for a table of points ``(point_id, lat, lon)``: the closest ``limit`` each.

    Each exact position is searched once, however many points (reports of a moored vessel, say) share it, and the points take its
    answer.
    """
    _check("radius_m", radius_m, 0, float("inf"), open_low=True)
    _check("limit", limit, 1, float("inf"))
    places = points.select(F.struct("lat", "lon").alias("point_id"), "lat", "lon").distinct()
    found = _nearby_places(places, state, min(float(radius_m), HALF_WAY_ROUND_M), limit, method)
    found = found.select(F.col("point_id.lat").alias("lat"), F.col("point_id.lon").alias("lon"),
                         *[c for c in found.columns if c != "point_id"])
    return points.select("point_id", "lat", "lon").join(found, ["lat", "lon"]).drop("lat", "lon")


def _nearby_places(points: DataFrame, state: DataFrame, radius_m: float, limit: int, method: str) -> DataFrame:
    """The same by a grid join for points that differ in their positions.

    Points with the same search distance (``search_reach``) share a grid, which is why the level is
    part of the join key.
    """
    placed = state.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(*SIDE)
    rows = _first_per_position(placed, limit)
    asked = search_reach(points.select("point_id", "lat", "lon"), rows, radius_m, limit)
    asked = asked.withColumn("_h", geo.lat_span_degrees(F.col("_d")))
    used = asked.agg(F.collect_set(F.struct("level", "_d", "_h"))).scalar()

    def cells(band: Column) -> Column:
        return geo.cells_in_band(band, F.col("_h"), F.col("_d"))

    asked = asked.withColumn("_band", geo.band_of(F.col("lat"), F.col("_h")))
    asked = asked.withColumns({f"_n{i}": cells(F.col("_band") + (i - 1)) for i in range(3)})
    asked = asked.withColumns({f"_c{i}": geo.cell_in_band(F.col("lon"), F.col(f"_n{i}")) for i in range(3)})
    probes = [F.struct((F.col("_band") + (i - 1)).alias("band"),
                       F.pmod(F.col(f"_c{i}") + d, F.col(f"_n{i}")).alias("cell"))
              for i in range(3) for d in (-1, 0, 1)]
    p = asked.select("point_id", "lat", "lon", "_h", "level",
                     F.explode(F.array_distinct(F.array(*probes))).alias("_c")).select(
        "point_id", "lat", "lon", F.col("_h").alias("_reach"), "level", "_c.*")
    # Every vessel appears once per search distance in use: one per level at most.
    grid = (rows.withColumn("_used", used).select(*SIDE, F.explode("_used").alias("_u"))
            .select(*SIDE, "_u.*"))
    grid = grid.withColumn("band", geo.band_of(F.col("latitude"), F.col("_h")))
    grid = grid.withColumn("_n", cells(F.col("band")))
    q = grid.select(*SIDE, "level", "band", geo.cell_in_band(F.col("longitude"), F.col("_n")).alias("cell"))
    near = F.abs(F.col("latitude") - F.col("lat")) <= F.col("_reach")
    pairs = geo.with_geodesic(p.join(q, ["level", "band", "cell"]).filter(near), "distance_m",
                              "latitude", "longitude", "lat", "lon", method)
    w = W.partitionBy("point_id").orderBy(_by_distance("distance_m"), "mmsi")
    return (pairs.select("point_id", *SIDE, "distance_m")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .filter(_by_distance("distance_m") <= radius_m))


def with_severity(pairs: DataFrame) -> DataFrame:
    """Pairs with the display columns of the conflict table."""
    return pairs.select("*", vessel.severity("distance_m").alias("severity"),
                        vessel.distance_text("distance_m").alias("distance_text"))

