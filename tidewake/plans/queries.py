"""Every registered query: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

All of them work on whole tables: positions, frames or a fleet derived from ``events`` (see
``sources.events``), so their work grows with the data.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake import session
from tidewake.functions import frames as fr
from tidewake.functions import geo, sql, times, vessel
from tidewake.operators import fleet as fl
from tidewake.operators import ingest as ing
from tidewake.operators import presentation as pr
from tidewake.operators import proximity as px
from tidewake.operators import quality as ql
from tidewake.operators import retention
from tidewake.operators import state as st
from tidewake.operators import track as tr
from tidewake.schemas import EVENT_SCHEMA
from tidewake.session import stored
from tidewake.sources import archive as ar
from tidewake.sources import events as ev
from tidewake.sources import frames as fs
from tidewake.sources import log, tables
from tidewake.streaming import jobs

SEQ = ("seq",)
SILENT_MINUTES = 720
WINDOW_HOURS = 168
VESSEL = "200000007"
SPLIT = "2024-01-16 00:00:00"
HARBOUR = (1.25, 103.65)
PORT_BOXES = [[[1.2, 103.6], [1.25, 103.66]], [[1.30, 103.72], [1.26, 103.68]]]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.prepare(spark)
        return fn(Tables(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


class Tables:
    """The derived tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @property
    def as_of(self) -> Column:
        return ev.as_of(self.spark, self.dir)

    @property
    def positions(self) -> DataFrame:
        return ev.positions(self.spark, self.dir)

    @property
    def frames(self) -> DataFrame:
        return ev.frames(self.spark, self.dir)

    @property
    def state(self) -> DataFrame:
        return st.current_state(self.positions, self.as_of, arrival=SEQ)

    @property
    def fleet(self) -> DataFrame:
        return st.current_state(ev.fleet(self.spark, self.dir), self.as_of, arrival=SEQ)

    @property
    def aged(self) -> DataFrame:
        """State with vessels marked STALE after half a day."""
        return st.mark_stale(self.state, self.as_of, SILENT_MINUTES)

    @property
    def track_rows(self) -> DataFrame:
        return st.build_track_rows(self.positions, self.as_of, arrival=SEQ)

    @property
    def track(self) -> DataFrame:
        return tr.dedup_track(self.track_rows)

    @property
    def archive(self) -> DataFrame:
        """Archive rows with the folder names ``dt`` and ``HH``."""
        return ar.archive_rows(self.positions, self.as_of).drop("raw")

    @property
    def last(self):
        """The last event's instant, as a value."""
        return self.spark.read.parquet(f"{self.dir}/events.parquet").agg(
            F.max("ts").cast("timestamp")).first()[0]

    def written_archive(self, window_hours: int | None = None) -> DataFrame:
        """The archive written to the shared folder and read back, with the file of every row."""
        path = session.scratch(self.spark, "archive")
        ar.write_archive(self.positions, path, self.as_of)
        return ar.read_archive(self.spark, path, self.last, window_hours, files=True)


def _six(df: DataFrame, *columns: str) -> DataFrame:
    """Round computed doubles, whose last digits depend on the order of summing."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _flat_point(df: DataFrame) -> DataFrame:
    return df.drop("position")


# ---- Sources and scalar rules -------------------------------------------------------------

@query
def positions(t: Tables) -> DataFrame:
    return t.positions.select(*[c for c in EVENT_SCHEMA.names if c != "raw"])


@query
def filter_subscription(t: Tables) -> DataFrame:
    return fs.filter_subscription(t.positions, PORT_BOXES).select(
        "event_id", "mmsi", "latitude", "longitude")


@query
def valid_mmsi(t: Tables) -> DataFrame:
    return t.positions.groupBy(vessel.valid_mmsi().alias("valid")).agg(
        F.count("*").alias("events"), F.count_distinct("mmsi").alias("vessels"))


@query
def derive_status(t: Tables) -> DataFrame:
    return t.positions.select("event_id", vessel.derive_status().alias("status"))


@query
def decode_rot(t: Tables) -> DataFrame:
    return t.positions.select("event_id", vessel.decode_rot().alias("r"),
                              vessel.decode_rot(mode="itu").alias("i")).select(
        "event_id", "r.rot_deg_min", "r.direction", "r.effective",
        F.col("i.rot_deg_min").alias("itu_deg_min"), F.col("i.direction").alias("itu_direction"))


@query
def nav_labels(t: Tables) -> DataFrame:
    return t.positions.groupBy("nav_status", vessel.nav_label().alias("label"),
                               vessel.nav_short_label().alias("short_label")).agg(
        F.count("*").alias("count"))


@query
def geodesic_distance(t: Tables) -> DataFrame:
    """Distance of every report from the harbour, on the spheroid and on the sphere."""
    df = t.positions.select("event_id", "latitude", "longitude", F.lit(HARBOUR[0]).alias("lat0"),
                            F.lit(HARBOUR[1]).alias("lon0"))
    df = geo.with_geodesic(df, "lambert_m", "latitude", "longitude", "lat0", "lon0")
    sphere = geo.geodesic_m("latitude", "longitude", "lat0", "lon0", "haversine")
    planar = geo.planar_degrees("latitude", "longitude", "lat0", "lon0")
    return df.select("event_id", F.round("lambert_m", 4).alias("lambert_m"),
                     F.round(sphere, 4).alias("haversine_m"), F.round(planar, 9).alias("planar_deg"))


# ---- Ingest -------------------------------------------------------------------------------

@query
def validate_frames(t: Tables) -> DataFrame:
    return ing.validate(t.frames).select("event_id", F.col("valid"),
                                    F.concat_ws("; ", "errors").alias("errors"))


@query
def read_frames(t: Tables) -> DataFrame:
    """Frames that are JSON, by message type; other text is ignored."""
    frames = fs.frames_from_text(t.frames)
    kind = fr.as_string_only(fr.field(F.col("frame"), "$.MessageType"))
    return frames.groupBy(kind.alias("message_type")).agg(
        F.count("*").alias("frames"), F.round(F.min("received_at"), 3).alias("first_arrival"),
        F.round(F.max("received_at"), 3).alias("last_arrival"))


@query
def position_reports(t: Tables) -> DataFrame:
    return ing.position_reports(t.frames).select("event_id")


@query
def skew_gate(t: Tables) -> DataFrame:
    """Skew reason and latency of every frame's time text."""
    fields = fr.with_fields(t.frames)
    return fields.select("event_id", F.col("_event_ts").alias("event_ts"),
                         times.classify_skew("_event_ts", "received_at").alias("reason"),
                         times.latency_ms("_event_ts", "received_at").alias("latency_ms"))


@query
def normalize_frames(t: Tables) -> DataFrame:
    """Canonical columns, and what the kept raw frame says."""
    routed = ing.ingest(t.frames.select("value", "received_at"))
    frame = F.try_parse_json("raw")
    return ing.published(routed).select(
        *[c for c in EVENT_SCHEMA.names if c not in ("event_id", "raw")],
        fr.as_text(fr.field(frame, "$.MetaData.MMSI")).alias("raw_mmsi"),
        fr.as_double(fr.field(frame, "$.Message.PositionReport.Latitude")).alias("raw_latitude"),
        fr.as_double(fr.field(frame, "$._received_at")).alias("raw_received_at"))


@query
def ingest_routes(t: Tables) -> DataFrame:
    return ing.ingest(t.frames).groupBy("_route", "_reason").agg(F.count("*").alias("frames")).select(
        F.col("_route").alias("route"), F.col("_reason").alias("reason"), "frames")


@query
def ingest_records(t: Tables) -> DataFrame:
    """Records per topic with what their JSON says, decoded again from the text."""
    records = ing.ingest_records(ing.ingest(t.frames))
    v = F.try_parse_json("value")
    return records.select("topic", F.col("key").isNotNull().alias("keyed"),
                          F.try_variant_get(v, "$._dlq_reason", "string").alias("reason"),
                          F.try_variant_get(v, "$._dlq_source", "string").alias("service"),
                          F.coalesce(F.try_variant_get(v, "$.mmsi", "string"),
                                     F.try_variant_get(v, "$.event.mmsi", "string")).alias("mmsi")
                          ).groupBy("topic", "keyed", "reason", "service").agg(
        F.count("*").alias("records"), F.count_distinct("mmsi").alias("vessels"))


@query
def event_id(t: Tables) -> DataFrame:
    """Facts about ids: one per frame and arrival, 32 hex digits, the content's own without the arrival."""
    frames = t.frames.select("received_at", F.try_parse_json("value").alias("frame"),
                             F.try_parse_json(fr.stamped_text("value", "received_at")).alias("stamped"))
    ids = frames.filter("frame IS NOT NULL").select(
        ing.event_id("frame", "received_at").alias("id"),
        ing.event_id("frame", F.col("received_at") + 1).alias("later"),
        ing.event_id("frame").alias("content"), ing.event_id("stamped").alias("stamped"))
    hex_digits = F.lit("^[0-9a-f]{32}$")
    return ids.agg(F.count("*").alias("frames"), F.count_distinct("id").alias("ids"),
                   F.count_if(F.rlike("id", hex_digits) & F.rlike("content", hex_digits)).alias("well_formed"),
                   F.count_if(F.col("id") != F.col("later")).alias("by_arrival"),
                   F.count_if(F.col("content") == F.col("stamped")).alias("by_content"))


def _damaged_log(t: Tables) -> DataFrame:
    """Log records of every report, with one field broken in some."""
    n = F.col("seq") % 29
    value = log.event_json()
    broken = (F.when(n == 1, F.regexp_replace(value, '"latitude":[^,]+', '"latitude":"north"'))
              .when(n == 2, F.regexp_replace(value, '"nav_status":[^,]+', '"nav_status":"x"'))
              .when(n == 3, F.regexp_replace(value, '"sog_knots":[^,]+', '"sog_knots":"12.5"'))
              .when(n == 4, F.regexp_replace(value, '"event_id":"[^"]+"', '"event_id":null'))
              .when(n == 5, F.regexp_replace(value, '"longitude":[^,]+', '"longitude":null'))
              .when(n == 6, F.lit("{broken")).when(n == 7, F.lit(None)).otherwise(value))
    return fr.evaluated_once(t.positions).select(F.col("mmsi").alias("key"), broken.alias("value"))


@query
def decode_log(t: Tables) -> DataFrame:
    decoded = log.decode_events(_damaged_log(t))
    return decoded.groupBy(F.concat_ws(",", "_bad").alias("bad")).agg(
        F.count("*").alias("records"), F.count("event_id").alias("with_id"),
        F.count("latitude").alias("with_latitude"), F.count("longitude").alias("with_longitude"),
        F.count("sog_knots").alias("with_speed"), F.count("nav_status").alias("with_nav"))


@query
def split_poison(t: Tables) -> DataFrame:
    """Rows each sink takes and the reasons for those it cannot."""
    decoded = log.decode_events(_damaged_log(t))
    parts = []
    for target in ("archive", "state"):
        reason = ing.poison_reason(target)
        parts.append(decoded.groupBy(reason.alias("reason")).agg(F.count("*").alias("records"))
                     .select(F.lit(target).alias("target"), "reason", "records"))
    return parts[0].unionByName(parts[1])


@query
def dlq_records(t: Tables) -> DataFrame:
    decoded = log.decode_events(_damaged_log(t))
    _, bad = ing.split_poison(decoded, "state")
    return log.to_dlq_records(bad).select(
        "topic", F.get_json_object("value", "$._dlq_reason").alias("reason"),
        F.get_json_object("value", "$._dlq_source").alias("service"),
        F.get_json_object("value", "$.event.mmsi").alias("mmsi"))


# ---- State and track ----------------------------------------------------------------------

@query
def latest_state(t: Tables) -> DataFrame:
    return _flat_point(t.state)


@query
def latest_state_by_event_time(t: Tables) -> DataFrame:
    rows = st.current_state(t.positions, t.as_of, "event_time", SEQ)
    return rows.select("mmsi", "latitude", "longitude", "status", "last_seen_at")


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    at = times.parse_event_time("event_time")
    limit = F.lit(SPLIT).cast("timestamp")
    return t.positions.filter(at < limit), t.positions.filter(at >= limit)


@query
def upsert_state(t: Tables) -> DataFrame:
    """State of the first half month, then the second half applied as a batch."""
    first, second = _halves(t)
    stored = st.current_state(first, F.lit(SPLIT).cast("timestamp"), arrival=SEQ)
    return _flat_point(st.upsert_state(stored, st.build_state_rows(second, t.as_of, SEQ)))


@query
def list_vessels(t: Tables) -> DataFrame:
    return st.list_vessels(t.state)


@query
def vessel_detail(t: Tables) -> DataFrame:
    return st.vessel_detail(t.state, VESSEL)


@query
def build_track(t: Tables) -> DataFrame:
    return t.track_rows.select("mmsi", "event_id", "latitude", "longitude", "sog_knots", "event_time",
                               "partition_hour", "position.lon", "position.lat")


@query
def dedup_track(t: Tables) -> DataFrame:
    """Every report delivered twice, the second time with a changed speed: the first one stays."""
    again = t.track_rows.withColumns({
        "sog_knots": F.lit(99.0),
        "_arrival": F.struct((F.col("_arrival.seq") + 1_000_000_000_000).alias("seq"))})
    return tr.dedup_track(t.track_rows.unionByName(again)).select("mmsi", "event_id", "sog_knots")


@query
def append_track(t: Tables) -> DataFrame:
    """New rows of a delivery of everything, when the first half is already stored."""
    first, _ = _halves(t)
    stored = tr.dedup_track(st.build_track_rows(first, t.as_of, SEQ))
    return tr.append_track(stored, t.track_rows).select("mmsi", "event_id", "event_time")


@query
def vessel_track(t: Tables) -> DataFrame:
    return tr.vessel_track(t.track, VESSEL, t.as_of, WINDOW_HOURS)


@query
def track_points(t: Tables) -> DataFrame:
    return tr.track_points(t.track)


@query
def hourly_counts(t: Tables) -> DataFrame:
    return tr.hourly_counts(t.track)


@query
def track_linestring(t: Tables) -> DataFrame:
    """A line per vessel and event hour."""
    return tr.track_linestring(t.track_rows)


@query
def geojson_features(t: Tables) -> DataFrame:
    """Features read back from their text."""
    rows = pr.to_geojson_features(t.aged, False, VESSEL)

    def part(path: str) -> Column:
        return F.get_json_object("feature", path)

    return rows.select("mmsi", part("$.geometry.type").alias("geometry"),
                       part("$.geometry.coordinates[0]").cast("double").alias("lon"),
                       part("$.geometry.coordinates[1]").cast("double").alias("lat"),
                       part("$.properties.status").alias("status"),
                       part("$.properties.selected").alias("selected"))


# ---- Fleet reports ------------------------------------------------------------------------

@query
def fleet_kpis(t: Tables) -> DataFrame:
    return _six(fl.fleet_kpis(t.aged, t.as_of), "avg_sog")


@query
def events_window(t: Tables) -> DataFrame:
    return fl.events_window(t.track, t.as_of)


@query
def status_counts(t: Tables) -> DataFrame:
    return fl.status_counts(t.aged)


@query
def fastest_vessel(t: Tables) -> DataFrame:
    return fl.fastest_vessel(t.state)


@query
def fleet_summary(t: Tables) -> DataFrame:
    row = fl.fleet_summary(stored(t.aged), t.track, t.as_of)
    return _six(row.select("*", F.col("fastest.mmsi").alias("fastest_mmsi"),
                           F.col("fastest.sog_knots").alias("fastest_sog"),
                           F.to_json("by_status").alias("status_list"))
                .drop("fastest", "by_status"), "avg_sog")


@query
def speed_histogram(t: Tables) -> DataFrame:
    return fl.speed_histogram(t.state)


@query
def speed_stats(t: Tables) -> DataFrame:
    return _six(fl.speed_stats(stored(t.state)), "avg_sog", "p50_sog")


@query
def speed_distribution(t: Tables) -> DataFrame:
    row = fl.speed_distribution(stored(t.fleet))
    return _six(row.withColumn("buckets", F.to_json("buckets", {"ignoreNullFields": "false"})),
                "avg_sog", "p50_sog")


@query
def nav_distribution(t: Tables) -> DataFrame:
    return fl.nav_distribution(t.state)


@query
def nav_report(t: Tables) -> DataFrame:
    return fl.nav_report(t.fleet).select(
        F.to_json("buckets", {"ignoreNullFields": "false"}).alias("buckets"), "total")


@query
def flow_rose(t: Tables) -> DataFrame:
    return _six(fl.flow_rose(t.aged), "avg_sog")


@query
def flow_dense(t: Tables) -> DataFrame:
    return _six(pr.dense_sectors(t.spark, fl.flow_rose(t.aged)), "avg_sog")


@query
def maneuvering(t: Tables) -> DataFrame:
    return fl.maneuvering(t.state)


@query
def cumulative_share(t: Tables) -> DataFrame:
    return _six(pr.cumulative_share(fl.nav_distribution(t.state)), "start_angle", "end_angle")


@query
def share_of_max(t: Tables) -> DataFrame:
    bars = fl.status_counts(t.aged)
    return _six(pr.share_of_max(bars), "share")


@query
def visible_count(t: Tables) -> DataFrame:
    return pr.visible_count(t.aged, show_stale=False)


@query
def age_buckets(t: Tables) -> DataFrame:
    return t.state.select("mmsi", vessel.age_bucket("last_seen_at", t.as_of).alias("age"))


@query
def map_symbols(t: Tables) -> DataFrame:
    return pr.map_symbols(t.aged)


# ---- Proximity ----------------------------------------------------------------------------

def _pair_columns(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(F.col("a.mmsi").alias("a_mmsi"), F.col("b.mmsi").alias("b_mmsi"),
                     F.round("distance_m", 3).alias("distance_m"), *extra)


@query
def nearby(t: Tables) -> DataFrame:
    return px.nearby(t.state, *HARBOUR, 3000.0).withColumn("distance_m", F.round("distance_m", 3))


@query
def nearby_fleet(t: Tables) -> DataFrame:
    return px.nearby(t.fleet, 1.2541, 103.7542, 20000.0).withColumn(
        "distance_m", F.round("distance_m", 3))


@query
def nearby_many(t: Tables) -> DataFrame:
    """The five closest vessels within 500 m of every report."""
    points = t.positions.select(F.col("event_id").alias("point_id"), F.col("latitude").alias("lat"),
                                F.col("longitude").alias("lon"))
    return px.nearby_many(stored(points), stored(t.state), 500.0, 5).select(
        "point_id", "mmsi", F.col("rank").cast("long").alias("rank"),
        F.round("distance_m", 3).alias("distance_m"))


@query
def conflicts(t: Tables) -> DataFrame:
    return _pair_columns(px.conflicts(stored(t.state)))


@query
def conflicts_fleet(t: Tables) -> DataFrame:
    """A third of the vessels lies in one harbour."""
    return _pair_columns(px.conflicts(stored(t.fleet)))


@query
def conflicts_geodesic(t: Tables) -> DataFrame:
    return _pair_columns(px.conflicts(stored(t.fleet), 300.0, mode="geodesic"))


@query
def conflict_severity(t: Tables) -> DataFrame:
    pairs = px.with_severity(px.conflicts(stored(t.state), 2000.0))
    return pr.table_rows(_pair_columns(pairs, "severity", "distance_text").orderBy(
        "distance_m", "a_mmsi", "b_mmsi"))


# ---- Archive and data quality -------------------------------------------------------------

@query
def archive_partitions(t: Tables) -> DataFrame:
    return t.archive.groupBy("dt", "HH").agg(F.count("*").alias("events"),
                                             F.count_if("raim").alias("raim"))


@query
def in_window(t: Tables) -> DataFrame:
    return ql.in_archive_window(t.archive, t.as_of).groupBy("dt", "HH").agg(
        F.count("*").alias("events"))


@query
def data_quality(t: Tables) -> DataFrame:
    """The report over a written archive; of the files it scans SQL can tell the hour folders."""
    folder = F.regexp_replace("file", "/[^/]*$", "")
    archive = t.written_archive(WINDOW_HOURS).withColumn("folder", folder)
    row = ql.data_quality(archive, t.last, WINDOW_HOURS, file="folder")
    return _six(row.select("*", "latency.*").drop("latency").withColumnRenamed(
        "parquet_files", "hours_scanned"), "p50_s", "p95_s", "max_s")


@query
def missing_motion(t: Tables) -> DataFrame:
    return ql.missing_motion(ql.data_quality(t.archive, t.last, WINDOW_HOURS))


@query
def latency_stats(t: Tables) -> DataFrame:
    return _six(ql.latency_stats(t.archive, t.last), "p50_s", "p95_s", "max_s")


@query
def latency_ranks(t: Tables) -> DataFrame:
    """p50 and p95 by index over the whole archive."""
    rows = t.archive.select(ql.source_latency().alias("latency")).filter("latency >= 0")
    return _six(ql.latency_ranks(rows), "value")


@query
def archive_roundtrip(t: Tables) -> DataFrame:
    """Write the archive, read a window of it back and report on it."""
    return t.written_archive(WINDOW_HOURS).groupBy("dt", "HH").agg(
        F.count("*").alias("events"), F.round(F.sum("latitude"), 4).alias("latitude_sum"))


@query
def archive_replay(t: Tables) -> DataFrame:
    """The second half written first, then everything, twice: what is known is not stored again."""
    path = session.scratch(t.spark, "archive")
    for events in (_halves(t)[1], t.positions, t.positions):
        ar.write_archive(events, path, t.as_of)
    return ar.read_archive(t.spark, path).groupBy("dt", "HH").agg(
        F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


@query
def archive_expiry(t: Tables) -> DataFrame:
    """Day folders that a clean-up at the last event drops, and the rows that stay."""
    path = session.scratch(t.spark, "archive")
    ar.write_archive(t.positions, path, t.as_of)
    gone = ar.expire_archive(t.spark, path, t.last)
    return ar.read_archive(t.spark, path).agg(
        F.lit(len(gone)).cast("long").alias("days_dropped"), F.count("*").alias("events_left"),
        F.min("dt").alias("first_day"))


@query
def archive_compaction(t: Tables) -> DataFrame:
    """An archive of three appends to every hour, compacted: the same rows, and one file in each hour that is closed."""
    path = session.scratch(t.spark, "archive")
    for part in range(3):
        ar.write_archive(t.positions.where(F.col("seq") % 3 == part), path, t.as_of)
    ar.compact_archive(t.spark, path, t.last)
    hours = ar.read_archive(t.spark, path, files=True).groupBy("dt", "HH").agg(
        F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"), F.count_distinct("file").alias("files"))
    ended = F.to_timestamp(F.concat_ws(" ", "dt", "HH"), "yyyy-MM-dd HH") + F.expr("INTERVAL 1 HOUR")
    closed = ended <= t.as_of - F.make_interval(secs=F.lit(times.STALE_TOLERANCE_S + times.FUTURE_TOLERANCE_S))
    return hours.agg(F.sum("events").alias("events"), F.sum("ids").alias("ids"), F.count_if(closed).alias("closed_hours"),
                     F.max(F.when(closed, F.col("files"))).alias("most_files"))


@query
def sample_frames(t: Tables) -> DataFrame:
    """A capture of frames that are JSON, read back: each is one of them, with its own arrival."""
    path = session.scratch(t.spark, "sample")
    frames = fs.frames_from_text(t.frames.select("value", "received_at"))
    fs.sample_frames(frames, 100, path)
    back = fs.read_frames(t.spark, path).select("received_at", fr.as_text(
        fr.field(F.col("frame"), "$.MetaData.time_utc")).alias("time"))
    known = frames.select("received_at", fr.as_text(fr.field(F.col("frame"), "$.MetaData.time_utc")).alias("time"))
    found = back.join(known.distinct(), (back.received_at == known.received_at) & back.time.eqNullSafe(known.time),
                      "left_semi")
    return found.agg(F.count("*").alias("frames"))


# ---- Retention ----------------------------------------------------------------------------

@query
def mark_stale(t: Tables) -> DataFrame:
    return t.aged.select("mmsi", "status")


@query
def purge_state(t: Tables) -> DataFrame:
    return st.purge_state(t.state, t.as_of, 24).select("mmsi", "last_seen_at")


@query
def expire_track(t: Tables) -> DataFrame:
    return tr.expire_track(t.track, t.as_of).select("mmsi", "event_id", "event_time")


@query
def retention_report(t: Tables) -> DataFrame:
    return retention.retention_report(t.aged, t.track, t.as_of, purge_hours=24)


@query
def retention_outcome(t: Tables) -> DataFrame:
    return retention.retention_outcome(t.aged, t.track, t.as_of, purge_hours=24)


# ---- Streams over the table as a file source ----------------------------------------------

def _stream_log(t: Tables) -> tuple[str, str]:
    """Run the ingest stream to its end; returns the work folder and the log's path."""
    home = session.scratch(t.spark, "stream")
    # dealt out as four columns in order of arrival: the text of a frame is made once, after that
    events = ev.by_arrival(ev.stream_events(t.spark, t.dir), t.spark.sparkContext.defaultParallelism)
    frames = ev.as_frames(events).select("value", "received_at")
    jobs.run_to_end(jobs.start_ingest(frames, f"{home}/log", f"{home}/ck-ingest"))
    return home, f"{home}/log"


def _consumed(t: Tables, start, home: str, path: str, name: str, files: int | None = None) -> str:
    """Run a consumer of the log to its end in micro-batches of a few files; returns its sink."""
    files = files or max(2, t.spark.sparkContext.defaultParallelism // 2)
    events = jobs.consume(t.spark, path, max_files=files)
    jobs.run_to_end(start(events, f"{home}/{name}", f"{home}/ck-{name}-{files}", path, seconds=None))
    return f"{home}/{name}"


@query
def stream_ingest(t: Tables) -> DataFrame:
    _, path = _stream_log(t)
    records = log.read_records(t.spark, path)
    return records.groupBy("topic").agg(F.count("*").alias("records"),
                                        F.count_distinct("key").alias("vessels"))


@query
def stream_state(t: Tables) -> DataFrame:
    home, path = _stream_log(t)
    state = tables.read_state(t.spark, _consumed(t, jobs.start_state, home, path, "state"))
    return state.select("mmsi", "latitude", "longitude", "sog_knots", "status", "last_seen_at")


@query
def stream_track(t: Tables) -> DataFrame:
    home, path = _stream_log(t)
    track = tables.read_track(t.spark, _consumed(t, jobs.start_track, home, path, "track"))
    return track.groupBy("partition_hour").agg(F.count("*").alias("points"),
                                               F.count_distinct("mmsi").alias("vessels"))


@query
def stream_archive(t: Tables) -> DataFrame:
    home, path = _stream_log(t)
    back = ar.read_archive(t.spark, _consumed(t, jobs.start_archive, home, path, "archive"))
    return back.groupBy("dt", "HH").agg(F.count("*").alias("events"))


@query
def stream_dlq(t: Tables) -> DataFrame:
    """Records that the three consumers of a damaged log put on its quarantine topic, by reason and service."""
    home = session.scratch(t.spark, "stream")
    log.write_records(_damaged_log(t).withColumn("topic", F.lit(log.RAW_TOPIC)), f"{home}/log")
    for start, name in ((jobs.start_archive, "archive"), (jobs.start_state, "state"), (jobs.start_track, "track")):
        _consumed(t, start, home, f"{home}/log", name)
    return log.read_dlq(t.spark, f"{home}/log").groupBy(
        F.col("_dlq_reason").alias("reason"), F.col("_dlq_source").alias("service")).agg(F.count("*").alias("records"))


@query
def stream_stale(t: Tables) -> DataFrame:
    """Vessels that fell silent, found while the log grows by a quarter of the time at a time, with a restart after each."""
    home = session.scratch(t.spark, "stream")
    first, last = t.positions.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    width = (last - first) / 4
    for part in range(4):
        arrived = F.floor((F.col("ingested_at") - first) / width)
        log.write_records(log.to_log_records(t.positions.where(F.least(arrived, F.lit(3)) == part)), f"{home}/log")
        jobs.run_to_end(jobs.start_stale(jobs.consume(t.spark, f"{home}/log"), f"{home}/stale", f"{home}/ck", None,
                                         delay=f"{math.ceil(width)} seconds"))
    found = t.spark.read.parquet(f"{home}/stale")
    return found.select("mmsi", F.round(times.epoch_seconds(F.col("silent_since")), 3).alias("silent_since"),
                        F.round(times.epoch_seconds(F.col("stale_at")), 3).alias("stale_at"), "reports")


@query
def stream_hourly(t: Tables) -> DataFrame:
    """Positions per event hour, counted while the log is read in several batches."""
    home, path = _stream_log(t)
    for _ in range(2):  # the second time there is nothing new
        jobs.run_to_end(jobs.start_hourly(jobs.consume(t.spark, path, max_files=4), f"{home}/hourly", f"{home}/ck-hourly", None))
    return jobs.read_hourly(t.spark, f"{home}/hourly")


@query
def stream_counters(t: Tables) -> DataFrame:
    """What each consumer of a damaged log read, refused and stored, added up over its batches."""
    home = session.scratch(t.spark, "stream")
    log.write_records(_damaged_log(t).withColumn("topic", F.lit(log.RAW_TOPIC)), f"{home}/log")
    for start, name in ((jobs.start_archive, "archive"), (jobs.start_state, "state"), (jobs.start_track, "track")):
        counted = functools.partial(start, metrics=f"{home}/metrics")
        _consumed(t, counted, home, f"{home}/log", name)
    # of the vessels a batch changes SQL knows no number, but that each is written once at least
    vessels = tables.read_state(t.spark, f"{home}/state").agg(F.count("*")).scalar()
    written = F.sum("written")
    return jobs.read_metrics(t.spark, f"{home}/metrics").groupBy("job").agg(
        F.sum("rows").alias("rows"), F.sum("poisoned").alias("poisoned"), written.alias("written"),
        ((F.sum("files") > 0) & (F.sum("bytes") > 0)).alias("stored")).select(
        "job", "rows", "poisoned", F.when(F.col("job") != "state", F.col("written")).alias("written"), "stored",
        ((F.col("job") != "state") | (F.col("written") >= vessels)).alias("all_vessels"))


# ---- The same as SQL -----------------------------------------------------------------------

def _views(t: Tables) -> dict[str, str]:
    """Views of the stored state and track."""
    names = {"state": "tidewake_state", "track": "tidewake_track"}
    stored(t.state).createOrReplaceTempView(names["state"])
    stored(t.track).createOrReplaceTempView(names["track"])
    return names


@query
def sql_rules(t: Tables) -> DataFrame:
    """The rules by their SQL names, over every report."""
    sql.register(t.spark)
    t.positions.createOrReplaceTempView("tidewake_positions")
    return t.spark.sql(f"""SELECT event_id, vessel_status(nav_status, sog_knots) AS status,
        decode_turn(rate_of_turn).rot_deg_min AS rot_deg_min, decode_turn(rate_of_turn).direction AS direction,
        nav_label(nav_status) AS label, valid_mmsi(mmsi) AS valid, event_instant(event_time) AS event_ts,
        skew_reason(event_instant(event_time), ingested_at - 40) AS reason,
        round(distance_metres(latitude, longitude, {HARBOUR[0]}D, {HARBOUR[1]}D), 4) AS lambert_m FROM tidewake_positions""")


@query
def sql_nearby(t: Tables) -> DataFrame:
    sql.register(t.spark, **_views(t))
    return t.spark.sql(f"SELECT * FROM vessels_nearby({HARBOUR[0]}D, {HARBOUR[1]}D, 3000D)").withColumn(
        "distance_m", F.round("distance_m", 3))


@query
def sql_vessel_track(t: Tables) -> DataFrame:
    sql.register(t.spark, **_views(t))
    return t.spark.sql(f"SELECT * FROM vessel_track('{VESSEL}', TIMESTAMP '{t.last:%Y-%m-%d %H:%M:%S.%f}', {WINDOW_HOURS})")
