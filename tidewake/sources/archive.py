"""Hour-partitioned Parquet archive of canonical events."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import times
from tidewake.schemas import ARCHIVE_SCHEMA, EVENT_SCHEMA
from tidewake.session import counted, scratch
from tidewake.sources import paths

# ---- Fixed values -------------------------------------------------------------------------
ARCHIVE_RETENTION_DAYS = 7
FLUSH_MAX_ROWS = 1000
FLUSH_MAX_SECONDS = 900
FLUSH_MIN_ROWS = 100
# -------------------------------------------------------------------------------------------

MOST_HOURS = 2000  # hour folders that a filter lists by name
FILE_BYTES = 128 << 20


def to_archive_row(events: DataFrame, *extra: str) -> DataFrame:
    """Coerce to the archive's column types: flags default to false, version to 1.0; ``extra`` columns stay."""
    fixed = {
        "schema_version": F.coalesce("schema_version", F.lit("1.0")),
        "mmsi": F.coalesce("mmsi", F.lit("None")),
        "position_accuracy": F.coalesce("position_accuracy", F.lit(False)),
        "raim": F.coalesce("raim", F.lit(False)),
    }
    return events.select(*[fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
                           for f in EVENT_SCHEMA], *extra)


def with_partition(events: DataFrame, now=None) -> DataFrame:
    """Adds ``dt`` and ``HH`` (UTC) of the event time, else of the arrival, else of now."""
    at = times.effective_time("event_time", "ingested_at", now)
    return (events.withColumn("_at", at).withColumn("dt", times.partition_date("_at"))
            .withColumn("HH", times.partition_hour_text("_at")).drop("_at"))


def archive_rows(events: DataFrame, now=None) -> DataFrame:
    return with_partition(to_archive_row(events), now)


def dated(events: DataFrame, now=None) -> DataFrame:
    """``with_partition`` and ``_timeless``, neither a readable time nor an arrival; the time text is parsed once."""
    arrival = F.nullif("ingested_at", F.lit(0.0))
    at = F.coalesce("_parsed", F.timestamp_seconds(arrival), times.as_of_column(now))
    return (events.withColumn("_parsed", times.parse_event_time("event_time")).withColumn("_at", at)
            .withColumns({"dt": times.partition_date("_at"), "HH": times.partition_hour_text("_at"),
                          "_timeless": F.col("_parsed").isNull() & arrival.isNull()}).drop("_parsed", "_at"))


def _content() -> Column:
    return F.md5(F.to_json(F.struct(*EVENT_SCHEMA.names), {"ignoreNullFields": "false"}))


def _unseen(rows: DataFrame, stored: DataFrame, *key: str) -> DataFrame:
    """The first row per key that the archive does not hold yet. Rows are sorted by key: name what tells them apart first."""
    one = Window.partitionBy(*key).orderBy("ingested_at", "raw")
    first = rows.withColumn("_place", F.row_number().over(one)).filter("_place = 1").drop("_place")
    return first.join(stored.select(*key), list(key), "left_anti")


def within(stored: DataFrame, hours: DataFrame, columns: list[str], most: int = MOST_HOURS) -> DataFrame:
    """Rows of ``stored`` in the hour folders that ``hours`` names; up to ``most`` are listed, so that folders are pruned."""
    named = hours.select(*columns).distinct()
    listed = named.limit(most + 1).collect()
    if len(listed) > most:
        return stored.join(named, columns, "left_semi")
    if len(columns) == 1:
        return stored.filter(F.col(columns[0]).isin([r[0] for r in listed]))
    return stored.filter(F.concat_ws("/", *columns).isin(["/".join(r) for r in listed]))


def write_archive(events: DataFrame, path: str, now=None) -> int:
    """Append events below ``dt=/HH=``; what the archive holds already is left out. Returns the number of new rows.

    An event is known by its id, one without id by its content. It is looked up in the hours the
    events fall into, so a replay adds nothing, whatever the borders of its batches, and no call
    replaces what another one wrote. An event with neither a readable time nor an arrival lies in the hour it was first stored
    in; it is looked up among all such events. One writer at a time. The rebalance hint lets the adaptive
    plan merge small hours into one file and split an hour that holds most of the rows over many tasks. ``events`` that
    ``dated`` gave their hour already, as a job does before it caches a batch, keep it.
    """
    if "_timeless" in events.columns:
        rows = to_archive_row(events, "dt", "HH", "_timeless")
    else:
        rows = dated(to_archive_row(events), now)
    # one pass counts the rows and names the hours
    hours = rows.groupBy("dt", "HH").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("event_id").isNull()).alias("_nameless"),
                                         F.count_if("_timeless").alias("_untimed")).persist()
    try:
        return _append(rows, hours, path)
    finally:
        hours.unpersist()


def _append(rows: DataFrame, hours: DataFrame, path: str) -> int:
    spark = rows.sparkSession
    count, nameless, untimed = hours.agg(F.sum("_n"), F.sum("_nameless"), F.sum("_untimed")).first()
    if not count:
        return 0
    there = bool(paths.folders(spark, path))
    stored = within(read_archive(spark, path), hours, ["dt", "HH"]) if there else empty_archive(spark)
    # a filter on a computed column goes below it as a copy: without any such row there is none, and times are parsed once
    kinds = [("NOT _timeless" if untimed else "true", stored, ("dt", "HH"))]
    if untimed:
        among = read_archive(spark, path).filter("ingested_at IS NULL OR ingested_at = 0") if there else stored
        kinds.append(("_timeless", among, ()))
    new = []
    for which, among, hour in kinds:
        mine = rows.filter(which).drop("_timeless")
        new.append(_unseen(mine.filter("event_id IS NOT NULL"), among.filter("event_id IS NOT NULL"), "event_id", *hour))
        if nameless:
            by_content = [df.filter("event_id IS NULL").withColumn("_content", _content()) for df in (mine, among)]
            new.append(_unseen(*by_content, "_content", *hour).drop("_content"))
    out = reduce(DataFrame.unionByName, new).select(*ARCHIVE_SCHEMA.names)
    out, seen = counted(out.hint("rebalance", "dt", "HH").sortWithinPartitions("dt", "HH", "mmsi"))
    (out.write.mode("append").option("compression", "snappy").options(**bloom("event_id"))
     .partitionBy("dt", "HH").parquet(path))
    return seen.get["n"]


def bloom(column: str) -> dict[str, str]:
    """Writer options: Bloom filters of the size it takes, so that a look-up by ``column`` opens few row groups."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.bloom.filter.max.bytes": str(1 << 20)}


# ---- Small files ----------------------------------------------------------------------------

def _closed(spark: SparkSession, path: str, before: datetime) -> dict[tuple[str, str], tuple[int, int]]:
    """Files and bytes of the hours that ended at ``before`` or earlier, from the listing."""
    found = {}
    for day in paths.folders(spark, path):
        for hour in paths.folders(spark, f"{path}/{day}"):
            try:
                start = datetime.strptime(f"{day} {hour}", "dt=%Y-%m-%d HH=%H")
            except ValueError:
                continue
            if start + timedelta(hours=1) <= before:
                found[day[3:], hour[3:]] = paths.total(spark, f"{path}/{day}/{hour}")
    return found


def compact_archive(spark: SparkSession, path: str, as_of: datetime, target_bytes: int = FILE_BYTES,
                    dry_run: bool = False) -> list[tuple[str, str]]:
    """Rewrite hours of many small files as files of about ``target_bytes``; returns the hours (dt, HH).

    Only hours that no append can reach any more: the skew gate lets nothing in that is later than its tolerance. An hour is
    worth it if packing its files saves one. The rows are copied to the shared folder first and put in place of the hour's old files by
    one dynamic overwrite, so a stop before its commit changes nothing. A reader that listed the old files before is to be run again.
    """
    as_of = as_of if as_of.tzinfo is None else as_of.astimezone(timezone.utc).replace(tzinfo=None)
    closed = _closed(spark, path, as_of - timedelta(seconds=times.STALE_TOLERANCE_S + times.FUTURE_TOLERANCE_S))
    bins = {hour: max(1, -(-size // target_bytes)) for hour, (_, size) in closed.items()}
    wanted = sorted(hour for hour, (files, _) in closed.items() if files > bins[hour])
    if dry_run or not wanted:
        return wanted
    for first in range(0, len(wanted), MOST_HOURS):
        part = wanted[first:first + MOST_HOURS]
        hours = spark.createDataFrame([(*hour, bins[hour]) for hour in part], "dt string, HH string, _bins long")
        rows = within(read_archive(spark, path), hours, ["dt", "HH"]).join(F.broadcast(hours), ["dt", "HH"])
        copy = scratch(spark, "compaction")
        rows.write.parquet(copy)
        back = spark.read.parquet(copy)
        # an hour's rows in as many parts as files are due; vessels stay together, so that statistics prune
        place = F.pmod(F.xxhash64("mmsi"), F.col("_bins"))
        (back.repartition("dt", "HH", place).sortWithinPartitions("dt", "HH", "mmsi", "event_id").select(*ARCHIVE_SCHEMA.names)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
         .options(**bloom("event_id")).partitionBy("dt", "HH").parquet(path))
        paths.delete(spark, copy)
    return wanted


def empty_archive(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ARCHIVE_SCHEMA)


def cutoff_of(as_of=None, window_hours: int = 24):
    return times.hours_ago(times.as_of_column(as_of), window_hours)


def read_archive(spark: SparkSession, path: str, as_of=None, window_hours: int | None = None,
                 files: bool = False) -> DataFrame:
    """Archive rows with ``dt`` and ``HH``; a window prunes whole hour folders.

    ``files`` adds the column ``file`` for counting the files a report scans.
    """
    df = spark.read.schema(ARCHIVE_SCHEMA).parquet(path)
    if window_hours is not None:
        df = df.filter(times.in_window("dt", "HH", cutoff_of(as_of, window_hours)))
    extra = [F.col("_metadata.file_path").alias("file")] if files else []
    return df.select(*ARCHIVE_SCHEMA.names, *extra)


def expire_archive(spark: SparkSession, path: str, as_of: datetime,
                   days: int = ARCHIVE_RETENTION_DAYS, dry_run: bool = False) -> list[str]:
    """Drop day folders that ended more than ``days`` before ``as_of``; returns their names."""
    limit = as_of - timedelta(days=days)
    expired = []
    for name in paths.folders(spark, path):
        try:
            day = datetime.strptime(name, "dt=%Y-%m-%d").replace(tzinfo=limit.tzinfo)
        except ValueError:
            continue
        if day + timedelta(days=1) <= limit:
            expired.append(name)
            if not dry_run:
                paths.delete(spark, f"{path}/{name}")
    return expired
