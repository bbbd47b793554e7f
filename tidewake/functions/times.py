"""Event-time parsing, skew, latency and hour partitions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances in seconds, and the three quarantine reasons.
FUTURE_TOLERANCE_S = 60.0
STALE_TOLERANCE_S = 21600.0
UNPARSEABLE = "unparseable_timestamp"
FUTURE = "future_timestamp"
STALE = "stale_timestamp"

_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_OFFSET = r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)"
_SECONDS = r"[0-9]{2}:[0-9]{2}:[0-9]{2}([.,]([0-9]{3}|[0-9]{6,}))?"
_FULL = rf"^{_DATE}[ T]{_SECONDS}( ?{_OFFSET})?$"
_DATE_ONLY = rf"^{_DATE}$"
_HOUR = rf"^({_DATE}[ T][0-9]{{2}})( ?{_OFFSET})?$"
_MINUTE = rf"^({_DATE}[ T][0-9]{{2}}:[0-9]{{2}})( ?{_OFFSET})?$"


def as_column(value) -> Column:
    """A column from a name or a column."""
    return F.col(value) if isinstance(value, str) else value


def as_of_column(as_of: datetime | Column | None = None) -> Column:
    """The reference instant of a query; the wall clock when not given."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc)
        return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")
    return as_of.cast("timestamp")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def cleaned_time(value) -> Column:
    """Feed time text without its " UTC" and outer blanks."""
    text = F.replace(as_column(value).cast("string"), F.lit(" UTC"), F.lit(""))
    return F.btrim(text, F.lit(" \t\r\n"))


def _parse(text: Column, keep_offset: bool) -> Column:
    """Cast the accepted shapes; the feed's own shape is tested first, so it costs one match."""
    def cast(clock: Column) -> Column:
        return F.replace(clock, F.lit(","), F.lit(".")).try_cast("timestamp")

    offset = "$2" if keep_offset else ""
    full = text if keep_offset else F.regexp_replace(text, rf" ?{_OFFSET}$", "")
    return (F.when(text.rlike(_FULL), cast(full))
            .when(text.rlike(_DATE_ONLY), cast(text))
            .when(text.rlike(_MINUTE), cast(F.regexp_replace(text, _MINUTE, "$1:00" + offset)))
            .when(text.rlike(_HOUR), cast(F.regexp_replace(text, _HOUR, "$1:00:00" + offset))))


def parse_event_time(value) -> Column:
    """Feed time text to TIMESTAMP; no offset means UTC; anything unreadable is NULL.

    The shape guard keeps out texts a plain cast would accept ("12:00", "2026"). Compact
    (20260910) and week dates are not part of the feed and give NULL.
    """
    return parse_clean_time(cleaned_time(value))


def parse_clean_time(text) -> Column:
    """``parse_event_time`` of text that ``cleaned_time`` has been applied to."""
    return _parse(as_column(text), keep_offset=True)


def parse_event_time_as_utc(value) -> Column:
    """Archive reading of the same text: the clock digits are taken as UTC, the offset is dropped."""
    return _parse(cleaned_time(value), keep_offset=False)


def classify_skew(event_ts, ingested_at, future_s: float = FUTURE_TOLERANCE_S,
                  stale_s: float = STALE_TOLERANCE_S) -> Column:
    """Reason an event time is out of tolerance against its arrival, else NULL (strict bounds)."""
    event_ts, ingested_at = as_column(event_ts), as_column(ingested_at)
    skew = epoch_seconds(event_ts) - ingested_at
    return (F.when(event_ts.isNull(), F.lit(UNPARSEABLE))
            .when(skew > F.lit(float(future_s)), F.lit(FUTURE))
            .when(skew < F.lit(-float(stale_s)), F.lit(STALE)))


def latency_ms(event_ts, ingested_at) -> Column:
    """Whole milliseconds from event to arrival; an unreadable event time counts as the epoch."""
    event_s = F.coalesce(epoch_seconds(as_column(event_ts)), F.lit(0.0))
    return ((as_column(ingested_at) - event_s) * 1000).cast("long")


def effective_time(event_time, ingested_at, now: Column | None = None) -> Column:
    """Parsed event time, else the arrival time, else now."""
    arrival = F.timestamp_seconds(F.nullif(as_column(ingested_at), F.lit(0.0)))
    return F.coalesce(parse_event_time(event_time), arrival, as_of_column(now))


def partition_date(ts) -> Column:
    return F.date_format(as_column(ts), "yyyy-MM-dd")


def partition_hour_text(ts) -> Column:
    return F.date_format(as_column(ts), "HH")


def in_window(dt, hh, cutoff: Column) -> Column:
    """Hour partition at or after the cutoff's hour; absent or malformed names are kept."""
    hour = F.lpad(F.coalesce(F.nullif(as_column(hh), F.lit("")), F.lit("00")), 2, "0")
    start = F.try_to_timestamp(F.concat(as_column(dt), F.lit(" "), hour), F.lit("yyyy-MM-dd HH"))
    return F.coalesce(start >= F.date_trunc("hour", cutoff), F.lit(True))


def minutes_ago(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_interval(mins=F.lit(int(minutes)))


def hours_ago(as_of: Column, hours: int) -> Column:
    return as_of - F.make_interval(hours=F.lit(int(hours)))
