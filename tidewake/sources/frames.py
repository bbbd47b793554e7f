"""Raw position frames: JSON text with an arrival time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.frames import as_double, field, frame_variant, stamped_text
from tidewake.functions.times import as_column, epoch_seconds
from tidewake.sources.log import BATCH_BYTES, bounded

# The whole globe, and the one message type the feed is asked for.
WHOLE_GLOBE = [[[-90.0, -180.0], [90.0, 180.0]]]
DEFAULT_MESSAGE_TYPES = ["PositionReport"]


def frames_from_text(lines: DataFrame, value: str = "value") -> DataFrame:
    """Decode JSON text; lines that are not JSON are ignored.

    The arrival stamp is the frame's own ``_received_at`` (captured samples have one), else a
    ``received_at`` column, else now.
    """
    now = epoch_seconds(F.current_timestamp())
    given = F.col("received_at") if "received_at" in lines.columns else F.lit(None).cast("double")
    parsed = lines.select(F.col(value).alias("value"), given.alias("_given"),
                          frame_variant(value).alias("frame")).filter("frame IS NOT NULL")
    own = as_double(field(F.col("frame"), "$._received_at"))
    return parsed.select("value", F.coalesce(own, "_given", now).alias("received_at"), "frame")


def read_frames(spark: SparkSession, path: str, streaming: bool = False,
                max_files: int | None = None, max_bytes: int | None = BATCH_BYTES) -> DataFrame:
    """Frames from JSON-lines files, as a batch or a stream of bounded micro-batches."""
    reader = bounded(spark.readStream, max_files, max_bytes) if streaming else spark.read
    return frames_from_text(reader.text(path))


def in_boxes(lat, lon, boxes: Sequence = WHOLE_GLOBE) -> Column:
    """Inside any of the boxes, each ``[[lat, lon], [lat, lon]]`` by two opposite corners."""
    lat, lon = as_column(lat), as_column(lon)

    def inside(box) -> Column:
        (lat1, lon1), (lat2, lon2) = box
        return (lat.between(float(min(lat1, lat2)), float(max(lat1, lat2)))
                & lon.between(float(min(lon1, lon2)), float(max(lon1, lon2))))

    return reduce(or_, [inside(b) for b in boxes], F.lit(False))


def filter_subscription(df: DataFrame, boxes: Sequence = WHOLE_GLOBE,
                        message_types: Sequence[str] = tuple(DEFAULT_MESSAGE_TYPES)) -> DataFrame:
    """What the feed would deliver for a subscription, on canonical columns."""
    return df.filter(in_boxes("latitude", "longitude", boxes)
                     & F.col("message_type").isin(list(message_types)))


def sample_frames(frames: DataFrame, limit: int, path: str) -> None:
    """Write the first ``limit`` frames with their arrival stamp as JSON lines."""
    (frames.limit(limit).select(stamped_text("value", "received_at").alias("value"))
     .write.mode("overwrite").text(path))
