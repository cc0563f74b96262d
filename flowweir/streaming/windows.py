"""Fixed capture windows over a packet stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowweir.operators.captures import capture_aggregates, features_of_capture

CAPTURE_WINDOW = "8 seconds"
LATENESS = "10 seconds"


def with_event_time(packets: DataFrame) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us"))


def capture_windows(
    packets: DataFrame, width: str = CAPTURE_WINDOW, lateness: str = LATENESS
) -> DataFrame:
    """Capture features per tumbling window and capture point.

    The same plan runs on a batch table. On a stream a window is emitted once the
    watermark has passed its end; packets behind the watermark are dropped.
    State is one row of counters per open window.
    """
    timed = with_event_time(packets)
    if packets.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    grouped = timed.groupBy(F.window("ts", width), "capture_id").agg(*capture_aggregates())
    keyed = grouped.select(
        F.unix_micros("window.start").alias("window_start_us"),
        F.unix_micros("window.end").alias("window_end_us"),
        "*",
    )
    return features_of_capture(keyed, ["window_start_us", "window_end_us", "capture_id"])
