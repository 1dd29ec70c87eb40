"""State shares of an event stream: the incremental form of probabilities over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def windowed_counts(stream: DataFrame, time_col: str = "ts", state_col: str = "event_type", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(t, state, n): events of each state in tumbling windows; events later than ``late`` are dropped by the watermark."""
    timed = stream.select(F.col(time_col).cast("timestamp").alias("ts"), F.col(state_col).alias("state")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "state").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("t"), "state", "n")


def shares(counts: DataFrame) -> DataFrame:
    """(t, state, p) of finished windows: what a batch or ``foreachBatch`` makes of ``windowed_counts``."""
    total = F.sum("n").over(Window.partitionBy("t"))  # a window has a row for each state
    return counts.select("t", "state", (F.col("n") / total).alias("p"))
