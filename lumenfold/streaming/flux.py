"""Light curves that arrive as a stream (lc_id, ts, y): cleaning and masking need no state, binning a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.operators.lightcurve import usable


def prepared(stream: DataFrame, period: float, duration: float, t0: float) -> DataFrame:
    """Usable rows with t (days), phase and in_transit."""
    timed = stream.withColumn("t", C.days(F.col("ts"))).filter(usable("t", "y"))
    return timed.withColumn("phase", C.fold(F.col("t"), period, t0)).withColumn("in_transit", C.in_transit(F.col("t"), period, duration, t0))


def binned(stream: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Mean flux per curve and tumbling window; rows later than ``late`` are dropped."""
    return stream.withWatermark("ts", late).groupBy("lc_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).select("lc_id", F.col("w.start").alias("start"), "n", "mean")
