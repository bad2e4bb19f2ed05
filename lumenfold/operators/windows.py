"""Sliding operators on ordered values (lc_id, idx, ...): means, medians, residual sums, noise, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(order: str = "idx") -> Window:
    return Window.partitionBy("lc_id").orderBy(order)


def running_mean(df: DataFrame, value: str, width: int) -> DataFrame:
    """lc_id, idx, mean over idx .. idx + width - 1, where the frame is full.  Prefix sums, so each row costs the same at any width."""
    sums = F.sum(value).over(_by().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.select("lc_id", "idx", F.col(value).alias("__v"), sums.alias("__s"))
    ahead = F.lead("__s", width - 1).over(_by())
    return rows.select("lc_id", "idx", ((ahead - F.col("__s") + F.col("__v")) / width).alias("mean")).filter("mean is not null")


def _filled(df: DataFrame, full: Column, name: str) -> DataFrame:
    """``full`` where it is known, before and after that its first and last value."""
    everything = Window.partitionBy("lc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select("lc_id", "idx", full.alias("__f"))
    before = F.last("__f", ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("lc_id", "idx", F.coalesce("__f", before, F.first("__f", ignorenulls=True).over(everything)).alias(name))


def running_mean_equal_length(df: DataFrame, value: str, width: int) -> DataFrame:
    """:func:`running_mean` for every row: row i has the frame that begins int((width - 1) / 2) before it, ends padded by the nearest."""
    half = (width - 1) // 2
    frame = _by().rowsBetween(-half, width - 1 - half)
    full = F.when(F.count(value).over(frame) == width, F.avg(value).over(frame))
    return _filled(df, full, "mean")


def running_median(df: DataFrame, value: str, kernel: int) -> DataFrame:
    """lc_id, idx, median of the ``kernel`` values around each row; ends padded by the nearest."""
    half = (kernel - 1) // 2
    frame = _by().rowsBetween(-half, kernel - 1 - half)
    full = F.when(F.count(value).over(frame) == kernel, F.percentile(value, F.lit(0.5)).over(frame))
    return _filled(df, full, "median")


def residuals(df: DataFrame) -> Column:
    """A point's squared distance from 1 over its squared error."""
    return F.pow(1 - F.col("y"), F.lit(2)) / F.pow(F.col("dy"), F.lit(2))


def out_of_transit_residuals(df: DataFrame, width: int) -> DataFrame:
    """lc_id, idx, chi2 of all points but those of the window idx .. idx + width - 1."""
    r = df.withColumn("__r", residuals(df))
    inside = running_mean(r, "__r", width).select("lc_id", "idx", (F.col("mean") * width).alias("__w"))
    total = r.groupBy("lc_id").agg(F.sum("__r").alias("__t"))
    return inside.join(total, "lc_id").select("lc_id", "idx", (F.col("__t") - F.col("__w")).alias("chi2"))


def edge_correction(df: DataFrame, width: int) -> DataFrame:
    """lc_id, correction: the residuals of the first ``width`` points, which a wrap-around counts twice."""
    return df.filter(F.col("idx") < width).groupBy("lc_id").agg(F.sum(residuals(df)).alias("correction"))


def wrapped(df: DataFrame, facts: DataFrame, width: int) -> DataFrame:
    """``df`` with its first ``width`` points again behind its last."""
    tail = df.filter(F.col("idx") < width).join(facts.select("lc_id", "n"), "lc_id").withColumn("idx", F.col("idx") + F.col("n")).drop("n")
    return df.unionByName(tail)


def pink_noise(df: DataFrame, value: str, width: int) -> DataFrame:
    """lc_id, noise: mean over all windows of their scatter by the root of ``width``."""
    frame = _by().rowsBetween(0, width - 1)
    rows = df.select("lc_id", F.count(value).over(frame).alias("__n"), (F.stddev_pop(value).over(frame) / F.sqrt(F.lit(width))).alias("__s"))
    return rows.filter(F.col("__n") == width).groupBy("lc_id").agg(F.avg("__s").alias("noise"))


def resample(df: DataFrame, factor: float) -> DataFrame:
    """lc_id, i, t, y: int(n / factor) evenly spaced times, linearly interpolated (not averaged)."""
    f = df.groupBy("lc_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    f = f.withColumn("m", F.floor(F.col("n") / factor).cast("long")).filter("m >= 1")
    new = f.select("lc_id", "lo", "hi", "m", F.explode(F.expr("sequence(0L, m - 1)")).alias("i")).select("lc_id", "i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.greatest(F.col("m") - 1, F.lit(1))).alias("t"))
    # as-of by a sweep: each new time takes the last point at or before it, and that point's successor
    order = Window.partitionBy("lc_id").orderBy("t", "idx")
    known = df.select("lc_id", "idx", "t", "y", F.lead("t").over(order).alias("t2"), F.lead("y").over(order).alias("y2"))
    known = known.select("lc_id", "t", F.struct("t", "y", "t2", "y2").alias("p"), F.lit(None).cast("long").alias("i"), F.lit(0).alias("kind")).filter("p.t2 is not null")
    both = known.unionByName(new.select("lc_id", "t", F.lit(None).cast("struct<t:double,y:double,t2:double,y2:double>").alias("p"), "i", F.lit(1).alias("kind")))
    sweep = Window.partitionBy("lc_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("p", F.last("p", ignorenulls=True).over(sweep)).filter("kind = 1")
    y = F.col("p.y") + (F.col("t") - F.col("p.t")) * (F.col("p.y2") - F.col("p.y")) / (F.col("p.t2") - F.col("p.t"))
    return met.select("lc_id", "i", "t", y.alias("y"))


def median_filter(df: DataFrame, value: str, kernel: int) -> DataFrame:
    """lc_id, idx, median of ``kernel`` values around each row, zeros beyond the ends."""
    half = kernel // 2
    frame = _by().rowsBetween(-half, half)
    seen = F.sort_array(F.concat(F.collect_list(value).over(frame), F.array_repeat(F.lit(0.0), F.lit(kernel) - F.count(value).over(frame).cast("int"))))
    return df.select("lc_id", "idx", F.element_at(seen, half + 1).alias("median"))


def detrended(df: DataFrame, kernel: int = 25) -> DataFrame:
    """``df`` with y over its sliding median; see :func:`median_filter`."""
    m = median_filter(df, "y", kernel).withColumnRenamed("median", "__m")
    return df.join(m, ["lc_id", "idx"]).withColumn("y", F.try_divide("y", "__m")).drop("__m")


def clip_upper(df: DataFrame, sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """``df`` without the points more than ``sigma`` scatters above the median, again and again up to ``rounds`` times."""
    for _ in range(rounds):
        f = df.groupBy("lc_id").agg(F.median("y").alias("__m"), F.stddev_pop("y").alias("__s"))
        df = df.join(f, "lc_id").filter(F.col("y") <= F.col("__m") + sigma * F.col("__s")).drop("__m", "__s")
    return df


def binned_phases(df: DataFrame, phase: str, bins: int) -> DataFrame:
    """lc_id, bin, n, mean, std of y in equal bins of phase."""
    b = F.least(F.floor(F.col(phase) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", b).groupBy("lc_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))
