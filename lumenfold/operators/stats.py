"""Per-transit and summary statistics.  ``found``: lc_id, period, T0, duration (share of the period), one row per curve.

Points meet transits by number: a point's nearest transit is floor((t - T0) / P + 1/2), so the interval join is an equi-join
on (lc_id, n) with its strict bounds as the residual test; where windows are wider than half a period a point asks its neighbours too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.operators.grids import transit_times

#: Days around a mid-transit time within which its points count.
REACH = 0.5


def extents(lc: DataFrame) -> DataFrame:
    """lc_id, n, min_t, max_t, median step."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("lc_id").orderBy("t", "idx"))
    return lc.withColumn("__s", step).groupBy("lc_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.median("__s").alias("step"))


def fill_factor() -> Column:
    """Points over the number that the median step would give."""
    return (F.col("n") - 1) / ((F.col("max_t") - F.col("min_t")) / F.col("step"))


def durations(found: DataFrame, extent: DataFrame) -> DataFrame:
    """``found`` with the extent's columns, transits, stretch, fill and duration_days."""
    f = found.join(extent, "lc_id")
    count = transit_times(f).groupBy("lc_id").agg(F.count(F.lit(1)).alias("transits"))
    f = f.join(count, "lc_id").withColumn("stretch", (F.col("max_t") - F.col("min_t")) / F.col("period") / F.col("transits")).withColumn("fill", fill_factor())
    return f.withColumn("duration_days", F.col("duration") * F.col("stretch") * F.col("period") * F.col("fill"))


def points_by_transit(lc: DataFrame, mids: DataFrame, found: DataFrame, reach: Column) -> DataFrame:
    """lc_id, n, mid, t, y of the points strictly within ``reach`` days (a column of ``found``) of each transit."""
    asked = lc.join(found.select("lc_id", "period", "T0", "min_t", reach.alias("__reach")), "lc_id")
    start = F.when(F.col("T0") < F.col("min_t"), F.col("T0") + F.col("period")).otherwise(F.col("T0"))
    near = F.floor((F.col("t") - start) / F.col("period") + 0.5)
    wide = F.ceil(F.col("__reach") / F.col("period")).cast("int")
    asked = asked.select("lc_id", "t", "y", "__reach", near.alias("__k"), wide.alias("__w")).withColumn("n", F.explode(F.expr("transform(sequence(-__w, __w), x -> __k + x)")))
    return asked.join(mids, ["lc_id", "n"]).filter(F.abs(F.col("t") - F.col("mid")) < F.col("__reach")).select("lc_id", "n", "mid", "t", "y", "__reach")


def count_stats(lc: DataFrame, found: DataFrame) -> DataFrame:
    """lc_id, in_transit_count, before_transit_count, after_transit_count.

    Over transits whose 1.5 durations to both sides lie strictly inside the data: points strictly within half a
    duration, and in the duration before and after that.  ``found`` has duration_days and the extent.
    """
    mids = transit_times(found)
    d = found.select("lc_id", "min_t", "max_t", F.col("duration_days").alias("__d"))
    whole = mids.join(d, "lc_id").filter((F.col("mid") - 1.5 * F.col("__d") > F.col("min_t")) & (F.col("mid") + 1.5 * F.col("__d") < F.col("max_t"))).select("lc_id", "n", "mid")
    p = points_by_transit(lc, whole, found, F.col("duration_days") * 1.5).withColumn("__h", F.col("__reach") / 3)
    x = F.col("t") - F.col("mid")
    counts = p.groupBy("lc_id").agg(F.count_if((x > -F.col("__h")) & (x < F.col("__h"))).alias("i"), F.count_if(x < -F.col("__h")).alias("b"), F.count_if(x > F.col("__h")).alias("a"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select("lc_id").join(counts, "lc_id", "left").select("lc_id", zero(F.col("i")).alias("in_transit_count"), zero(F.col("b")).alias("before_transit_count"), zero(F.col("a")).alias("after_transit_count"))


def intransit_points(lc: DataFrame, found: DataFrame) -> DataFrame:
    """Points strictly within half a duration of a transit."""
    return points_by_transit(lc, transit_times(found), found, F.col("duration_days") / 2)


def intransit_stats(lc: DataFrame, found: DataFrame) -> DataFrame:
    """lc_id, n, mid, cnt, mean_flux, err of every transit; mean_flux and err are null where it has no point."""
    g = intransit_points(lc, found).groupBy("lc_id", "n").agg(F.count(F.lit(1)).alias("cnt"), F.avg("y").alias("mean_flux"), (F.stddev_pop("y") / F.sqrt(F.count(F.lit(1)))).alias("err"))
    return transit_times(found).join(g, ["lc_id", "n"], "left").select("lc_id", "n", "mid", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"), "mean_flux", "err")


def depth_stats(lc: DataFrame, found: DataFrame) -> DataFrame:
    """Means of the flux in transit, of all transits and of the odd and even ones (counted from 0: the first is even), their errors and mismatch."""
    p = intransit_points(lc, found)
    even, odd = F.when(F.col("n") % 2 == 0, F.col("y")), F.when(F.col("n") % 2 != 0, F.col("y"))
    g = p.groupBy("lc_id").agg(
        F.avg("y").alias("depth_mean"), (F.stddev_pop("y") / F.sqrt(F.count("y"))).alias("depth_mean_std"), F.count("y").alias("points"),
        F.avg(even).alias("depth_mean_even"), F.try_divide(F.stddev_pop(even), F.sqrt(F.count(even))).alias("depth_mean_even_std"),
        F.avg(odd).alias("depth_mean_odd"), F.try_divide(F.stddev_pop(odd), F.sqrt(F.count(odd))).alias("depth_mean_odd_std"),
    )
    mismatch = F.try_divide(F.abs(F.col("depth_mean_odd") - F.col("depth_mean_even")), F.col("depth_mean_odd_std") + F.col("depth_mean_even_std"))
    return found.select("lc_id").join(g.withColumn("odd_even_mismatch", mismatch), "lc_id", "left")


def out_of_transit(lc: DataFrame, found: DataFrame) -> DataFrame:
    """Points outside the dips, whose width here is twice the duration as a share of the period, taken as days."""
    f = found.select("lc_id", "period", "T0", "duration")
    return lc.join(f, "lc_id").filter(~C.in_transit(F.col("t"), F.col("period"), F.col("duration") * 2, F.col("T0"))).select("lc_id", "idx", "t", "y")


def snr_stats(lc: DataFrame, found: DataFrame) -> DataFrame:
    """lc_id, n, snr, snr_pink of every transit: its depth over white and over correlated noise; 0 where it has no point."""
    out = out_of_transit(lc, found)
    white = out.groupBy("lc_id").agg(F.stddev_pop("y").alias("__white"))
    per = intransit_stats(lc, found)
    width = per.groupBy("lc_id").agg(F.greatest(F.lit(1), F.floor(F.avg("cnt"))).cast("int").alias("__w"))
    # the width differs by curve: prefix sums give each window's scatter
    order = Window.partitionBy("lc_id").orderBy("t", "idx")
    grown = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    centred = out.join(out.groupBy("lc_id").agg(F.avg("y").alias("__m")), "lc_id").withColumn("__y", F.col("y") - F.col("__m"))
    sums = centred.join(width, "lc_id").select("lc_id", "__w", F.row_number().over(order).alias("k"), F.sum("__y").over(grown).alias("s1"), F.sum(F.col("__y") * F.col("__y")).over(grown).alias("s2"))
    back = sums.select("lc_id", (F.col("k") + F.col("__w")).alias("k"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    w = sums.filter(F.col("k") >= F.col("__w")).join(back, ["lc_id", "k"], "left")
    s1, s2 = F.col("s1") - F.coalesce("p1", F.lit(0.0)), F.col("s2") - F.coalesce("p2", F.lit(0.0))
    var = F.greatest(F.lit(0.0), s2 / F.col("__w") - F.pow(s1 / F.col("__w"), F.lit(2.0)))
    # one point has no scatter; the prefix sums would leave rounding residue
    scatter = F.when(F.col("__w") == 1, F.lit(0.0)).otherwise(F.sqrt(var) / F.sqrt(F.col("__w")))
    pink = w.groupBy("lc_id", "__w").agg(F.avg(scatter).alias("__pink")).drop("__w")
    joined = per.join(white, "lc_id", "left").join(pink, "lc_id", "left")
    snr = F.try_divide((1 - F.col("mean_flux")) * F.sqrt("cnt"), "__white")
    return joined.select("lc_id", "n", "mid", "cnt", "mean_flux", "err", F.coalesce(snr, F.lit(0.0)).alias("snr"), F.coalesce(F.try_divide(1 - F.col("mean_flux"), "__pink"), F.lit(0.0)).alias("snr_pink"))


def summary(lc: DataFrame, found: DataFrame) -> DataFrame:
    """lc_id, snr of all transits together, and how many transits there are, are empty, are distinct."""
    noise = out_of_transit(lc, found).groupBy("lc_id").agg(F.stddev_pop("y").alias("__s"))
    counts = intransit_stats(lc, found).groupBy("lc_id").agg(F.count(F.lit(1)).alias("transit_count"), F.count_if(F.col("cnt") == 0).alias("empty_transit_count"))
    d = depth_stats(lc, found).join(noise, "lc_id", "left").join(counts, "lc_id")
    snr = F.try_divide((1 - F.col("depth_mean")) * F.sqrt("points"), "__s")
    return d.withColumn("snr", snr).withColumn("distinct_transit_count", F.col("transit_count") - F.col("empty_transit_count")).drop("__s")


def folded(lc: DataFrame, found: DataFrame) -> DataFrame:
    """lc_id, idx, phase, y, dy with mid-transit at phase 1/2."""
    f = found.select("lc_id", "period", "T0")
    return lc.join(f, "lc_id").select("lc_id", "idx", C.fold(F.col("t"), F.col("period"), F.col("T0") + F.col("period") / 2).alias("phase"), "y", "dy")
