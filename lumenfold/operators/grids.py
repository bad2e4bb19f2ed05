"""Grids of periods, durations, mid-transit times and phases, in closed form."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import params as P

#: Frequencies that one row of the generator expands into; a long grid is many rows, not one long array.
CHUNK = 65_536


def clamp_star(r_star: float, m_star: float) -> tuple[float, float]:
    """A star within the grid's limits (a radius below 0.01 becomes 0.1)."""
    new_r = 0.1 if r_star < 0.01 else min(r_star, 10_000.0)
    new_m = min(max(m_star, 0.01), 1000.0)
    if (new_r, new_m) != (r_star, m_star):
        warnings.warn(f"the star is taken with radius {new_r} and mass {new_m}", stacklevel=2)
    return new_r, new_m


def frequency_law(r_star: float, m_star: float, span: float, oversampling: int, n_transits: int) -> tuple[float, float, int]:
    """(a, c, n): frequency k of n is (a * k + c) ** 3 per second."""
    r, m, s = r_star * P.R_SUN, m_star * P.M_SUN, span * P.DAY
    f_min, f_max = n_transits / s, math.sqrt(P.G * m / (3 * r) ** 3) / (2 * math.pi)
    a = (2 * math.pi) ** (2 / 3) / math.pi * r / (P.G * m) ** (1 / 3) / (s * oversampling)
    c = f_min ** (1 / 3) - a / 3
    return a / 3, c, math.ceil((f_max ** (1 / 3) - f_min ** (1 / 3) + a / 3) * 3 / a)


def settled(r_star: float, m_star: float, span: float, period_min: float = 0.0, period_max: float = math.inf, oversampling: int = 3, n_transits: int = 2) -> tuple[float, float, int, float, float]:
    """The law and the period limits; a grid of fewer than FEW_PERIODS becomes the default star's over five days at least."""
    r_star, m_star = clamp_star(r_star, m_star)
    a, c, n = frequency_law(r_star, m_star, span, oversampling, n_transits)
    # the periods in range are consecutive k: count them by their ends
    inside = 0
    if n > 0:
        at = lambda period: ((1 / (period * P.DAY)) ** (1 / 3) - c) / a
        last = n if period_min <= 0 else min(n, math.ceil(at(period_min)) - 1)
        first = 1 if math.isinf(period_max) else max(1, math.ceil(at(period_max) - 1e-9))
        inside = max(0, last - first + 1)
    if inside < P.FEW_PERIODS and (r_star, m_star, period_min, period_max, oversampling, n_transits) != (1, 1, 0.0, math.inf, 3, 2) or inside < P.FEW_PERIODS and span < 5:
        return settled(1.0, 1.0, max(span, 5.0))
    if inside > 1_000_000:
        warnings.warn(f"the period grid has {inside} periods", stacklevel=2)
    return a, c, n, period_min, period_max


def period_grid(spark: SparkSession, r_star: float, m_star: float, span: float, period_min: float = 0.0, period_max: float = math.inf, oversampling: int = 3, n_transits: int = 2) -> DataFrame:
    """k, period: equal steps in the cube root of frequency, so that a dip's phase drifts alike everywhere; periods descend with k."""
    a, c, n, low, high = settled(r_star, m_star, span, period_min, period_max, oversampling, n_transits)
    k = spark.range(1, n + 1, 1, max(1, -(-n // CHUNK))).select(F.col("id").alias("k"))
    grid = k.select("k", (1 / F.pow(F.lit(a) * F.col("k") + F.lit(c), F.lit(3.0)) / P.DAY).alias("period"))
    return grid.filter((F.col("period") > low) & (F.col("period") <= high))


def t14(r_star: float, m_star: float, period: float, small: bool = False) -> float:
    """The longest dip as a share of the period, on the driver; see functions.columns.t14."""
    s = period * P.DAY
    radius = r_star * P.R_SUN + (0 if small else 2 * P.R_JUP)
    return min(P.UPPER_DURATION, radius * (4 * s / (math.pi * P.G * m_star * P.M_SUN)) ** (1 / 3) / s)


def duration_ends(period_min: float, period_max: float) -> tuple[float, float]:
    return t14(P.R_STAR_MIN, P.M_STAR_MIN, period_max, small=True), t14(P.R_STAR_MAX, P.M_STAR_MAX, period_min)


def durations(period_min: float, period_max: float, step: float = 1.1) -> list[float]:
    """Shares of a period from the shortest to the longest plausible dip by factors of ``step``; the longest closes the list."""
    low, high = duration_ends(period_min, period_max)
    out = [low]
    while (nxt := out[-1] * step) < high:
        out.append(nxt)
    return [*out, high]


def duration_grid(periods: DataFrame, step: float = 1.1) -> DataFrame:
    """row, duration for a table of periods."""
    from lumenfold.functions import columns as C

    ends = periods.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).filter("lo is not null")
    ends = ends.select(C.t14(P.R_STAR_MIN, P.M_STAR_MIN, F.col("hi"), small=True).alias("low"), C.t14(P.R_STAR_MAX, P.M_STAR_MAX, F.col("lo")).alias("high"))
    last = F.ceil(F.log(F.col("high") / F.col("low")) / math.log(step) - 1e-12).cast("int")
    rows = ends.withColumn("last", F.greatest(last, F.lit(1))).select("low", "high", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("row"))
    return rows.select("row", F.when(F.col("row") == F.col("last"), F.col("high")).otherwise(F.col("low") * F.pow(F.lit(step), F.col("row"))).alias("duration"))


def t0_grid(facts: DataFrame, period, signal_length, margin) -> DataFrame:
    """lc_id, i, t0: mid-transit times over one period from min_t, both ends included."""
    points = F.when(F.lit(margin) == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.col("n") / F.lit(margin * signal_length))))
    rows = facts.withColumn("points", points.cast("long")).select("lc_id", "min_t", "points", F.explode(F.expr("sequence(0L, points - 1)")).alias("i"))
    return rows.select("lc_id", "i", (F.col("min_t") + F.col("i") * F.lit(period) / F.greatest(F.col("points") - 1, F.lit(1))).alias("t0"))


def transit_times(found: DataFrame) -> DataFrame:
    """lc_id, n, mid from (lc_id, T0, period, min_t, max_t): T0 (a period later if it precedes the data), then by periods before max_t; one at least."""
    start = F.when(F.col("T0") < F.col("min_t"), F.col("T0") + F.col("period")).otherwise(F.col("T0"))
    more = F.greatest(F.lit(0), F.ceil((F.col("max_t") - F.col("__s")) / F.col("period")).cast("long") - 1)
    rows = found.withColumn("__s", start).select("lc_id", "__s", "period", F.explode(F.sequence(F.lit(0).cast("long"), more)).alias("n"))
    return rows.select("lc_id", "n", (F.col("__s") + F.col("n") * F.col("period")).alias("mid"))


def phase_grid(facts: DataFrame) -> DataFrame:
    """lc_id, i, phase: n phases over one period, shifted by half a step."""
    rows = facts.select("lc_id", "n", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"))
    return rows.select("lc_id", "i", (F.lit(0.5) / F.col("n") + F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))).alias("phase"))


def width_ends(rows: DataFrame, p: P.SearchParams) -> DataFrame:
    """``rows`` (n points, span, period) with low and high, the least and the greatest physically plausible width in points."""
    from lumenfold.functions import columns as C

    seen = F.col("span") / F.col("period")
    low = F.floor(C.t14(p.R_star_min, p.M_star_min, F.col("period"), small=True) * F.col("n"))
    high = F.ceil(C.t14(p.R_star_max, p.M_star_max, F.col("period")) * F.col("n") * (seen + 1) / seen)
    return rows.withColumn("low", low.cast("int")).withColumn("high", high.cast("int"))
