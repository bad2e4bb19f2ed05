"""The named queries over the driver's tables, and their DuckDB equivalents.

Floats are rounded alike on both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions import params as P
from lumenfold.operators import boxsearch, catalog, grids, lightcurve, model, search, spectrum, stats, template, windows
from lumenfold.plans import adapters as A
from lumenfold.sources import files

_queries: dict = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return register


def _r(df: DataFrame, digits: int = 6, **alias: str) -> DataFrame:
    """Doubles rounded."""
    return df.select(*[(F.round(c, digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


E, PL, D, S = A.EVENTS_SQL, A.PLANTED_SQL, A.DAILY_SQL, A.STARS_SQL
PERIOD, T0, SHARE = A.PERIOD, A.T0, A.SHARE

# ---------------------------------------------------------------- cleaning, folding, scalar functions


@query(f"WITH {E} SELECT lc_id, count(*) AS n, round(sum(y), 6) AS total FROM lc WHERE y > 0 AND t > 0 AND isfinite(y) AND isfinite(t) GROUP BY lc_id")
def clean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows with usable values."""
    return _r(lightcurve.clean(A.events(spark, sf_dir)).groupBy("lc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")))


@query(f"""WITH {E}, c AS (SELECT * FROM lc WHERE y > 0), f AS (SELECT lc_id, count(*) AS n, stddev_pop(y) AS s, max(t) - min(t) AS span FROM c GROUP BY lc_id)
SELECT c.lc_id, idx, round(t, 6) AS t, round(y, 6) AS y, round(s, 6) AS dy FROM c JOIN f USING (lc_id) WHERE n >= 3 AND span > 0""")
def validated_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cleaned curves with errors."""
    return _r(lightcurve.validate(A.events(spark, sf_dir)))


@query(f"WITH {E}, x AS (SELECT lc_id, idx, (t - {T0}) / {PERIOD} AS x, t / {PERIOD} AS z FROM lc) SELECT lc_id, idx, round(x - floor(x), 6) AS phase, round(z - floor(z), 6) AS fast FROM x")
def fold_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: phases."""
    return _r(A.events(spark, sf_dir).select("lc_id", "idx", C.fold(F.col("t"), PERIOD, T0).alias("phase"), C.fold(F.col("t"), PERIOD).alias("fast")))


@query(f"WITH {E}, x AS (SELECT lc_id, idx, t - {T0} + {PERIOD} / 2 AS x FROM lc) SELECT lc_id, idx, abs(x - {PERIOD} * floor(x / {PERIOD}) - {PERIOD} / 2) < 0.1 AS in_transit FROM x")
def transit_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which points are in transit."""
    return lightcurve.mask(A.events(spark, sf_dir), PERIOD, 0.2, T0).select("lc_id", "idx", "in_transit")


_T14 = f"least(0.12, (radius * {P.R_SUN} + {{jup}}) * pow(4 * (period * 86400) / (pi() * {P.G} * mass * {P.M_SUN}), 1.0 / 3) / (period * 86400))"


@query(f"WITH {S}, x AS (SELECT *, 1.0 + star_id % 50 AS period FROM stars) SELECT star_id, round({_T14.format(jup=2 * P.R_JUP)}, 6) AS longest, round({_T14.format(jup=0.0)}, 6) AS small FROM x")
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: longest plausible durations."""
    s = A.stars(spark, sf_dir).withColumn("period", 1.0 + F.col("star_id") % 50)
    return _r(s.select("star_id", *[C.t14(F.col("radius"), F.col("mass"), F.col("period"), small).alias(n) for n, small in (("longest", False), ("small", True))]))


@query(f"WITH {S} SELECT star_id, round(degrees(acos((star_id % 10) / 10.0 / (5 + radius))), 6) AS inc FROM stars")
def impact_inclination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: inclination of an impact parameter."""
    return _r(A.stars(spark, sf_dir).select("star_id", C.inclination((F.col("star_id") % 10) / 10.0, 5 + F.col("radius")).alias("inc")))


_LAWS = {"linear": (0.5,), "quadratic": (0.48, 0.19), "squareroot": (0.3, 0.4), "logarithmic": (0.6, 0.2), "nonlinear": (0.1, 0.2, 0.3, 0.1)}
_FACTORS = {"linear": "1 - 0.5/3", "quadratic": "1 - 0.48/3 - 0.19/6", "squareroot": "1 - 0.3/3 - 0.4/5", "logarithmic": "1 + 2*0.2/9 - 0.6/3", "nonlinear": "1 - 0.1/5 - 0.2/3 - 3*0.3/7 - 0.1/2"}


@query(f"WITH {S} SELECT star_id, " + ", ".join(f"round(sqrt((star_id % 100) / 10000.0 * ({f})), 6) AS {law}" for law, f in _FACTORS.items()) + " FROM stars")
def radius_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: planet radii from depths."""
    depth = (F.col("star_id") % 100) / 10000.0
    return _r(A.stars(spark, sf_dir).select("star_id", *[C.radius_ratio(depth, law, u).alias(law) for law, u in _LAWS.items()]))


# ---------------------------------------------------------------- grids


def _grid_sql(span: float, os: int = 3, low: float = 0.0, high: float = math.inf) -> str:
    s, r, m = span * 86400, P.R_SUN, P.M_SUN
    upper = "" if math.isinf(high) else f" AND period <= {high}"
    return f"""c AS (SELECT 2 / {s} AS fmin, 1 / (2 * pi()) * sqrt({P.G} * {m} / pow(3 * {r}, 3)) AS fmax, pow(2 * pi(), 2.0 / 3) / pi() * {r} / pow({P.G} * {m}, 1.0 / 3) / ({s} * {os}) AS a),
n AS (SELECT *, pow(fmin, 1.0 / 3) - a / 3 AS c, CAST(ceil((pow(fmax, 1.0 / 3) - pow(fmin, 1.0 / 3) + a / 3) * 3 / a) AS BIGINT) AS n FROM c),
grid AS (SELECT k, period FROM (SELECT k, 1 / pow(a / 3 * k + c, 3) / 86400 AS period FROM n, LATERAL (SELECT unnest(range(1, n.n + 1)) AS k)) WHERE period > {low}{upper})"""


@query(f"WITH {_grid_sql(20)} SELECT k, round(period, 6) AS period FROM grid")
def period_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: trial periods of a sun-like star over 20 days."""
    return _r(grids.period_grid(spark, 1, 1, 20))


@query(f"WITH {_grid_sql(400, 2, 5, 60)} SELECT k, round(period, 6) AS period FROM grid")
def period_grid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial periods within limits."""
    return _r(grids.period_grid(spark, 1, 1, 400, 5, 60, 2))


@query(f"WITH {_grid_sql(20)} SELECT k, round(period, 6) AS period FROM grid")
def period_grid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: a star so large that the grid is too short takes the default star's."""
    return _r(grids.period_grid(spark, 5, 1, 20, 0, 999))


def _dip_sql(r: float, m: float, period: str, planet: float) -> str:
    return f"least(0.12, ({r} * {P.R_SUN} + {planet}) * pow(4 * ({period} * 86400) / (pi() * {P.G} * {m} * {P.M_SUN}), 1.0 / 3) / ({period} * 86400))"


def _duration_sql(step: float) -> str:
    low, high = _dip_sql(P.R_STAR_MIN, P.M_STAR_MIN, "max(period)", 0.0), _dip_sql(P.R_STAR_MAX, P.M_STAR_MAX, "min(period)", 2 * P.R_JUP)
    return f"""WITH {_grid_sql(20)}, e AS (SELECT {low} AS low, {high} AS high FROM grid), l AS (SELECT *, CAST(ceil(ln(high / low) / ln({step}) - 1e-12) AS INTEGER) AS last FROM e)
SELECT CAST(i AS INTEGER) AS row, round(CASE WHEN i = last THEN high ELSE low * pow({step}, i) END, 6) AS duration FROM l, LATERAL (SELECT unnest(range(0, l.last + 1)) AS i)"""


@query(_duration_sql(1.05))
def duration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial durations."""
    return _r(grids.duration_grid(grids.period_grid(spark, 1, 1, 20), 1.05))


@query(f"""WITH {E}, f AS (SELECT lc_id, count(*) AS n, max(t) - min(t) AS span FROM lc GROUP BY lc_id HAVING max(t) > min(t)), x AS (SELECT lc_id, n, span, span / 2 / (1 + i) AS period FROM f, range(0, 20) r(i))
SELECT lc_id, n, round(period, 6) AS period, CAST(floor({_dip_sql(P.R_STAR_MIN, P.M_STAR_MIN, "period", 0.0)} * n) AS INTEGER) AS low, CAST(ceil({_dip_sql(P.R_STAR_MAX, P.M_STAR_MAX, "period", 2 * P.R_JUP)} * n * (span / period + 1) / (span / period)) AS INTEGER) AS high FROM x""")
def width_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the plausible widths in points at twenty periods of each curve, half its span and its fractions."""
    facts = A.events(spark, sf_dir).groupBy("lc_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span")).filter("span > 0")
    rows = facts.select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i")).withColumn("period", F.col("span") / 2 / F.col("i"))
    return _r(grids.width_ends(rows, P.SearchParams().validated()).select("lc_id", "n", "period", "low", "high"))


@query(f"WITH {E}, f AS (SELECT lc_id, count(*) AS n, min(t) AS lo FROM lc GROUP BY lc_id), p AS (SELECT *, least(n, CAST(floor(n / 0.4) AS BIGINT)) AS m FROM f) SELECT lc_id, i, round(lo + i * {PERIOD} / greatest(m - 1, 1), 6) AS t0 FROM p, LATERAL (SELECT unnest(range(0, p.m)) AS i)")
def t0_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial mid-transit times."""
    return _r(grids.t0_grid(stats.extents(A.events(spark, sf_dir)), PERIOD, 40, 0.01))


_FOUND = f"""f0 AS (SELECT lc_id, count(*) AS n, min(t) AS min_t, max(t) AS max_t FROM lc GROUP BY lc_id),
f1 AS (SELECT *, {PERIOD}::DOUBLE AS period, {T0}::DOUBLE AS t0, {SHARE}::DOUBLE AS duration, CASE WHEN {T0} < min_t THEN {T0}::DOUBLE + {PERIOD} ELSE {T0}::DOUBLE END AS start FROM f0),
mids AS (SELECT lc_id, k AS n, start + k * period AS mid FROM f1, LATERAL (SELECT unnest(range(0, greatest(0, CAST(ceil((f1.max_t - f1.start) / f1.period) AS BIGINT) - 1) + 1)) AS k)),
step AS (SELECT lc_id, median(s) AS step FROM (SELECT lc_id, t - lag(t) OVER (PARTITION BY lc_id ORDER BY t, idx) AS s FROM lc) GROUP BY lc_id),
cnt AS (SELECT lc_id, count(*) AS transits FROM mids GROUP BY lc_id),
found AS (SELECT f1.*, transits, (max_t - min_t) / period / transits AS stretch, (n - 1) / ((max_t - min_t) / step) AS fill,
  duration * ((max_t - min_t) / period / transits) * period * ((n - 1) / ((max_t - min_t) / step)) AS duration_days FROM f1 JOIN cnt USING (lc_id) JOIN step USING (lc_id) WHERE f1.n >= 5)"""


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lc = A.events(spark, sf_dir)
    extent = stats.extents(lc).filter("n >= 5")
    asked = extent.select("lc_id", F.lit(PERIOD).alias("period"), F.lit(T0).alias("T0"), F.lit(SHARE).alias("duration"))
    return lc, stats.durations(asked, extent)


@query(f"WITH {E}, {_FOUND} SELECT lc_id, n, round(mid, 6) AS mid FROM mids")
def transit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-transit times."""
    f = stats.extents(A.events(spark, sf_dir)).select("lc_id", "min_t", "max_t", F.lit(PERIOD).alias("period"), F.lit(T0).alias("T0"))
    return _r(grids.transit_times(f))


@query(f"WITH {E}, f AS (SELECT lc_id, count(*) AS n FROM lc GROUP BY lc_id) SELECT lc_id, i, round(0.5 / n + i / greatest(n - 1, 1), 6) AS phase FROM f, LATERAL (SELECT unnest(range(0, f.n)) AS i)")
def phase_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's phases."""
    return _r(grids.phase_grid(stats.extents(A.events(spark, sf_dir))))


# ---------------------------------------------------------------- sliding operators

_W = 9
_FRAME = "OVER (PARTITION BY lc_id ORDER BY idx ROWS BETWEEN {a} AND {b})"
_AHEAD = _FRAME.format(a="CURRENT ROW", b=f"{_W - 1} FOLLOWING")
_MID = _FRAME.format(a=f"{_W // 2} PRECEDING", b=f"{_W // 2} FOLLOWING")
_FILL = """SELECT lc_id, idx, round(coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY lc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY lc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS """


@query(f"WITH {E}, m AS (SELECT lc_id, idx, avg(y) {_AHEAD} AS mean, count(*) {_AHEAD} AS c FROM lc) SELECT lc_id, idx, round(mean, 6) AS mean FROM m WHERE c = {_W}")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: sliding means."""
    return _r(windows.running_mean(A.events(spark, sf_dir), "y", _W))


@query(f"WITH {E}, m AS (SELECT lc_id, idx, CASE WHEN count(*) {_MID} = {_W} THEN avg(y) {_MID} END AS v FROM lc) {_FILL} mean FROM m")
def running_mean_equal_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding means with padded ends."""
    return _r(windows.running_mean_equal_length(A.events(spark, sf_dir), "y", _W))


@query(f"WITH {D}, m AS (SELECT lc_id, idx, CASE WHEN count(*) {_MID} = {_W} THEN median(y) {_MID} END AS v FROM lc) {_FILL} median FROM m")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding medians with padded ends."""
    return _r(windows.running_median(A.daily(spark, sf_dir), "y", _W))


_RES = f"r AS (SELECT lc_id, idx, pow(1 - y, 2) / pow(0.01, 2) AS r FROM lc)"


@query(f"WITH {D}, {_RES}, w AS (SELECT lc_id, idx, sum(r) {_AHEAD} AS w, count(*) {_AHEAD} AS c, sum(r) OVER (PARTITION BY lc_id) AS total FROM r) SELECT lc_id, idx, round(total - w, 2) AS chi2 FROM w WHERE c = {_W}")
def oot_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals outside each window."""
    return _r(windows.out_of_transit_residuals(A.daily(spark, sf_dir).withColumn("dy", F.lit(0.01)), _W), 2)


@query(f"WITH {D}, {_RES} SELECT lc_id, round(sum(r), 3) AS correction FROM r WHERE idx < 40 GROUP BY lc_id")
def edge_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals that a wrap-around counts twice."""
    return _r(windows.edge_correction(A.daily(spark, sf_dir).withColumn("dy", F.lit(0.01)), 40), 3)


@query(f"WITH {E}, n AS (SELECT lc_id, count(*) AS n FROM lc GROUP BY lc_id) SELECT lc_id, idx, round(y, 6) AS y FROM lc UNION ALL SELECT lc_id, idx + n AS idx, round(y, 6) AS y FROM lc JOIN n USING (lc_id) WHERE idx < {_W}")
def wrap_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves continued by their own beginning."""
    lc = A.events(spark, sf_dir)
    return _r(windows.wrapped(lc, stats.extents(lc), _W).select("lc_id", "idx", "y"))


@query(f"WITH {E}, m AS (SELECT lc_id, stddev_pop(y) {_AHEAD} / sqrt({_W}) AS s, count(*) {_AHEAD} AS c FROM lc) SELECT lc_id, round(avg(s), 6) AS noise FROM m WHERE c = {_W} GROUP BY lc_id")
def pink_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated noise."""
    return _r(windows.pink_noise(A.events(spark, sf_dir), "y", _W))


@query(f"""WITH {D}, f AS (SELECT lc_id, CAST(floor(count(*) / 7.0) AS BIGINT) AS m, min(t) AS lo, max(t) AS hi FROM lc GROUP BY lc_id),
g AS (SELECT lc_id, i, lo + i * (hi - lo) / greatest(m - 1, 1) AS t FROM f, LATERAL (SELECT unnest(range(0, f.m)) AS i)),
k AS (SELECT * FROM (SELECT lc_id, t, y, lead(t) OVER (PARTITION BY lc_id ORDER BY t) AS t2, lead(y) OVER (PARTITION BY lc_id ORDER BY t) AS y2 FROM lc) WHERE t2 IS NOT NULL)
SELECT g.lc_id, g.i, round(g.t, 6) AS t, round(k.y + (g.t - k.t) * (k.y2 - k.y) / (k.t2 - k.t), 6) AS y FROM g ASOF JOIN k ON g.lc_id = k.lc_id AND g.t >= k.t""")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, M7: linear interpolation onto an even grid."""
    return _r(windows.resample(A.daily(spark, sf_dir), 7))


@query(f"""WITH {D}, n AS (SELECT count(*) AS n FROM lc), z AS (SELECT lc_id, idx, y FROM lc UNION ALL SELECT 'daily', -i, 0.0 FROM range(1, 13) t(i) UNION ALL SELECT 'daily', n + i, 0.0 FROM n, range(0, 12) t(i)),
m AS (SELECT lc_id, idx, y, median(y) OVER (PARTITION BY lc_id ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS m FROM z)
SELECT m.lc_id, m.idx, round(m.y / nullif(m, 0), 6) AS y FROM m JOIN n ON m.idx >= 0 AND m.idx < n""")
def median_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves over their median filter."""
    return _r(windows.detrended(A.daily(spark, sf_dir), 25).select("lc_id", "idx", "y"))


@query(f"WITH {E}, f AS (SELECT lc_id, median(y) + 1.5 * stddev_pop(y) AS top FROM lc GROUP BY lc_id) SELECT lc_id, count(*) AS n, round(max(y), 6) AS top FROM lc JOIN f USING (lc_id) WHERE y <= f.top GROUP BY lc_id")
def sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves without high outliers."""
    return _r(windows.clip_upper(A.events(spark, sf_dir), 1.5, 1).groupBy("lc_id").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("top")))


@query(f"WITH {PL}, x AS (SELECT lc_id, y, (t - {T0}) / {PERIOD} AS x FROM lc), b AS (SELECT lc_id, y, least(CAST(floor((x - floor(x)) * 50) AS INTEGER), 49) AS bin FROM x) SELECT lc_id, bin, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std FROM b GROUP BY lc_id, bin")
def binned_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded curve in bins."""
    lc = A.planted(spark, sf_dir).withColumn("phase", C.fold(F.col("t"), PERIOD, T0))
    return _r(windows.binned_phases(lc, "phase", 50))


# ---------------------------------------------------------------- spectra

_CHI = "1000 + 20 * sin(7 * period) - 400 * exp(-pow((period - 3.7) / 0.05, 2))"
_CHI2_SQL = f"{_grid_sql(20)}, s0 AS (SELECT 'x' AS lc_id, period, {_CHI} AS chi2 FROM grid)"
_HALF, _N = 45, 1716
_SPECTRA_SQL = f"""WITH {_CHI2_SQL}, s1 AS (SELECT lc_id, period, chi2, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS m, min(chi2) OVER () / chi2 AS sr FROM s0),
s2 AS (SELECT *, (1 - avg(sr) OVER ()) / stddev_pop(sr) OVER () AS sde_raw, (sr - avg(sr) OVER ()) / (1 - avg(sr) OVER ()) AS q FROM s1), s3 AS (SELECT *, q * sde_raw AS power_raw FROM s2),
s4 AS (SELECT *, CASE WHEN i >= {_HALF} AND i < m - {_HALF} THEN median(power_raw) OVER (ORDER BY period ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING) END AS f FROM s3),
s5 AS (SELECT *, power_raw - coalesce(f, last_value(f IGNORE NULLS) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(f IGNORE NULLS) OVER (ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS d FROM s4),
s6 AS (SELECT *, d - avg(d) OVER () AS p FROM s5), s7 AS (SELECT *, max(p) OVER () / stddev_pop(p) OVER () AS sde, max(p) OVER () AS top FROM s6), s8 AS (SELECT *, p * sde / top AS power FROM s7)
"""


def _chi2(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    g = grids.period_grid(spark, 1, 1, 20)
    chi = 1000 + 20 * F.sin(7 * F.col("period")) - 400 * F.exp(-F.pow((F.col("period") - 3.7) / 0.05, F.lit(2)))
    s = g.select(F.lit("x").alias("lc_id"), "period", chi.alias("chi2"), F.lit(0).alias("row"), (1 - F.col("period") / 1000).alias("depth"))
    return s, spark.createDataFrame([("x", 1000)], "lc_id string, n long")


@query(_SPECTRA_SQL + "SELECT lc_id, i, round(period, 5) AS period, round(chi2 / 996, 5) AS chi2red, round(sr, 5) AS SR, round(power_raw, 5) AS power_raw, round(power, 5) AS power, round(sde_raw, 5) AS SDE_raw, round(sde, 5) AS SDE FROM s8")
def spectra_sde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection efficiency over trial periods."""
    return _r(spectrum.spectra(*_chi2(spark)).select("lc_id", "i", "period", "chi2red", "SR", "power_raw", "power", "SDE_raw", "SDE"), 5)


@query(_SPECTRA_SQL + "SELECT lc_id, round(period, 5) AS period, i, round(power, 5) AS power, (SELECT round(min(chi2), 5) FROM s8) AS chi2_min FROM s8 ORDER BY power DESC, i LIMIT 1")
def peak_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest power and the least chi2."""
    return _r(spectrum.peaks(spectrum.spectra(*_chi2(spark))).select("lc_id", "period", "i", "power", "chi2_min"), 5)


@query(_SPECTRA_SQL + ", b AS (SELECT i AS k, power AS top FROM s8 ORDER BY power DESC, i LIMIT 1) SELECT lc_id, round((min(CASE WHEN i > k AND power <= b.top / 2 THEN period END) - max(CASE WHEN i < k AND power <= b.top / 2 THEN period END)) / 2, 6) AS period_uncertainty FROM s8, b GROUP BY lc_id")
def peak_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak's half width at half power."""
    s = spectrum.spectra(*_chi2(spark)).cache()
    return _r(spectrum.period_uncertainty(s, spectrum.peaks(s)))


@query("""WITH noise AS (SELECT DISTINCT round(5 + value / 50, 3) AS sde FROM events WHERE value >= 50), t AS (SELECT sde, row_number() OVER (ORDER BY sde) - 1 AS i, count(*) OVER () AS m FROM noise),
x AS (SELECT CAST(s_suppkey AS BIGINT) AS star_id, 5.5 + (s_suppkey % 60) / 20.0 AS SDE FROM supplier),
f AS (SELECT x.star_id, x.SDE, min(i) AS i FROM x LEFT JOIN t ON t.sde > x.SDE GROUP BY 1, 2), m AS (SELECT count(*) AS m FROM noise)
SELECT star_id, round(SDE, 6) AS SDE, round(CASE WHEN i = 0 THEN NULL ELSE greatest(1, m - coalesce(i, m)) / 12495.0 END, 9) AS FAP FROM f, m""")
def fap_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-alarm probabilities by a strict as-of lookup in a table of noise searches (here made of the events' values)."""
    noise = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value >= 50").select(F.round(5 + F.col("value") / 50, 3).alias("sde")).distinct()
    v = A.stars(spark, sf_dir).select("star_id", (5.5 + (F.col("star_id") % 60) / 20.0).alias("SDE"))
    return spectrum.false_alarm(v, spectrum.false_alarm_table(noise, 12495)).select("star_id", F.round("SDE", 6).alias("SDE"), F.round("FAP", 9).alias("FAP"))


# ---------------------------------------------------------------- statistics


@query(f"WITH {E}, {_FOUND} SELECT lc_id, transits, round(stretch, 6) AS stretch, round(fill, 6) AS fill, round(duration_days, 6) AS duration_days FROM found")
def durations_in_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretch, fill factor, duration."""
    return _r(_found(spark, sf_dir)[1].select("lc_id", "transits", "stretch", "fill", "duration_days"))


@query(f"""WITH {E}, {_FOUND}, w AS (SELECT m.lc_id, mid, duration_days AS d FROM mids m JOIN found USING (lc_id) WHERE mid - 1.5 * duration_days > min_t AND mid + 1.5 * duration_days < max_t),
c AS (SELECT w.lc_id, sum(CASE WHEN t > mid - d / 2 AND t < mid + d / 2 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN t > mid - 1.5 * d AND t < mid - d / 2 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN t > mid + d / 2 AND t < mid + 1.5 * d THEN 1 ELSE 0 END) AS a
  FROM w JOIN lc ON lc.lc_id = w.lc_id GROUP BY w.lc_id)
SELECT found.lc_id, CAST(coalesce(i, 0) AS BIGINT) AS in_transit_count, CAST(coalesce(b, 0) AS BIGINT) AS before_transit_count, CAST(coalesce(a, 0) AS BIGINT) AS after_transit_count FROM found LEFT JOIN c ON c.lc_id = found.lc_id""")
def count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: points in, before and after transits."""
    return stats.count_stats(*_found(spark, sf_dir))


_COUNTS = ("in_transit_count", "before_transit_count", "after_transit_count")


@query("SELECT lc_id, unnest([" + ", ".join(f"'{c}'" for c in _COUNTS) + "]) AS key, unnest([" + ", ".join(f"CAST({c} AS VARCHAR)" for c in _COUNTS) + f"]) AS value FROM ({_oracles['count_stats']})")
def statistics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as one line a key."""
    return files.statistics(count_stats(spark, sf_dir))


_IN = "p AS (SELECT m.lc_id, m.n, m.mid, lc.y FROM mids m JOIN found f ON f.lc_id = m.lc_id JOIN lc ON lc.lc_id = m.lc_id AND t > mid - f.duration_days / 2 AND t < mid + f.duration_days / 2)"


@query(f"WITH {E}, {_FOUND}, {_IN}, g AS (SELECT lc_id, n, count(*) AS cnt, avg(y) AS mean_flux, stddev_pop(y) / sqrt(count(*)) AS err FROM p GROUP BY lc_id, n) SELECT m.lc_id, m.n, round(mid, 6) AS mid, coalesce(cnt, 0) AS cnt, round(mean_flux, 6) AS mean_flux, round(err, 6) AS err FROM mids m JOIN found USING (lc_id) LEFT JOIN g ON g.lc_id = m.lc_id AND g.n = m.n")
def intransit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: each transit's points."""
    return _r(stats.intransit_stats(*_found(spark, sf_dir)))


_PAR = "avg(y) FILTER (n % 2 {op} 0) AS depth_mean_{name}, CASE WHEN count(*) FILTER (n % 2 {op} 0) > 0 THEN stddev_pop(y) FILTER (n % 2 {op} 0) / sqrt(count(*) FILTER (n % 2 {op} 0)) END AS depth_mean_{name}_std"
_DEPTH = f"g AS (SELECT lc_id, avg(y) AS depth_mean, stddev_pop(y) / sqrt(count(*)) AS depth_mean_std, count(*) AS points, {_PAR.format(op='=', name='even')}, {_PAR.format(op='<>', name='odd')} FROM p GROUP BY lc_id)"


@query(f"WITH {E}, {_FOUND}, {_IN}, {_DEPTH} SELECT f.lc_id, points, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("depth_mean", "depth_mean_std", "depth_mean_even", "depth_mean_even_std", "depth_mean_odd", "depth_mean_odd_std")) + ", round(abs(depth_mean_odd - depth_mean_even) / nullif(depth_mean_odd_std + depth_mean_even_std, 0), 5) AS odd_even_mismatch FROM found f LEFT JOIN g ON g.lc_id = f.lc_id")
def odd_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean depths of all, odd and even transits."""
    d = stats.depth_stats(*_found(spark, sf_dir))
    return _r(d.drop("odd_even_mismatch")).join(d.select("lc_id", F.round("odd_even_mismatch", 5).alias("odd_even_mismatch")), "lc_id")


_OUT = f"o AS (SELECT * FROM (SELECT lc.lc_id, idx, t, y, t - {T0} + {PERIOD} / 2 AS x FROM lc JOIN found USING (lc_id)) WHERE NOT abs(x - {PERIOD} * floor(x / {PERIOD}) - {PERIOD} / 2) < {SHARE})"


@query(f"""WITH {E}, {_FOUND}, {_IN}, {_OUT}, g AS (SELECT lc_id, n, count(*) AS cnt, avg(y) AS mean_flux FROM p GROUP BY lc_id, n), per AS (SELECT m.lc_id, m.n, coalesce(cnt, 0) AS cnt, mean_flux FROM mids m JOIN found USING (lc_id) LEFT JOIN g ON g.lc_id = m.lc_id AND g.n = m.n),
w AS (SELECT lc_id, greatest(1, CAST(floor(avg(cnt)) AS BIGINT)) AS w FROM per GROUP BY lc_id), k AS (SELECT o.*, row_number() OVER (PARTITION BY lc_id ORDER BY t, idx) AS k FROM o),
win AS (SELECT a.lc_id, a.k, any_value(w) AS w, stddev_pop(b.y) AS s, count(*) AS c FROM k a JOIN w ON w.lc_id = a.lc_id JOIN k b ON b.lc_id = a.lc_id AND b.k >= a.k AND b.k < a.k + w GROUP BY a.lc_id, a.k),
pink AS (SELECT lc_id, avg(s / sqrt(w)) AS pink FROM win WHERE c = w GROUP BY lc_id), white AS (SELECT lc_id, stddev_pop(y) AS white FROM o GROUP BY lc_id)
SELECT per.lc_id, n, cnt, round(coalesce((1 - mean_flux) * sqrt(cnt) / nullif(white, 0), 0), 4) AS snr, round(coalesce((1 - mean_flux) / nullif(CASE WHEN w.w = 1 THEN 0 ELSE pink END, 0), 0), 4) AS snr_pink FROM per LEFT JOIN pink USING (lc_id) LEFT JOIN white USING (lc_id) LEFT JOIN w USING (lc_id)""")
def snr_per_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transit's signal to noise."""
    return _r(stats.snr_stats(*_found(spark, sf_dir)).select("lc_id", "n", "cnt", "snr", "snr_pink"), 4)


@query(f"""WITH {E}, {_FOUND}, {_IN}, {_OUT}, {_DEPTH}, s AS (SELECT lc_id, stddev_pop(y) AS s FROM o GROUP BY lc_id), c AS (SELECT m.lc_id, count(DISTINCT m.n) AS transit_count, count(DISTINCT CASE WHEN p.y IS NOT NULL THEN m.n END) AS distinct_transit_count FROM mids m JOIN found USING (lc_id) LEFT JOIN p ON p.lc_id = m.lc_id AND p.n = m.n GROUP BY m.lc_id)
SELECT f.lc_id, round((1 - depth_mean) / nullif(s, 0) * sqrt(points), 5) AS snr, transit_count, transit_count - distinct_transit_count AS empty_transit_count, distinct_transit_count FROM found f JOIN c USING (lc_id) LEFT JOIN g USING (lc_id) LEFT JOIN s USING (lc_id)""")
def snr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall signal to noise, and transits with and without points."""
    return _r(stats.summary(*_found(spark, sf_dir)).select("lc_id", "snr", "transit_count", "empty_transit_count", "distinct_transit_count"), 5)


@query(f"WITH {E}, {_FOUND}, x AS (SELECT lc.lc_id, idx, y, (t - ({T0} + {PERIOD} / 2)) / {PERIOD} AS x FROM lc JOIN found USING (lc_id)) SELECT lc_id, idx, round(x - floor(x), 6) AS phase, round(y, 6) AS y FROM x")
def folded_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: curves folded with mid-transit at phase 1/2."""
    return _r(stats.folded(*_found(spark, sf_dir)).select("lc_id", "idx", "phase", "y"))


# ---------------------------------------------------------------- catalogs, searches


_LD_SQL = f"""WITH {S}, ld AS (SELECT i AS ld_row, 2300.0 + floor(i / 10) * 250 AS teff, 0.5 * (i % 10) AS logg FROM range(0, 320) t(i) WHERE i % 7 <> 3),
a AS (SELECT star_id, s.logg, ld.teff, row_number() OVER (PARTITION BY star_id ORDER BY abs(ld.teff - s.teff), ld_row) AS k FROM stars s, ld),
b AS (SELECT star_id, ld.teff, ld.logg, row_number() OVER (PARTITION BY star_id ORDER BY abs(ld.logg - a.logg), ld_row) AS k2 FROM a JOIN ld ON a.k = 1 AND ld.teff = a.teff)
SELECT star_id, round(0.9 - teff / 20000, 6) AS a, round(0.1 + logg / 20, 6) AS b FROM b WHERE k2 = 1"""


@query(_LD_SQL)
def ld_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: limb-darkening coefficients of the nearest tabulated star."""
    return _r(catalog.nearest_darkening(A.stars(spark, sf_dir), A.darkening(spark)).select("star_id", "a", "b"))


_STAR = 7


@query(f"WITH {S}, ld AS ({_LD_SQL}) SELECT star_id, a, b, " + ", ".join(f"round({c} {d}, 6) AS {c}{e}" for c in ("mass", "radius") for d, e in (("", ""), ("- 0.05", "_min"), ("+ 0.05", "_max"))) + f" FROM stars JOIN ld USING (star_id) WHERE star_id = {_STAR}")
def catalog_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One star of a catalog that is given, with its limits and limb darkening."""
    known = A.stars(spark, sf_dir).select("*", *[(F.col(c) + d).alias(f"{c}{e}") for c in ("mass", "radius") for d, e in ((-0.05, "_min"), (0.05, "_max"))])
    return _r(catalog.catalog_info(known, A.darkening(spark), TIC_ID=_STAR))


_WIDTHS = (5, 9, 14)
_BOX_PERIODS = "periods AS (SELECT i AS k, 3.2::DOUBLE + 0.02 * i AS period FROM range(0, 50) t(i))"
_BOX_N = 400


#: The first _BOX_N points alone, against which tests check the operator; the query runs over the whole curve and has no SQL.
BOX_PREFIX_SQL = f"""WITH {PL}, c AS (SELECT lc_id, idx, t, 1 - y AS d, 1 / pow(0.002, 2) AS iv FROM lc WHERE idx < {_BOX_N}), {_BOX_PERIODS},
f AS (SELECT lc_id, k, period, idx, d, iv, t / period - floor(t / period) AS phase FROM c, periods), r AS (SELECT *, row_number() OVER (PARTITION BY lc_id, k ORDER BY phase, idx) - 1 AS i, count(*) OVER (PARTITION BY lc_id, k) AS n FROM f),
p AS (SELECT lc_id, k, period, n, i, d, iv FROM r UNION ALL SELECT lc_id, k, period, n, i + n, d, iv FROM r WHERE i < {max(_WIDTHS)}), tot AS (SELECT lc_id, k, sum(d * d * iv) AS total FROM r GROUP BY lc_id, k),
q AS (""" + " UNION ALL ".join(f"SELECT lc_id, k, n, i, {w} AS width, avg(d) OVER w AS m, sum(d * iv) OVER w AS b, sum(iv) OVER w AS c, count(*) OVER w AS held FROM p WINDOW w AS (PARTITION BY lc_id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)" for w in _WIDTHS) + """),
x AS (SELECT q.lc_id, q.k, n, width, 1 - m AS depth, total - 2 * m * b + m * m * c AS chi2 FROM q JOIN tot USING (lc_id, k) WHERE held = width AND m > 10e-6), y AS (SELECT lc_id, k, min(chi2) AS chi2, arg_min(width, chi2) AS width, arg_min(depth, chi2) AS depth FROM x WHERE chi2 < n GROUP BY lc_id, k)
SELECT 'planted' AS lc_id, periods.k, round(period, 6) AS period, round(coalesce(y.chi2, (SELECT max(n) FROM r)), 3) AS chi2, CAST(coalesce(width, 0) AS INTEGER) AS width, round(coalesce(depth, 0.0), 6) AS depth FROM periods LEFT JOIN y ON y.k = periods.k"""


def box_rows(lc: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """The best box at each trial period, rounded."""
    periods = lc.sparkSession.range(0, 50).select(F.col("id").alias("k"), (3.2 + 0.02 * F.col("id")).alias("period"))
    b = boxsearch.box_search(lc.withColumn("dy", F.lit(0.002)), periods, widths)
    return b.select("lc_id", "k", F.round("period", 6).alias("period"), F.round("chi2", 3).alias("chi2"), "width", F.round("depth", 6).alias("depth"))


@query()
def box_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8, C1-C8 with a flat box: the search over the whole planted curve, with every plausible dip's width in points."""
    lc = A.planted(spark, sf_dir)
    n = lc.count()
    return box_rows(lc, tuple(sorted({max(1, int(d * n)) for d in grids.durations(3.2, 4.18)})))


#: Every registered search takes the grid's full range of periods.
PARAMS = P.SearchParams()


@query()
def search_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over the planted curve."""
    result, _ = search.search(A.planted(spark, sf_dir), PARAMS)
    return result


@query()
def search_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chi2 over trial periods."""
    return search.search_spectrum(lightcurve.validate(A.planted(spark, sf_dir)), PARAMS)


@query()
def many_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 over many curves at once: every user's own."""
    lc = A.events(spark, sf_dir)
    flat = lc.withColumn("y", 1 + (F.col("y") - 1) / 100)
    return search.search(flat, PARAMS)[0].select("lc_id", "period", "SDE", "FAP", "T0", "duration", "depth")


@query()
def two_planets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: a second search without the first dip's points."""
    return search.search_many_planets(A.planted(spark, sf_dir), PARAMS, 2).select("lc_id", "round", "period", "T0", "SDE", "depth")


@query()
def template_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default, grazing and box templates on one curve."""
    return search.compare_templates(A.planted(spark, sf_dir), PARAMS).select("lc_id", "template", "period", "chi2_min", "SDE", "duration")


@query()
def template_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates of a curve of 2000 points."""
    tm = template.templates(template.raw_transit(P.SearchParams().validated()), grids.durations(1.0, 10.0), 2000)
    rows = [(k, float(d), int(w), float(o), s.tolist()) for k, (d, w, o, s) in enumerate(zip(tm.duration, tm.width, tm.overshoot, tm.signal, strict=True))]
    return spark.createDataFrame(rows, "row int, duration double, width_in_samples int, overshoot double, signal array<double>")


@query()
def model_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: the model over the planted curve's span."""
    extent = stats.extents(A.planted(spark, sf_dir))
    found = stats.durations(extent.select("lc_id", F.lit(PERIOD).alias("period"), F.lit(T0).alias("T0"), F.lit(SHARE).alias("duration")), extent).withColumn("depth", F.lit(0.99))
    return model.model_light_curve(found, P.SearchParams())


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict:
    return dict(_oracles)
