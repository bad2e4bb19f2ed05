"""The search as a Spark plan: curves by buckets of periods through the kernel, spectra by windows, then statistics.

A task gets whole curves, in chunks, and, of each, the periods k = bucket modulo the number of buckets, computed from the grid's closed form;
so no period travels, long and short periods mix in every bucket, and one long curve spreads like many short ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions import params as P
from lumenfold.operators import kernel, lightcurve, stats, template
from lumenfold.operators.grids import durations, settled
from lumenfold.operators.lineage import cut
from lumenfold.operators.spectrum import false_alarm, peaks, period_uncertainty, spectra, spectrum_of

SPECTRUM = "lc_id string, period double, chi2 double, row int, depth double"


def _periods(span: float, p: P.SearchParams) -> np.ndarray:
    a, c, n, low, high = settled(p.R_star, p.M_star, span, p.period_min, p.period_max, p.oversampling_factor, p.n_transits_min)
    period = 1 / (a * np.arange(1, n + 1) + c) ** 3 / P.DAY
    return period[(period > low) & (period <= high)]


class _Curve:
    """A curve with its grid and templates, made once per task."""

    def __init__(self, t, y, dy, raw, p: P.SearchParams) -> None:
        self.t, self.y, self.dy = (np.asarray(v, dtype=float) for v in (t, y, dy))
        self.periods = _periods(self.t[-1] - self.t[0], p)
        shares = durations(self.periods.min(), self.periods.max(), p.duration_grid_step)
        # a curve too short for every template has none
        self.templates = template.templates(raw, shares, len(self.t)) if int(max(shares) * len(self.t)) else None
        self.widths, self.rows = np.unique(self.templates.width, return_index=True) if self.templates else (np.array([], int),) * 2
        self.p = p

    def best_of(self, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.templates is None:
            return np.full(len(periods), float(len(self.t))), np.zeros(len(periods), np.int32), np.zeros(len(periods))
        return kernel.best_of(periods, self.t, self.y, self.dy, self.templates, self.widths, self.rows, self.p)


def _search(raw, p: P.SearchParams, buckets: int):
    def run(batches):
        last: tuple[str, _Curve] | None = None
        for (name, bucket), t, y, dy in lightcurve.whole(batches, 2):
            if last is None or last[0] != name:
                last = name, _Curve(t, y, dy, raw, p)
            mine = last[1].periods[bucket::buckets]
            chi2, row, depth = last[1].best_of(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(mine), pa.string()), pa.array(mine), pa.array(chi2, pa.float64()), pa.array(row, pa.int32()), pa.array(depth, pa.float64())], names=["lc_id", "period", "chi2", "row", "depth"])

    return run


def tasks_for(lc: DataFrame) -> int:
    """Tasks of a search among many curves: some for each core, or as many as a shuffle has."""
    spark = lc.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(lc: DataFrame, curves: int) -> int:
    """Parts into which each curve's periods go: one where curves alone keep all tasks busy.

    Each part takes the curve along and makes the templates anew, so a few long curves are in no more than two parts a core together; periods are dealt
    evenly, and equal parts need no more.
    """
    return 1 if curves >= tasks_for(lc) else max(1, -(-2 * lc.sparkSession.sparkContext.defaultParallelism // max(1, curves)))


def _dealt(parts: DataFrame, tasks: int, buckets: int) -> DataFrame:
    """Chunks by curve and bucket, each bucket of a curve in another task, in order of time."""
    work = parts.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    work = work.withColumn("__task", F.pmod(F.xxhash64("lc_id") + F.col("bucket"), F.lit(tasks)).cast("int")).repartitionById(tasks, "__task")
    return work.sortWithinPartitions("lc_id", "bucket", "t0", "idx0").select("lc_id", "bucket", "t", "y", "dy")


def search_spectrum(lc: DataFrame, p: P.SearchParams, buckets: int | None = None) -> DataFrame:
    """lc_id, period, chi2, row, depth for every trial period of validated curves."""
    parts = cut(lightcurve.chunks(lc, tasks_for(lc)))
    return _spectrum(parts, p, buckets or buckets_for(lc, parts.select("lc_id").distinct().count()))


def _spectrum(parts: DataFrame, p: P.SearchParams, buckets: int) -> DataFrame:
    tasks = tasks_for(parts) if buckets == 1 else 2 * parts.sparkSession.sparkContext.defaultParallelism
    return _dealt(parts, tasks, buckets).mapInArrow(_search(template.raw_transit(p), p, buckets), SPECTRUM)


_FIT = "lc_id string, T0 double, duration double"


def _fit_t0(raw, p: P.SearchParams):
    def run(batches):
        for (name, period, depth, row), t, y, dy in lightcurve.whole(batches, 4):
            c = _Curve(t, y, dy, raw, p)
            t0 = kernel.best_t0(c.t, c.y, period, c.templates.signal[row], depth, p.T0_fit_margin)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([t0]), pa.array([c.templates.duration[row]])], names=["lc_id", "T0", "duration"])

    return run


#: What a curve's spectrum comes to: the columns of peaks, the mid-transit fit and the period's uncertainty.
_FOUND = {
    "lc_id": pa.string(), "period": pa.float64(), "depth": pa.float64(), "i": pa.int64(), "power": pa.float64(), "row": pa.int32(), "chi2_min": pa.float64(), "chi2red_min": pa.float64(),
    "SDE": pa.float64(), "SDE_raw": pa.float64(), "fit": pa.bool_(), "T0": pa.float64(), "duration": pa.float64(), "period_uncertainty": pa.float64(),
}
_FOUND_DDL = "lc_id string, period double, depth double, i long, power double, row int, chi2_min double, chi2red_min double, SDE double, SDE_raw double, fit boolean, T0 double, duration double, period_uncertainty double"


def _found(name: str, c: _Curve, p: P.SearchParams) -> tuple:
    """One curve's row of _FOUND: peaks, _fit_t0 and period_uncertainty where the spectrum stands, so that it need not travel."""
    order = np.argsort(c.periods, kind="stable")
    period = c.periods[order]
    chi2, row, depth = (x[order] for x in c.best_of(c.periods))
    red, _, _, power, raw, sde = spectrum_of(chi2, len(c.t), p.oversampling_factor)
    i, low = int(power.argmax()), int(chi2.argmin())
    half = np.flatnonzero(power <= power[i] / 2)
    at = int(np.searchsorted(half, i))
    right = half[at:][half[at:] > i][:1]
    off = float((period[right[0]] - period[half[at - 1]]) / 2) if len(right) and at else np.inf
    fit = bool(chi2.max() > chi2[low])
    at_peak = (float(period[i]), float(depth[i])) if fit else (None, 1.0)
    dip = (kernel.best_t0(c.t, c.y, period[i], c.templates.signal[row[low]], depth[i], p.T0_fit_margin), float(c.templates.duration[row[low]])) if fit else (None, None)
    return name, *at_peak, i, float(power[i]), int(row[low]), float(chi2[low]), float(red.min()), sde, raw, fit, *dip, off


def _search_whole(raw, p: P.SearchParams):
    def run(batches):
        rows = []
        for (name, _), t, y, dy in lightcurve.whole(batches, 2):
            rows.append(_found(name, _Curve(t, y, dy, raw, p), p))
            if len(rows) == 1000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _FOUND.values(), strict=True)], names=list(_FOUND))


def search(lc: DataFrame, p: P.SearchParams | None = None, table: DataFrame | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(result, spectrum): one row per curve with period, T0, duration, depth, SDE, FAP and the transits' statistics; the spectrum behind it.

    ``table`` (row, fap, sde; see :func:`lumenfold.operators.spectrum.false_alarm_table`) gives FAP, which is null without it.
    A curve where nothing was fit has null period and statistics, depth 1, SDE 0 and T0 0; so has one that validation leaves out,
    without a spectrum.
    """
    p = (p or P.SearchParams()).validated()
    given = cut(lc.select("lc_id").distinct())
    lc = cut(lightcurve.validate(lc))
    extent = cut(stats.extents(lc))
    parts = cut(lightcurve.chunks(lc, tasks_for(lc)))
    buckets = buckets or buckets_for(lc, extent.count())
    spectrum = spectra(_spectrum(parts, p, buckets), extent, p.oversampling_factor)
    if buckets == 1:
        # the spectra of many curves outweigh the curves: they stay where they are made, and are made again if asked for
        peak = cut(_dealt(parts, tasks_for(lc), 1).mapInArrow(_search_whole(template.raw_transit(p), p), _FOUND_DDL))
        fitted, unsure = peak.filter("fit").select("lc_id", "T0", "duration"), peak.select("lc_id", "period_uncertainty")
        peak = peak.drop("T0", "duration", "period_uncertainty")
    else:
        spectrum = cut(spectrum)
        peak = cut(peaks(spectrum))
        asked = parts.join(peak.filter("fit").select("lc_id", "period", "depth", "row"), "lc_id").repartition(max(2, lc.sparkSession.sparkContext.defaultParallelism), "lc_id")
        asked = asked.sortWithinPartitions("lc_id", "t0", "idx0").select("lc_id", "period", "depth", "row", "t", "y", "dy")
        fitted, unsure = asked.mapInArrow(_fit_t0(template.raw_transit(p), p), _FIT), period_uncertainty(spectrum, peak)
    found = stats.durations(peak.filter("fit").select("lc_id", "period").join(fitted, "lc_id"), extent)
    found = cut(found)
    law = C.radius_ratio(1 - F.col("depth"), p.limb_dark, p.u) if p.limb_dark in P.RADIUS_LAWS else F.lit(None).cast("double")
    total = cut(stats.summary(lc, found))
    per = cut(stats.snr_stats(lc, found)).groupBy("lc_id").agg(F.sort_array(F.collect_list(F.struct("n", "mid", "cnt", "mean_flux", "err", "snr", "snr_pink"))).alias("transits"))
    out = peak.join(found.select("lc_id", "T0", "duration", "duration_days"), "lc_id", "left").join(unsure, "lc_id", "left").join(total, "lc_id", "left").join(stats.count_stats(lc, found), "lc_id", "left").join(per, "lc_id", "left")
    out = out.withColumn("rp_rs", F.when(F.col("fit"), law))
    out = given.join(out, "lc_id", "left").withColumn("fit", F.coalesce("fit", F.lit(False)))
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("T0", 0.0), ("depth", 1.0), ("SDE", 0.0), ("SDE_raw", 0.0))})
    return (false_alarm(out, table) if table is not None else out.withColumn("FAP", F.lit(None).cast("double"))), spectrum


def search_many_planets(lc: DataFrame, p: P.SearchParams, rounds: int, widen: float = 2.0) -> DataFrame:
    """(round, result..) of repeated searches, each without the points of the dips found before."""
    out = None
    for k in range(rounds):
        result, _ = search(lc, p)
        result = cut(result)  # the next round's plan starts from here
        row = result.withColumn("round", F.lit(k))
        out = row if out is None else out.unionByName(row)
        lc = lightcurve.without_transits(lc, result.filter("fit").select("lc_id", "period", "duration_days", "T0"), widen)
    return out


def compare_templates(lc: DataFrame, p: P.SearchParams, shapes: tuple[str, ...] = ("default", "grazing", "box")) -> DataFrame:
    """One result row per curve and template shape."""
    from dataclasses import replace

    out = None
    for shape in shapes:
        row = search(lc, replace(p, transit_template=shape))[0].withColumn("template", F.lit(shape))
        out = row if out is None else out.unionByName(row)
    return out
