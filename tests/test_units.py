"""Grids, scalar functions, cleaning and validation against known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions import params as P
from lumenfold.functions.params import SearchParams, inclination
from lumenfold.operators import grids, kernel, lightcurve, spectrum, stats, windows
from lumenfold.plans import adapters


def curve(spark, t, y, dy=None):
    rows = [("x", i, None if a is None else float(a), None if b is None else float(b), None if dy is None else float(dy[i])) for i, (a, b) in enumerate(zip(t, y, strict=True))]
    return spark.createDataFrame(rows, "lc_id string, idx long, t double, y double, dy double")


@pytest.mark.parametrize("star, span, high, count, low_period, high_period", [
    ((1, 1), 0.1, math.inf, 268, 0.6002621413799498, 2.5),
    ((1, 1), 20, math.inf, 1716, 0.6015575922909607, 10.0),
    ((5, 1), 20, 999, 1716, 0.6015575922909607, 10.0),
    ((1, 1), 20, 999, 1716, 0.6015575922909607, 10.0),
    ((0.1, 1), 1000, 999, 4308558, None, None),
])
def test_period_grid(spark, star, span, high, count, low_period, high_period):
    got = grids.period_grid(spark, *star, span, 0, high).agg(F.count("k"), F.min("period"), F.max("period")).first()
    assert got[0] == count
    if low_period:
        assert got[1] == pytest.approx(low_period, rel=1e-9) and got[2] == pytest.approx(high_period, rel=1e-9)


def test_duration_grid(spark):
    periods = grids.period_grid(spark, 1, 1, 20)
    rows = [r["duration"] for r in grids.duration_grid(periods, 1.05).orderBy("row").collect()]
    assert len(rows) == 69 and rows[0] == pytest.approx(0.00456269099326832) and rows[-1] == 0.12
    assert np.allclose(rows, grids.durations(0.6015575922909607, 10.0, 1.05))


def test_small_star_is_clamped():
    with pytest.warns(UserWarning):
        assert grids.clamp_star(0.001, 0.001) == (0.1, 0.01)


def test_clean(spark):
    inf, nan = math.inf, math.nan
    lc = curve(spark, [1, 2, 3, 4, 5, 6, 7, 8, nan, 10], [1, None, inf, -inf, nan, -99, 1, 1, 1, 1], [1] * 9 + [inf])
    assert [r["t"] for r in lightcurve.clean(lc, True).orderBy("idx").collect()] == [1, 7, 8]
    assert lightcurve.clean(curve(spark, [0, 1], [1, 0])).count() == 0


def test_validate(spark):
    lc = curve(spark, range(1, 6), [1, 1.1, 0.9, 1, 1], [1, 1, 2, 2, 4])
    assert sum(r["dy"] for r in lightcurve.validate(lc).collect()) == pytest.approx(5)
    bare = lightcurve.validate(curve(spark, range(1, 6), [1, 1.1, 0.9, 1, 1])).collect()
    assert {round(r["dy"], 9) for r in bare} == {round(float(np.std([1, 1.1, 0.9, 1, 1])), 9)}
    assert lightcurve.validate(curve(spark, [1, 2], [1, 1])).count() == 0
    with pytest.raises(ValueError):
        lightcurve.validate(curve(spark, [1, 2], [1, 1]), strict=True)


def test_resample(spark):
    lc = curve(spark, np.linspace(0, 1, 1000), np.linspace(0.99, 1.01, 1000))
    rows = windows.resample(lc, 100).orderBy("i").collect()
    assert np.allclose([r["t"] for r in rows], np.linspace(0, 1, 10)) and np.allclose([r["y"] for r in rows], np.linspace(0.99, 1.01, 10))


def test_false_alarms(spark):
    """1251 efficiencies of 12495 searches in noise, 118 above 7: the published probabilities at 2, 7 and 99."""
    noise = [6.0 + k / 1133 * 0.999 for k in range(1133)] + [7.001 + k / 100 for k in range(118)]
    table = spectrum.false_alarm_table(spark.createDataFrame([(x,) for x in noise] + [(None,)], "sde double"), 12495)
    values = spark.createDataFrame([(2.0,), (7.0,), (99.0,), (noise[1],)], "SDE double")
    got = {r["SDE"]: r["FAP"] for r in spectrum.false_alarm(values, table).collect()}
    assert got[2.0] is None and got[7.0] == pytest.approx(0.009443778, abs=1e-9) and got[99.0] == pytest.approx(8.0032e-05, abs=1e-9) and got[noise[1]] == pytest.approx(1249 / 12495)
    assert spectrum.false_alarm_table(table.limit(0), 12495).count() == 0


def test_running_spectrum_against_loops():
    rng = np.random.default_rng(3)
    chi2 = 1000 - 100 * rng.random(400)
    red, sr, raw, power, sde_raw, sde = spectrum.spectrum_of(chi2, 1000, 3)
    want = chi2.min() / chi2
    top = (1 - want.mean()) / want.std()
    p0 = (want - want.mean()) * top / (1 - want.mean())
    med = [np.median(p0[min(max(i, 45), 354) - 45 : min(max(i, 45), 354) + 46]) for i in range(400)]
    p = p0 - med - (p0 - med).mean()
    assert sde_raw == pytest.approx(top) and np.allclose(raw, p0) and sde == pytest.approx(p.max() / p.std()) and np.allclose(power, p * sde / p.max()) and np.allclose(red, chi2 / 996)
    assert spectrum.spectrum_of(np.full(5, 9.0), 9, 3)[5] == 0.0


def test_false_alarm_table_from_a_file(spark, tmp_path):
    (tmp_path / "fap.csv").write_text("None,5.0\n0.5,6.0\n0.25,7.0\n0.25,inf\n")
    from lumenfold.sources.files import read_false_alarms

    table = read_false_alarms(spark, str(tmp_path / "fap.csv"))
    values = spark.createDataFrame([(4.0,), (5.5,), (6.0,), (8.0,)], "SDE double")
    assert {r["SDE"]: r["FAP"] for r in spectrum.false_alarm(values, table).collect()} == {4.0: None, 5.5: 0.5, 6.0: 0.25, 8.0: 0.25}


@pytest.mark.parametrize("wrong", [{"use_threads": 0}, {"use_threads": "1"}, {"transit_template": "star"}, {"limb_dark": "linear"}, {"duration_grid_step": 1.0}, {"n_transits_min": 0}, {"period_min": 5, "period_max": 2}, {"R_star_min": 2, "R_star_max": 1}])
def test_wrong_parameters_raise(wrong):
    with pytest.raises(ValueError):
        SearchParams.of(**wrong)


def test_parameters():
    with pytest.warns(UserWarning):
        p = SearchParams.of(T0_fit_margin=1.2, nonsense=1)
    assert p.T0_fit_margin == 0.1
    box = SearchParams.of(transit_template="box")
    assert (box.per, box.limb_dark, box.u, box.inc) == (29.0, "linear", (0.0,), 90.0)
    assert SearchParams.of(transit_template="grazing").inc == pytest.approx(inclination(0.99, 23.1))


def test_radius_ratio_needs_its_law(spark):
    with pytest.raises(ValueError):
        C.radius_ratio(F.lit(0.01), "uniform", ())
    with pytest.raises(ValueError):
        C.radius_ratio(F.lit(0.01), "linear", (0.1, 0.2))


def test_transit_times(spark):
    f = spark.createDataFrame([("a", 0.5, 2.0, 1.0, 9.0), ("b", 3.0, 100.0, 1.0, 9.0)], "lc_id string, T0 double, period double, min_t double, max_t double")
    got = {}
    for r in grids.transit_times(f).orderBy("lc_id", "n").collect():
        got.setdefault(r["lc_id"], []).append(r["mid"])
    assert got == {"a": [2.5, 4.5, 6.5, 8.5], "b": [3.0]}


def test_points_wider_than_half_a_period(spark):
    """Windows that overlap give a point to both transits."""
    t = np.arange(1, 10, 0.25)
    lc = curve(spark, t, np.ones(len(t)))
    found = spark.createDataFrame([("x", 2.0, 2.0, 1.0, 9.75)], "lc_id string, period double, T0 double, min_t double, max_t double")
    mids = grids.transit_times(found)
    got = stats.points_by_transit(lc, mids, found, F.lit(1.6)).groupBy("n").count().collect()
    centres = {r["n"]: r["mid"] for r in mids.collect()}
    assert {r["n"]: r["count"] for r in got} == {n: int((abs(t - m) < 1.6).sum()) for n, m in centres.items()}


def test_pink_noise_of_one_point_is_zero(spark):
    rng = np.random.default_rng(7)
    t = np.linspace(1, 31, 40)
    lc = curve(spark, t, 1 + rng.normal(0, 0.3, 40))
    found = spark.createDataFrame([("x", 3.0, 1.5, 0.05)], "lc_id string, period double, T0 double, duration double")
    rows = stats.snr_stats(lc, stats.durations(found, stats.extents(lc))).collect()
    assert max(r["cnt"] for r in rows) == 1 and {r["snr_pink"] for r in rows} == {0.0}


def test_width_ends_are_the_kernels(spark):
    p = P.SearchParams().validated()
    periods = [0.6, 1.0, 3.7, 12.5, 200.0]
    rows = spark.createDataFrame([(4000, 31.0 + x, x) for x in periods], "n long, span double, period double")
    got = {r["period"]: (r["low"], r["high"]) for r in grids.width_ends(rows, p).collect()}
    assert got == {x: kernel.eligible_ends(x, 4000, 31.0 + x, p) for x in periods}


def test_points_are_numbered_across_minutes(spark):
    t = [5.0, 1.0, 1.0, 1.0000001, 3.5, 2.0, 5.0]
    rows = spark.createDataFrame(list(zip(t, [9, 4, 2, 1, 0, 7, 3], strict=True)), "t double, event_id long").repartition(3)
    got = [(r["t"], r["event_id"]) for r in adapters._numbered(rows).orderBy("__row").collect()]
    assert got == sorted(zip(t, [9, 4, 2, 1, 0, 7, 3], strict=True))
    assert [r[0] for r in adapters._numbered(rows).select("__row").orderBy("__row").collect()] == list(range(7))
