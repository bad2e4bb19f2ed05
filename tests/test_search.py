"""Kernels against double loops, and whole searches against known results."""

import numpy as np
import pytest

from lumenfold.functions.params import SearchParams
from lumenfold.operators import kernel, lightcurve, model, search, template
from lumenfold.plans import registry

WANTED = 365.2582192473641


def synthetic(noise=True):
    np.random.seed(0)
    n = int(365.25 * 3 * 12)
    t = np.linspace(48, 48 + 365.25 * 3, n)
    y = template.dimmed(template.separation(t - 68, 365.25, 217, 90), 6371 / 696342, "linear", (0.5,))
    return t, y + np.random.normal(0, 5e-6, n) if noise else y


@pytest.fixture(scope="module")
def raw():
    return template.raw_transit(SearchParams().validated())


def slow_best(period, t, y, dy, tm, widths, rows, p):
    n = len(t)
    order = np.argsort((t / period) % 1, kind="stable")
    m = tm.maxwidth
    y, e = (np.concatenate([v[order], v[order][:m]]) for v in (y, dy))
    edge = sum((1 - y[i]) ** 2 / e[i] ** 2 for i in range(n, n + m))
    best = (np.inf, 0, 0.0)
    for w in kernel.eligible(widths, period, n, t[-1] - t[0], p):
        row = int(rows[list(widths).index(w)])
        s, found = tm.signal[row], (float(n), 0, 0.0)
        for i in range(len(y) - w + 1):
            mean = (1 - y[i : i + w]).mean()
            if mean > p.transit_depth_min and i % kernel.stride(int(w), p.T0_fit_margin) == 0:
                k = mean * tm.overshoot[row] / 0.5
                chi = sum((y[i + j] - (1 - (1 - s[j]) * k)) ** 2 / e[i + j] ** 2 for j in range(len(s)))
                chi += sum((1 - y[j]) ** 2 / e[j] ** 2 for j in range(len(y)) if not i <= j < i + w) - edge
                if chi < found[0]:
                    found = chi, row, 1 - mean * tm.overshoot[row]
        if found[0] < best[0]:
            best = found
    return best


@pytest.mark.parametrize("seed, n, varied", [(0, 90, False), (1, 120, True), (2, 70, True)])
def test_kernel_against_loops(raw, seed, n, varied):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(1, 21, n))
    y = 1 + rng.normal(0, 1e-3, n) - 0.01 * (np.abs((t - 2) % 3 - 0.1) < 0.12)
    dy = rng.uniform(0.5e-3, 2e-3, n) if varied else np.full(n, y.std())
    p = SearchParams(period_min=2, period_max=5).validated()
    c = search._Curve(t, y, dy, raw, p)
    for period in (2.2, 3.0, 4.7):
        fast = kernel.best_at(period, c.t, c.y, c.dy, c.templates, c.widths, c.rows, p)
        slow = slow_best(period, t, y, dy, c.templates, c.widths, c.rows, p)
        assert fast[0] == pytest.approx(slow[0], rel=1e-9) and fast[1] == slow[1] and fast[2] == pytest.approx(slow[2])


@pytest.mark.parametrize("varied", [False, True])
@pytest.mark.parametrize("margin", [0.01, 0.1])
def test_periods_together_and_one_by_one(raw, varied, margin):
    rng = np.random.default_rng(9)
    t = np.sort(rng.uniform(1, 31, 400))
    y = 1 + rng.normal(0, 1e-3, 400) - 0.01 * (np.abs((t - 2) % 3 - 0.1) < 0.12)
    dy = rng.uniform(0.5e-3, 2e-3, 400) if varied else np.full(400, y.std())
    p = SearchParams(T0_fit_margin=margin).validated()
    c = search._Curve(t, y, dy, raw, p)
    periods = c.periods[::40]
    chi2, row, depth = c.best_of(periods)
    one = [kernel.best_at(x, c.t, c.y, c.dy, c.templates, c.widths, c.rows, p) for x in periods]
    assert np.allclose(chi2, [o[0] for o in one], rtol=1e-9) and np.allclose(depth, [o[2] for o in one]) and row.tolist() == [o[1] for o in one]


def test_sliding_product_by_transform(monkeypatch):
    x, s = np.random.default_rng(0).normal(size=500), np.random.default_rng(1).normal(size=40)
    direct = kernel.sliding_product(x, s)
    monkeypatch.setattr(kernel, "TRANSFORM", 1)
    kept = {}
    for _ in range(2):
        assert np.allclose(kernel.sliding_product(x, s, {}, kept, "s"), direct)
    assert len(kept) == 1 and kernel.fast_size(112_001) == 112_500 and kernel.fast_size(1) == 1


def test_t0_against_sorting(raw):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(10, 40, 300))
    y = 1 + rng.normal(0, 1e-3, 300) - 0.01 * (np.abs((t - 11) % 3 - 1.5) > 1.42)
    signal, depth, period = np.array([0.9, 0.6, 0.5, 0.6, 0.9]), 0.99, 3.0
    grid, best = np.linspace(t.min(), t.min() + period, 300), (np.inf, 0.0)
    model = 1 - (1 - signal) * (1 - depth) / 0.5
    for t0 in grid:
        x = (t - t0) / period
        f = y[np.argsort(x - np.floor(x), kind="stable")]
        f = np.roll(f, 3)
        w = np.roll(f, 3)
        r = (((f[:5] - model) / w[:5]) ** 2).sum() + (((f[5:] - 1) / w[5:]) ** 2).sum()
        if r < best[0]:
            best = r, t0
    assert kernel.best_t0(t, y, period, signal, depth, 0) == pytest.approx(best[1])


@pytest.mark.parametrize(("n", "duration", "maxwidth", "fill", "stretch", "depth"), [(1000, 0.02, 40, 1.0, 1.0, 0.99), (777, 0.05, 30, 0.6, 1.0, 0.999), (2000, 0.01, 50, 0.9, 3.0, 0.98)])
def test_folded_model(raw, n, duration, maxwidth, fill, stretch, depth):
    phase, flux = model.folded_model(n, duration, maxwidth, fill, stretch, depth, raw)
    assert len(phase) == len(flux) == n and phase[0] == pytest.approx(0.5 / n) and phase[-1] == pytest.approx(1 + 0.5 / n)
    assert flux.max() == 1 and flux.min() == pytest.approx(depth, abs=1e-4)
    dip = np.flatnonzero(flux < 1)
    assert (np.diff(dip) == 1).all() and abs((dip[0] + dip[-1]) / 2 - n / 2) <= 2
    # as wide as the duration times the stretch and half of what the fill leaves
    assert len(dip) == pytest.approx(min(1.0, duration * stretch * (1 + fill) / 2) * n, abs=0.1 * n * duration * stretch + 3)


def test_disc_against_analytic_limits():
    z = np.array([0.0, 0.3, 0.85, 1.2])
    assert np.allclose(template.dimmed(z, 0.1, "uniform", ())[:3], 1 - 0.01, atol=1e-9) and template.dimmed(z, 0.1, "uniform", ())[3] == 1
    # a small planet in the centre hides the central intensity's share
    assert 1 - template.dimmed(np.array([0.0]), 1e-3, "quadratic", (0.4, 0.2))[0] == pytest.approx(1e-6 / (1 - 0.4 / 3 - 0.2 / 6), rel=1e-4)


def test_whole_search_of_a_year(spark):
    """Period, chi2 and mid-transit time of a three-year synthetic curve."""
    t, y = synthetic()
    y[1] = np.nan
    rows = [("year", i, float(a), float(b), None) for i, (a, b) in enumerate(zip(t, y, strict=True))]
    lc = spark.createDataFrame(rows, "lc_id string, idx long, t double, y double, dy double")
    p = SearchParams(transit_depth_min=10e-6, oversampling_factor=5, duration_grid_step=1.02, period_min=360, period_max=370)
    result, spectrum = search.search(lc, p)
    r = result.first()
    assert spectrum.count() == 278 and r["transit_count"] == 3
    assert r["period"] == pytest.approx(WANTED, abs=1e-5) and r["T0"] == pytest.approx(68.00349264912924, abs=1e-5)
    assert r["chi2_min"] == pytest.approx(8831.654060613922, rel=1e-4) and r["chi2red_min"] == pytest.approx(0.6719152511118321, rel=1e-4)
    assert r["period_uncertainty"] == pytest.approx(0.216212529678387, rel=1e-3)
    # the planet's own ratio
    assert r["rp_rs"] == pytest.approx(6371 / 696342, abs=1e-4)


def searched(spark, name, t, y, dy, p):
    rows = [(name, i, float(a), float(b), None if dy is None else float(dy[i])) for i, (a, b) in enumerate(zip(t, y, strict=True))]
    return search.search(spark.createDataFrame(rows, "lc_id string, idx long, t double, y double, dy double"), p)[0].first()


def test_whole_search_with_a_gap(spark):
    """The first of three dips is missing."""
    t, y = synthetic()
    y[1] = np.nan
    y[200:500] = t[200:500] = np.nan
    r = searched(spark, "gap", t, y, None, SearchParams.of(period_min=360, period_max=370, transit_depth_min=10e-6, oversampling_factor=2, duration_grid_step=1.1, T0_fit_margin=1.2))
    near = lambda name, value, by: r[name] == pytest.approx(value, abs=by)
    assert near("period", 365.22218620040417, 1.5e-5) and near("period_uncertainty", 0.3153203546531813, 1.5e-5) and near("depth", 0.9998972750356973, 1.5e-5) and near("duration_days", 0.41845319797978703, 1.5e-5)
    assert near("SDE", 4.243572802600693, 1.5e-3) and near("odd_even_mismatch", 0.15059221218811772, 1.5e-3) and near("rp_rs", 0.009114758081257387, 1.5e-3) and near("snr", 52.050323372452034, 1.5e-3)
    assert r["rp_rs"] == pytest.approx(((1 - r["depth"]) * (1 - 0.4804 / 3 - 0.1867 / 6)) ** 0.5, rel=1e-3)
    assert near("depth_mean", 0.999917, 1.5e-5) and near("depth_mean_even", 0.999915, 1.5e-5) and near("depth_mean_odd", 0.99992, 1.5e-5) and near("depth_mean_odd_std", 1.209993e-05, 1.5e-5)
    assert (r["transit_count"], r["distinct_transit_count"], r["empty_transit_count"]) == (3, 2, 1)
    per = r["transits"]
    assert [x["cnt"] for x in per] == [0, 5, 5] and np.allclose([x["mid"] for x in per], [68.08637, 433.30855, 798.53074], atol=1.5e-5)
    assert np.allclose([x["snr"] for x in per], [0, 37.052, 36.558], atol=1.5e-3) and np.allclose([x["snr_pink"] for x in per], [0, 45.477, 44.871], atol=1.5e-3)
    assert per[0]["mean_flux"] is None and np.allclose([x["mean_flux"] for x in per[1:]], [0.99991, 0.9999], atol=2e-5) and np.allclose([x["err"] for x in per[1:]], [2.92371e-06, 4.48803e-06], atol=1e-5)


def test_whole_search_with_errors(spark):
    """Noise ten times as large in the last quarter, and errors that say so."""
    t, y = synthetic()
    y[10000:] += np.random.normal(0, 50e-6, 3149)
    dy = np.full(len(y), 5e-6)
    dy[10000:] *= 10
    r = searched(spark, "dy", t, y, dy, SearchParams.of(period_min=360, period_max=370, oversampling_factor=3, duration_grid_step=1.05, T0_fit_margin=0.2))
    assert r["SDE"] == pytest.approx(5.292594615900944, abs=1.5e-5)


def test_curve_where_nothing_fits(spark):
    t, y = synthetic()
    y[1] = np.nan
    rows = [("flat", i, float(a), float(b), None) for i, (a, b) in enumerate(zip(t, y, strict=True))]
    lc = spark.createDataFrame(rows, "lc_id string, idx long, t double, y double, dy double")
    p = SearchParams(transit_depth_min=1000e-6, oversampling_factor=5, duration_grid_step=1.02, period_min=360, period_max=370, T0_fit_margin=0.1)
    result, spectrum = search.search(lc, p)
    r = result.first()
    s = spectrum.orderBy("period").collect()
    assert (r["period"], r["depth"], r["SDE"], r["T0"], r["chi2_min"]) == (None, 1.0, 0.0, 0.0, 13148.0)
    assert r["chi2red_min"] == pytest.approx(1.0003043213633598) and len(s) == 278
    assert s[0]["period"] == pytest.approx(360.0118189140635) and s[-1]["period"] == pytest.approx(369.9831654894093)


def test_masking_finds_the_second_planet(spark):
    rng = np.random.default_rng(3)
    t = np.linspace(1, 41, 1600)
    y = 1 + rng.normal(0, 3e-4, 1600) - 0.01 * (np.abs((t - 2.1 + 1.6) % 3.2 - 1.6) < 0.07) - 0.006 * (np.abs((t - 3 + 2.35) % 4.7 - 2.35) < 0.08)
    lc = spark.createDataFrame([("two", i, float(a), float(b), None) for i, (a, b) in enumerate(zip(t, y, strict=True))], "lc_id string, idx long, t double, y double, dy double")
    found = search.search_many_planets(lc, SearchParams(period_min=2.8, period_max=5.2), 2).orderBy("round").collect()
    assert found[0]["period"] == pytest.approx(3.2, abs=0.03) and found[1]["period"] == pytest.approx(4.7, abs=0.03)


def test_mask_is_removed(spark):
    lc = spark.createDataFrame([("x", i, float(i), 1.0, None) for i in range(1, 11)], "lc_id string, idx long, t double, y double, dy double")
    found = spark.createDataFrame([("x", 5.0, 1.0, 2.0)], "lc_id string, period double, duration_days double, T0 double")
    assert sorted(r["t"] for r in lightcurve.without_transits(lc, found).collect()) == [1, 3, 4, 5, 6, 8, 9, 10]


def test_queries_search_every_point(spark, monkeypatch):
    """A curve longer than 4,000 points reaches the search as it is."""
    seen = []
    monkeypatch.setattr(search, "search", lambda lc, *a, **k: (seen.append(lc.count()) or lc, None))
    registry.queries()["search_result"](spark, "/root/testdata/sf0.01")
    assert seen == [10_000]


def test_t0_of_a_long_curve_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(1, 32, 6000))
    y = 1 + rng.normal(0, 1e-3, 6000) - 0.01 * (np.abs((t - 2.5 + 1.85) % 3.7 - 1.85) < 0.1)
    signal = np.full(324, 0.5)
    whole = kernel.best_t0(t, y, 3.7, signal, 0.99, 0.01)
    monkeypatch.setattr(kernel, "BLOCK", 1000)
    assert kernel.best_t0(t, y, 3.7, signal, 0.99, 0.01) == whole == pytest.approx(2.5, abs=0.1)


def test_short_curves_have_a_row(spark):
    """45 points are searched; 5 are too few for any template, 2 for validation."""
    rng = np.random.default_rng(6)
    rows = [(name, i, float(t), float(1 + rng.normal(0, 1e-3)), None) for name, n in (("a45", 45), ("b5", 5), ("c2", 2)) for i, t in enumerate(np.linspace(1, 31, n))]
    lc = spark.createDataFrame(rows, "lc_id string, idx long, t double, y double, dy double")
    result, spectrum = search.search(lc, SearchParams(period_min=2, period_max=6))
    got = {r["lc_id"]: r for r in result.collect()}
    assert set(got) == {"a45", "b5", "c2"} and got["a45"]["fit"] and got["a45"]["period"] is not None
    for name in ("b5", "c2"):
        r = got[name]
        assert (r["fit"], r["period"], r["depth"], r["SDE"], r["T0"], r["duration"]) == (False, None, 1.0, 0.0, 0.0, None)
    assert got["b5"]["chi2_min"] == 5.0 and {r["lc_id"] for r in spectrum.select("lc_id").distinct().collect()} == {"a45", "b5"}


def test_many_curves_has_every_user(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "search", lambda lc, *a, **k: (seen.append(lc.select("lc_id").distinct().count()) or lc.selectExpr("lc_id", "0 period", "0 SDE", "0 FAP", "0 T0", "0 duration", "0 depth"), None))
    registry.queries()["many_curves"](spark, "/root/testdata/sf0.001")
    assert seen == [15]


def long_curve(n, dip=0.01, seed=8):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(1, 31, n))
    return t, 1 + 1e-3 * (rng.exponential(50, n) - 49) / 49 - dip * (np.abs((t - 1.5 + 1.85) % 3.7 - 1.85) < 0.1), rng


@pytest.mark.parametrize(("dip", "varied"), [(0.01, False), (0.0, False), (0.01, True)])
def test_bounds_lose_nothing_and_leave_few_places(raw, monkeypatch, dip, varied):
    """Against every place of every width; on a curve with a dip few places are worked out in full."""
    t, y, rng = long_curve(20_000, dip)
    dy = rng.uniform(0.5, 2, len(t)) * y.std() if varied else np.full(len(t), y.std())
    p = SearchParams().validated()
    c = search._Curve(t, y, dy, raw, p)
    done, places, own = [], 0, kernel.products_at
    monkeypatch.setattr(kernel, "products_at", lambda x, s, at, *a: done.append(len(at)) or own(x, s, at, *a))
    for period in (3.7, 1.234, 7.7):
        got = kernel.best_at(period, c.t, c.y, c.dy, c.templates, c.widths, c.rows, p)
        order = np.argsort(t / period - np.floor(t / period), kind="stable")
        d, iv = (np.concatenate([x[order], x[order][: c.templates.maxwidth]]) for x in (1 - y, 1 / dy**2))
        sums, chi = (np.concatenate([[0], np.cumsum(x)]) for x in (d, d * d * iv))
        best = (float(len(t)), 0, 0.0)
        for w in kernel.eligible(c.widths, period, len(t), t[-1] - t[0], p):
            row = int(c.rows[list(c.widths).index(w)])
            s = 1 - c.templates.signal[row]
            at = np.arange(0, len(d) - w + 1, kernel.stride(int(w), p.T0_fit_margin))
            mean = (sums[at + w] - sums[at]) / w
            at, mean = at[mean > p.transit_depth_min], mean[mean > p.transit_depth_min]
            places += len(at)
            if len(at):
                k = mean * c.templates.overshoot[row] / 0.5
                b, q = np.correlate(d * iv, s)[at], np.correlate(iv, s * s)[at]
                stat = chi[at + len(s)] - chi[at] - 2 * k * b + k * k * q + chi[len(t)] - (chi[at + w] - chi[at])
                if stat.min() < best[0]:
                    best = stat.min(), row, 1 - mean[stat.argmin()] * c.templates.overshoot[row]
        assert got == pytest.approx(best, rel=1e-9)
    assert not dip or sum(done) < places / 10


@pytest.mark.parametrize(("n", "size", "step"), [(1000, 230, 7), (1000, 100, 50), (515, 500, 3), (90, 40, 40)])
def test_strided_product(monkeypatch, n, size, step):
    x, s = np.random.default_rng(0).normal(size=n), np.random.default_rng(1).normal(size=size)
    want = np.correlate(x, s, mode="valid")[::step]
    assert np.allclose(kernel.strided_product(x, s, step, len(want)), want)
    monkeypatch.setattr(kernel, "BLOCK", 500)
    assert np.allclose(kernel.strided_product(x, s, step, len(want)), want)
    assert np.allclose(kernel.products_at(x, s, np.arange(len(want)) * step, step, len(want)), want)


def test_no_row_holds_a_long_curve(spark):
    """Chunks hold a batch's points at most, in order, and come together as the curve; an even error travels once."""
    t, y, rng = long_curve(30_000)
    parts = {"a": (t, y, np.full(len(t), 0.5)), "b": (t[:7], y[:7], rng.uniform(1, 2, 7))}
    rows = [(name, i, *map(float, x)) for name, v in parts.items() for i, x in enumerate(zip(*v, strict=True))]
    rng.shuffle(rows)
    lc = spark.createDataFrame([tuple([str(r[0]), int(r[1]), *map(float, r[2:])]) for r in rows], "lc_id string, idx long, t double, y double, dy double")
    chunks = lightcurve.chunks(lc, 3)
    sizes = chunks.selectExpr("length(t) div 8 n", "length(dy) div 8 e", "lc_id").collect()
    assert sum(r["n"] for r in sizes) == 30_007 and max(r["n"] for r in sizes) <= 10_000 and all(r["e"] == 1 for r in sizes if r["lc_id"] == "a")
    batches = chunks.orderBy("lc_id", "t0", "idx0").select("lc_id", "t", "y", "dy").toArrow().to_batches()
    got = {name: v for (name,), *v in lightcurve.whole(batches, 1)}
    assert set(got) == {"a", "b"} and all(np.array_equal(x, z) for name in got for x, z in zip(got[name], parts[name], strict=True))


def test_spectra_that_stay_give_the_same_rows(spark, monkeypatch):
    """Many curves' spectra are summed up where they are made; the result is that of spectra that travel."""
    rng = np.random.default_rng(11)
    rows = []
    for k, n in enumerate((5, 60, 90, 700)):
        t = np.sort(rng.uniform(1, 31, n))
        y = 1 + rng.normal(0, 1e-3, n) - 0.01 * (np.abs((t - 2) % 3 - 0.1) < 0.12)
        rows += [(f"c{k}", i, float(a), float(b), None) for i, (a, b) in enumerate(zip(t, y, strict=True))]
    lc = spark.createDataFrame(rows, "lc_id string, idx long, t double, y double, dy double")
    p = SearchParams(period_min=1, period_max=9)
    (far, wide), (near, own) = search.search(lc, p, buckets=3), search.search(lc, p, buckets=1)
    a, b = ([r.asDict(recursive=True) for r in x.orderBy("lc_id").collect()] for x in (far, near.select(far.columns)))
    for x, z in zip(a, b, strict=True):
        assert (x["lc_id"], x["fit"], x["period"], x["row"], x["T0"]) == (z["lc_id"], z["fit"], z["period"], z["row"], z["T0"])
        for c in ("depth", "i", "power", "chi2_min", "SDE", "SDE_raw", "duration", "period_uncertainty", "snr", "in_transit_count"):
            assert x[c] == (None if z[c] is None else pytest.approx(z[c], rel=1e-9))
    assert wide.count() == own.count() and wide.exceptAll(own.select(wide.columns)).count() == 0


@pytest.mark.parametrize("part", [64, 1 << 18])
def test_model_in_parts(spark, raw, monkeypatch, part):
    """The model as one array, against parts that are made each for itself."""
    monkeypatch.setattr(model, "PART", part)
    p = SearchParams().validated()
    want = {}
    for name, n, period, t0, share in (("a", 700, 3.7, 1.5, 0.054), ("b", 90, 11.0, 2.0, 0.3), ("c", 5, 1.0, 1.2, 0.1)):
        mids = t0 + period * np.arange(max(1, int(np.ceil((30 - t0) / period))))
        samples = int(n / len(mids)) * 5
        one = model.single_transit(samples, share, 0.9, 0.98, raw) if samples else np.ones(0)
        at = [mids[0] - period, *mids, mids[-1] + period]
        t, y = np.concatenate([np.linspace(m - period / 2, m + period / 2, samples) for m in at]), np.tile(one, len(at))
        lo, hi = (int(np.argmax(t > v)) for v in (1.0, 30.0)) if samples else (0, 0)
        want[name] = n, period, t0, share, t[lo:hi], y[lo:hi]
        if samples:
            got = model._Transit(samples, share, 0.9, 0.98, raw)
            assert np.allclose(got.at(np.arange(samples)), one, rtol=0, atol=1e-13) and np.array_equal(model._spaced(1.0, 2.0, samples, np.arange(samples)), np.linspace(1, 2, samples))
            pieces = [b for part_ in range(-(-len(t) // part)) for b in model._model(raw)([model.pa.RecordBatch.from_pylist([{"lc_id": name, "n": n, "min_t": 1.0, "max_t": 30.0, "period": period, "duration": share, "stretch": 0.9, "depth": 0.98, "mids": mids.tolist(), "part": part_}])])]
            assert max(b.num_rows for b in pieces) <= part
            i, tt, yy = (np.concatenate([b.column(k).to_numpy() for b in pieces]) for k in (1, 2, 3))
            assert np.array_equal(i, np.arange(hi - lo)) and np.array_equal(tt, t[lo:hi]) and np.allclose(yy, y[lo:hi], rtol=0, atol=1e-13)
    rows = [(name, v[0], 1.0, 30.0, v[1], v[2], v[3], 0.9, 0.98) for name, v in want.items()]
    found = spark.createDataFrame(rows, "lc_id string, n long, min_t double, max_t double, period double, T0 double, duration double, stretch double, depth double")
    counts = {r["lc_id"]: r["count"] for r in model.model_light_curve(found, p).groupBy("lc_id").count().collect()}
    # workers have their own PART
    assert part == 64 or counts == {name: len(v[4]) for name, v in want.items() if len(v[4])}


@pytest.mark.parametrize("points", [45, 67, 400])
def test_ends_of_many_periods(points):
    p = SearchParams().validated()
    periods = search._periods(30.0, p)
    low, high = kernel.ends_of(periods, points, 30.0, p)
    assert list(zip(low.tolist(), high.tolist(), strict=True)) == [kernel.eligible_ends(x, points, 30.0, p) for x in periods.tolist()]
