"""Every registered query against its DuckDB SQL at the smallest scale."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import grids
from lumenfold.plans import adapters, registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(row):
    return tuple(f"{x + 0.0:.9g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == names
    assert sorted(map(plain, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(plain, want.project(",".join(f'"{c}"' for c in names)).fetchall()))


def test_planted_dip_is_found(spark, sf):
    r = QUERIES["search_result"](spark, sf).first()
    assert r["period"] == pytest.approx(3.7, abs=0.02) and r["T0"] == pytest.approx(1.5, abs=0.1) and r["SDE"] > 10


@pytest.mark.parametrize("name", ["template_table", "model_curve", "many_curves"])
def test_other_queries_have_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_box_search_of_the_prefix_against_duckdb(spark, duck, sf):
    df = registry.box_rows(adapters.planted(spark, sf).filter(F.col("idx") < registry._BOX_N), registry._WIDTHS)
    want = duck.sql(registry.BOX_PREFIX_SQL).project(",".join(df.columns)).fetchall()
    assert sorted(plain(tuple(r)) for r in df.collect()) == sorted(map(plain, want))


def test_box_search_takes_the_whole_curve(spark, sf):
    """Against brute force over every point, every width and every start."""
    got = {r["k"]: r for r in QUERIES["box_search"](spark, sf).collect()}
    rows = adapters.planted(spark, sf).orderBy("idx").collect()
    t, d = np.array([r["t"] for r in rows]), 1 - np.array([r["y"] for r in rows])
    n = len(t)
    widths = sorted({max(1, int(x * n)) for x in grids.durations(3.2, 4.18)})
    assert len(got) == 50 and n == 1000
    for k in (0, 13, 25, 49):
        phase = t / (3.2 + 0.02 * k)
        f = d[np.argsort(phase - np.floor(phase), kind="stable")]
        best = (float(n), 0, 0.0)
        for w in widths:
            for i in range(n):
                box = np.take(f, range(i, i + w), mode="wrap")
                if (m := box.mean()) > 10e-6 and (chi2 := ((f**2).sum() - (box**2).sum() + ((box - m) ** 2).sum()) / 0.002**2) < best[0]:
                    best = chi2, w, 1 - m
        assert got[k]["chi2"] == pytest.approx(best[0], abs=2e-3) and got[k]["width"] == best[1] and got[k]["depth"] == pytest.approx(best[2], abs=2e-6)
    # the planted period
    assert min(got.values(), key=lambda r: r["chi2"])["period"] == pytest.approx(3.7, abs=0.03)


def test_spectrum_has_the_full_range_of_periods(spark, sf):
    r = QUERIES["search_spectrum"](spark, sf).agg(F.min("period"), F.max("period"), F.count("period")).first()
    assert r[0] < 0.61 and r[1] > 14.9 and r[2] > 2500


def test_registered_searches_have_no_window(spark, sf, monkeypatch):
    from lumenfold.operators import search

    seen = []
    for name in ("search", "search_many_planets", "compare_templates"):
        monkeypatch.setattr(search, name, lambda lc, p, *a: seen.append((p.period_min, p.period_max)) or 1 / 0)
    for name in ("search_result", "many_curves", "two_planets", "template_shapes"):
        with pytest.raises(ZeroDivisionError):
            QUERIES[name](spark, sf)
    assert seen == [(0.0, float("inf"))] * 4


def test_model_curve_dips_at_the_mid_transit_times(spark, sf):
    rows = QUERIES["model_curve"](spark, sf).orderBy("i").collect()
    t, y = np.array([r["t"] for r in rows]), np.array([r["flux"] for r in rows])
    lo, hi = adapters.planted(spark, sf).agg(F.min("t"), F.max("t")).first()
    assert lo < t[0] and t[-1] <= hi and hi - t[-1] < 0.01 and (np.diff(t) > -1e-9).all()  # copies share their ends
    assert y.max() == 1 and y.min() == pytest.approx(0.99, abs=1e-4)
    away = np.abs((t - registry.T0 + registry.PERIOD / 2) % registry.PERIOD - registry.PERIOD / 2)
    # the dips lie around the mid-transit times, and nowhere else
    assert y[away < 0.001 * registry.PERIOD].max() < 0.9905 and away[y < 1].max() < registry.PERIOD * registry.SHARE
    assert y[away > registry.PERIOD * registry.SHARE].min() == 1


def test_box_search_by_prefix_sums_alone(spark, sf):
    """No window over the folded curve, whose frames would be read anew for every width; uneven errors against brute force."""
    lc = adapters.planted(spark, sf).filter("idx < 300").withColumn("dy", 0.001 + (F.col("idx") % 7) / 5000)
    periods = spark.createDataFrame([(0, 3.2), (5, 3.7)], "k long, period double")
    df = registry.boxsearch.box_search(lc, periods, (3, 40))
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    rows = lc.orderBy("idx").collect()
    t, d, iv = np.array([r["t"] for r in rows]), 1 - np.array([r["y"] for r in rows]), np.array([r["dy"] for r in rows]) ** -2.0
    for r in df.collect():
        x = t / r["period"]
        order = np.argsort(x - np.floor(x), kind="stable")
        f, v = d[order], iv[order]
        tries = []
        for w in (3, 40):
            for i in range(len(t) + 40 - w + 1):
                box, weight = (np.take(z, range(i, i + w), mode="wrap") for z in (f, v))
                if (m := box.mean()) > 10e-6:
                    tries.append(((f * f * v).sum() - 2 * m * (box * weight).sum() + m * m * weight.sum(), w, i, 1 - m))
        best = min(tries)
        assert best[0] >= len(t) and r["width"] == 0 or (r["chi2"], r["width"], r["phase_index"], r["depth"]) == pytest.approx(best, rel=1e-9)
