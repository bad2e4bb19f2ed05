"""Model curves of a found dip: over one folded period, and over the whole time series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import params as P
from lumenfold.operators import template
from lumenfold.operators.grids import transit_times


def folded_model(n: int, duration: float, maxwidth: int, fill: float, stretch: float, depth: float, raw) -> tuple[np.ndarray, np.ndarray]:
    """(phase, flux) of the model over one period on ``n`` points, half a step off the data's grid."""
    half = 1 - (1 - fill) / 2
    phase = np.linspace(0.5 / n, 1 + 0.5 / n, n)
    return phase, template.fractional(template.reference(raw, n), min(1.0, duration * maxwidth * half / (maxwidth / stretch)), 1 - depth)


def single_transit(samples: int, duration: float, stretch: float, depth: float, raw) -> np.ndarray:
    """One period of the model with the dip in its middle."""
    return template.fractional(template.reference(raw, samples), min(1.0, duration * stretch), 1 - depth)


#: Points of the model that are made together.
PART = 1 << 18


class _Transit:
    """:func:`single_transit` at any of its samples, without the others."""

    def __init__(self, samples: int, duration: float, stretch: float, depth: float, raw) -> None:
        self.n, self.raw, self.depth = samples, raw, 1 - depth
        self.all = single_transit(samples, duration, stretch, depth, raw) if samples <= PART else None
        if self.all is None:
            inner = int(min(1.0, duration * stretch) * samples)
            self.inner, self.side = max(1, inner), (samples - inner) // 2
            self.least = min(float(self._flux(np.arange(k, min(k + PART, samples))).min()) for k in range(0, samples, PART))

    def _flux(self, k: np.ndarray) -> np.ndarray:
        t, flux = self.raw
        return np.interp(_spaced(t[0], t[-2], self.n, k), t, flux)

    def _shape(self, k: np.ndarray) -> np.ndarray:
        return (self.least - self._flux(k)) / (self.least - 1)

    def at(self, k: np.ndarray) -> np.ndarray:
        if self.all is not None:
            return self.all[k]
        out = np.ones(len(k))
        within = np.flatnonzero((k >= self.side) & (k < self.side + self.inner))
        if len(within):
            x = _spaced(-0.5, 0.5, self.inner, k[within] - self.side)
            grid = lambda j: _spaced(-0.5, 0.5, self.n, j)
            j = np.clip(((x + 0.5) * (self.n - 1)).astype(np.int64), 0, self.n - 2)
            j = np.clip(j - (grid(j) > x), 0, self.n - 2)
            j = np.clip(j + (grid(j + 1) <= x), 0, self.n - 2)
            left, low = grid(j), self._shape(j)
            out[within] = (self._shape(j + 1) - low) / (grid(j + 1) - left) * (x - left) + low
        return 1 - (1 - out) * self.depth


def _spaced(start, stop, n: int, k: np.ndarray) -> np.ndarray:
    """Values k of np.linspace(start, stop, n)."""
    return np.where(k == n - 1, stop, k * ((stop - start) / (n - 1)) + start) if n > 1 else np.zeros(len(k)) + start


def _first_above(value: float, start: np.ndarray, stop: np.ndarray, n: int) -> int:
    """The place of the first time above ``value`` in copies of n points each, one after the other; 0 if there is none."""
    above = np.flatnonzero((stop if n > 1 else start) > value)
    if not len(above):
        return 0
    c, lo, hi = int(above[0]), 0, n - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if _spaced(start[c], stop[c], n, np.array([mid]))[0] > value:
            hi = mid
        else:
            lo = mid + 1
    return c * n + lo


def _samples(row) -> int:
    return int(row["n"] / len(row["mids"])) * P.MODEL_OVERSAMPLE


def _model(raw):
    def run(batches):
        held, one = None, None
        for rows in batches:
            for r in rows.to_pylist():
                samples = _samples(r)
                key = samples, r["duration"], r["stretch"], r["depth"]
                if key != held:
                    held, one = key, _Transit(*key, raw)
                mids = np.array([r["mids"][0] - r["period"], *r["mids"], r["mids"][-1] + r["period"]])
                start, stop = mids - r["period"] / 2, mids + r["period"] / 2
                lo, hi = (_first_above(r[v], start, stop, samples) for v in ("min_t", "max_t"))
                place = np.arange(max(lo, r["part"] * PART), min(hi, (r["part"] + 1) * PART))
                c, k = np.divmod(place, samples)
                t = _spaced(start[c], stop[c], samples, k)
                yield pa.RecordBatch.from_arrays([pa.array([r["lc_id"]] * len(t), pa.string()), pa.array(place - lo), pa.array(t), pa.array(one.at(k))], names=["lc_id", "i", "t", "flux"])

    return run


def model_light_curve(found: DataFrame, p: P.SearchParams) -> DataFrame:
    """lc_id, i, t, flux: the model over the data's span, one copy of the template per transit and one more at each end.

    ``found``: lc_id, n, min_t, max_t, period, T0, duration, stretch, depth.
    """
    mids = transit_times(found).groupBy("lc_id").agg(F.sort_array(F.collect_list("mid")).alias("mids"))
    rows = found.select("lc_id", "n", "min_t", "max_t", "period", "duration", "stretch", "depth").join(mids, "lc_id")
    # a long curve's model is made in parts, each a row of its own
    total = (F.floor(F.col("n") / F.size("mids")) * P.MODEL_OVERSAMPLE * (F.size("mids") + 2)).cast("long")
    parts = rows.filter(total > 0).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / PART))))
    rows = parts.repartition(2 * found.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(_model(template.raw_transit(p.validated())), "lc_id string, i long, t double, flux double")
