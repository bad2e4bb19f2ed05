"""Scalar functions as Column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions import params as P


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def fold(t: Column, period, t0=0.0) -> Column:
    """Phase from 0 to 1 of time ``t``."""
    x = (t - _c(t0)) / _c(period)
    return x - F.floor(x)


def in_transit(t: Column, period, duration, t0) -> Column:
    """Whether ``t`` is within half a ``duration`` of a mid-transit time."""
    p = _c(period)
    x = t - _c(t0) + p / 2
    return F.abs(x - p * F.floor(x / p) - p / 2) < _c(duration) / 2


def t14(r_star, m_star, period, small: bool = False, upper: float = P.UPPER_DURATION) -> Column:
    """Longest dip of a circular orbit as a share of ``period`` (days); ``small``: of a planet without size."""
    seconds = _c(period) * P.DAY
    radius = _c(r_star) * P.R_SUN + (0.0 if small else 2 * P.R_JUP)
    return F.least(F.lit(upper), radius * F.pow(4 * seconds / (math.pi * P.G * _c(m_star) * P.M_SUN), F.lit(1 / 3)) / seconds)


def inclination(b, a) -> Column:
    return F.degrees(F.acos(_c(b) / _c(a)))


def radius_ratio(depth: Column, law: str, u: tuple[float, ...]) -> Column:
    """Planet to star radius of a central dip of ``depth`` under a limb-darkening law."""
    if law not in P.RADIUS_LAWS:
        raise ValueError(f"the radius ratio is known for {', '.join(P.RADIUS_LAWS)} only")
    if len(u) != P.LAWS[law]:
        raise ValueError(f"limb darkening {law} takes {P.LAWS[law]} coefficients")
    return F.sqrt(depth * F.lit(radius_factor(law, u)))


def radius_factor(law: str, u: tuple[float, ...]) -> float:
    """Mean over central intensity of a darkened disc."""
    if law == "linear":
        return 1 - u[0] / 3
    if law == "quadratic":
        return 1 - u[0] / 3 - u[1] / 6
    if law == "squareroot":
        return 1 - u[0] / 3 - u[1] / 5
    if law == "logarithmic":
        return 1 + 2 * u[1] / 9 - u[0] / 3
    return 1 - u[0] / 5 - u[1] / 3 - 3 * u[2] / 7 - u[3] / 2


def days(ts: Column) -> Column:
    """A timestamp as float days."""
    return F.unix_micros(ts) / F.lit(P.DAY * 1e6)
