"""Dip templates: a limb-darkened disc crossed by a dark one, in NumPy on the driver or inside a task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from lumenfold.functions import params as P

NODES = 400


def intensity(mu: np.ndarray, law: str, u: tuple[float, ...]) -> np.ndarray:
    """Brightness of the disc where the line of sight meets it at cosine ``mu``, 1 at the centre."""
    mu = np.clip(mu, 0.0, 1.0)
    dark = 1 - mu
    if law == "uniform":
        return np.ones_like(mu)
    if law == "linear":
        return 1 - u[0] * dark
    if law == "quadratic":
        return 1 - u[0] * dark - u[1] * dark**2
    if law == "squareroot":
        return 1 - u[0] * dark - u[1] * (1 - np.sqrt(mu))
    if law == "logarithmic":
        return 1 - u[0] * dark - u[1] * mu * np.log(np.maximum(mu, 1e-300))
    if law == "exponential":
        return 1 - u[0] * dark - u[1] / (1 - np.exp(np.maximum(mu, 1e-12)))
    if law == "power2":
        return 1 - u[0] * (1 - mu ** u[1])
    return 1 - sum(c * (1 - mu ** ((k + 1) / 2)) for k, c in enumerate(u))


def _arc(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radii and weights between lo and hi; nodes crowd at both ends, where integrands have roots."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    angle = x * np.pi / 2
    half = (hi - lo)[..., None] / 2
    return (hi + lo)[..., None] / 2 + half * np.sin(angle), half * w * np.pi / 2 * np.cos(angle)


def _disc(radius: np.ndarray, law: str, u: tuple[float, ...]) -> np.ndarray:
    """Light of the disc within ``radius`` of its centre."""
    r, w = _arc(np.zeros_like(radius), radius)
    return (w * 2 * np.pi * r * intensity(np.sqrt(np.maximum(0, 1 - r * r)), law, u)).sum(-1)


def dimmed(z: np.ndarray, rp: float, law: str, u: tuple[float, ...]) -> np.ndarray:
    """Relative flux with a dark disc of radius ``rp`` at distance ``z`` from the centre, in stellar radii."""
    flux = np.ones_like(z)
    at = np.flatnonzero(z < 1 + rp)
    whole = _disc(np.array([1.0]), law, u)[0]
    for part in np.array_split(at, max(1, len(at) // 2000)):
        if not len(part):
            continue
        d = np.maximum(z[part], 1e-12)
        lo, hi = np.minimum(np.abs(d - rp), 1.0), np.minimum(1.0, d + rp)
        r, w = _arc(lo, hi)
        cos = (r * r + d[:, None] ** 2 - rp * rp) / (2 * np.maximum(r, 1e-12) * d[:, None])
        hidden = (w * 2 * r * np.arccos(np.clip(cos, -1, 1)) * intensity(np.sqrt(np.maximum(0, 1 - r * r)), law, u)).sum(-1)
        inner = d < rp
        if inner.any():
            hidden[inner] += _disc(np.minimum(1.0, rp - d[inner]), law, u)
        flux[part] = 1 - hidden / whole
    return flux


def separation(t: np.ndarray, per: float, a: float, inc: float, ecc: float = 0.0, w: float = 90.0) -> np.ndarray:
    """Sky distance of the discs' centres at ``t`` days from mid-transit; infinite behind the star."""
    i, w = np.radians(inc), np.radians(w)
    if ecc == 0:
        angle = 2 * np.pi * t / per
        z = a * np.sqrt(np.sin(angle) ** 2 + (np.cos(angle) * np.cos(i)) ** 2)
        return np.where(np.cos(angle) > 0, z, np.inf)
    f0 = np.pi / 2 - w
    e0 = 2 * np.arctan(np.sqrt((1 - ecc) / (1 + ecc)) * np.tan(f0 / 2))
    m = 2 * np.pi * t / per + e0 - ecc * np.sin(e0)
    e = m.copy()
    for _ in range(60):
        e -= (e - ecc * np.sin(e) - m) / (1 - ecc * np.cos(e))
    f = 2 * np.arctan2(np.sqrt(1 + ecc) * np.sin(e / 2), np.sqrt(1 - ecc) * np.cos(e / 2))
    r = a * (1 - ecc * ecc) / (1 + ecc * np.cos(f))
    z = r * np.sqrt(1 - (np.sin(w + f) * np.sin(i)) ** 2)
    return np.where(np.sin(w + f) > 0, z, np.inf)


def light_curve(t: np.ndarray, p: P.SearchParams) -> np.ndarray:
    return dimmed(separation(t, p.per, p.a, p.inc, p.ecc, p.w), p.rp, p.limb_dark, p.u)


def raw_transit(p: P.SearchParams) -> tuple[np.ndarray, np.ndarray]:
    """Times and fluxes of one dip of the template's planet, cut to where it dims the star, on a one-day grid."""
    t = np.linspace(-0.5, 0.5, P.SUPERSAMPLE)
    flux = light_curve(t, p)
    below = flux < 1
    first = int(np.argmax(below))
    if not below.any() or first == 0:
        raise ValueError("the template's dip must begin and end within one day")
    return t[first : P.SUPERSAMPLE - first + 1], flux[first : P.SUPERSAMPLE - first + 1]


def reference(raw: tuple[np.ndarray, np.ndarray], samples: int) -> np.ndarray:
    """The dip on ``samples`` points, from 1 down to 0."""
    t, flux = raw
    y = np.interp(np.linspace(t[0], t[-2], samples), t, flux)
    return (y.min() - y) / (y.min() - 1)


def fractional(shape: np.ndarray, share: float, depth: float) -> np.ndarray:
    """``shape`` narrowed to ``share`` of its points, ones on both sides, scaled to ``depth``."""
    n = len(shape)
    inner = int(share * n)
    grid = np.linspace(-0.5, 0.5, n)
    y = np.interp(np.linspace(-0.5, 0.5, max(inner, 1)), grid, shape)
    side = max(0, n - inner) // 2
    out = np.concatenate([np.ones(side), y, np.ones(side)])
    out = np.concatenate([out, np.ones(max(0, n - len(out)))])[:n]
    return 1 - (1 - out) * depth


@dataclass
class Templates:
    """One row per duration: its share of the period, its width in points, the trimmed signal and its overshoot."""

    duration: np.ndarray
    width: np.ndarray
    signal: list[np.ndarray]
    overshoot: np.ndarray
    #: transforms of the signals, kept by the kernel
    kept: dict = field(default_factory=dict, repr=False)
    #: the signals in flat pieces, kept by the kernel
    pieces: dict = field(default_factory=dict, repr=False)

    @property
    def maxwidth(self) -> int:
        m = int(self.width.max())
        return m + m % 2


def templates(raw: tuple[np.ndarray, np.ndarray], durations: list[float], points: int) -> Templates:
    """Templates of ``durations`` for a curve of ``points`` points; durations narrower than a point have none."""
    longest = max(durations)
    samples = int(longest * points)
    samples += samples % 2
    shape = reference(raw, samples)
    width = np.array([int(d / longest * samples) for d in durations])
    durations, width = [d for d, w in zip(durations, width, strict=True) if w], width[width > 0]
    if not len(width):
        raise ValueError("the light curve has too few points for every duration")
    signal, over = [], []
    for d in durations:
        y = fractional(shape, d / longest, P.SIGNAL_DEPTH)
        low = np.flatnonzero(y < 1 - P.TEMPLATE_CUT)
        s = y[low[0] : low[-1] + 1] if len(low) else y[:1]
        signal.append(s)
        over.append(1 / (2 - s.mean() / s.min()))
    return Templates(np.array(durations), width, signal, np.array(over))
