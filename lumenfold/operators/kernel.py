"""The inner kernels, pure NumPy: the best template at a period, and the best mid-transit time.

A template scaled by k leaves sum (d - k s)^2 / e^2 = A - 2 k B + k^2 C over its window, where d is the depth of the
data; A is a prefix sum, B and C sliding products.  So a width costs two passes over the curve, whatever the trial depths.
"""

from __future__ import annotations

import numpy as np

from lumenfold.functions import params as P
from lumenfold.operators.grids import t14
from lumenfold.operators.template import Templates

#: Products of points and template samples from which a transform beats the direct sum.
TRANSFORM = 4_000_000
#: Bytes of the templates' transforms that a curve keeps.
KEPT = 128 << 20
#: Up to so many points a curve's periods are worked on together, so many phases at a time.
SHORT, PHASES = 600, 20_000
#: Points of all templates laid out at once in the mid-transit fit, or of blocks: 8 MB.
BLOCK = 1_000_000
#: Flat pieces into which a template is cut to bound its residual sums, coarse and fine.
PIECES = (16, 128)
#: A template is laid on all its places at once where one in so many is asked.
DENSE = 8


def fast_size(n: int) -> int:
    """The least product of 2, 3 and 5 that is n at least."""
    best = 1 << (n - 1).bit_length()
    for five in (5**k for k in range(14)):
        for three in (3**k for k in range(20)):
            if five * three < best:
                best = min(best, five * three << max(0, (-(-n // (five * three)) - 1).bit_length()))
    return best


def sliding_product(x: np.ndarray, s: np.ndarray, memo: dict | None = None, kept: dict | None = None, name=None) -> np.ndarray:
    """sum over j of x[i + j] * s[j] for each i where the template fits.

    ``memo`` keeps the transform of x for other templates, ``kept`` that of the template ``name`` for other curves, while there is room.
    """
    n = len(x) - len(s) + 1
    if len(x) * len(s) < TRANSFORM:
        return np.correlate(x, s, mode="valid")
    size = fast_size(len(x))  # places where the template fits do not go round the end
    fx = memo.get(size) if memo is not None else None
    if fx is None:
        fx = np.fft.rfft(x, size)
        if memo is not None:
            memo[size] = fx
    fs = kept.get((name, size)) if kept is not None else None
    if fs is None:
        fs = np.conj(np.fft.rfft(s, size))
        if kept is not None and (len(kept) + 1) * fs.nbytes <= KEPT:
            kept[name, size] = fs
    return np.fft.irfft(fx * fs, size)[:n]


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(x)])


def stride(width: int, margin: float) -> int:
    """Points by which a template moves at each step."""
    return max(1, int(width / (1 / margin))) if margin > 0 and width > margin else 1


def eligible_ends(period: float, points: int, span: float, p: P.SearchParams) -> tuple[int, int]:
    """The least and the greatest width that is physically plausible at ``period``."""
    seen = span / period
    low = int(np.floor(t14(p.R_star_min, p.M_star_min, period, small=True) * points))
    high = int(np.ceil(t14(p.R_star_max, p.M_star_max, period) * points * (seen + 1) / seen))
    return low, high


def ends_of(periods: np.ndarray, points: int, span: float, p: P.SearchParams) -> tuple[np.ndarray, np.ndarray]:
    """:func:`eligible_ends` of many periods; where an end is next to a whole number it is worked out alone, so that rounding cannot move it."""
    s = periods * P.DAY
    share = lambda r, m: np.minimum(P.UPPER_DURATION, r * P.R_SUN * (4 * s / (np.pi * P.G * m * P.M_SUN)) ** (1 / 3) / s)
    seen = span / periods
    least = share(p.R_star_min, p.M_star_min) * points
    most = share(p.R_star_max + 2 * P.R_JUP / P.R_SUN, p.M_star_max) * points * (seen + 1) / seen
    low, high = np.floor(least).astype(int), np.ceil(most).astype(int)
    near = lambda x: np.abs(x - np.rint(x)) < 1e-9 * (1 + np.abs(x))
    for k in np.flatnonzero(near(least) | near(most)):
        low[k], high[k] = eligible_ends(float(periods[k]), points, span, p)
    return low, high


def eligible(widths: np.ndarray, period: float, points: int, span: float, p: P.SearchParams) -> np.ndarray:
    """Widths that are physically plausible at ``period``."""
    low, high = eligible_ends(period, points, span, p)
    return widths[(widths >= low) & (widths <= high)]


def coarse(tm: Templates, row: int, pieces: int) -> tuple:
    """A template's dip as at most ``pieces`` flat pieces of even variation, kept with it.

    Where the pieces end, their means and the norm of what they leave; means of the squares and how far these are off in all; the sum of squares.
    """
    if (row, pieces) not in tm.pieces:
        s = 1 - tm.signal[row]
        grown = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(s)))])
        at = np.unique(np.concatenate([[0], np.searchsorted(grown, np.linspace(0, grown[-1], pieces + 1)[1:-1]), [len(s)]]))
        length = np.diff(at)
        means, squares = np.add.reduceat(s, at[:-1]) / length, np.add.reduceat(s * s, at[:-1]) / length
        left = float(np.sqrt(((s - np.repeat(means, length)) ** 2).sum()))
        tm.pieces[row, pieces] = at, means, left, squares, float(np.abs(s * s - np.repeat(squares, length)).sum()), float((s * s).sum())
    return tm.pieces[row, pieces]


def strided_product(x: np.ndarray, s: np.ndarray, step: int, count: int) -> np.ndarray:
    """sum over j of x[i + j] * s[j] for i = 0, step, .. (count of them): blocks of ``step`` points against blocks of the template, as matrices."""
    cuts = -(-len(s) // step)
    blocks = np.zeros(cuts * step)
    blocks[: len(s)] = s
    blocks = np.ascontiguousarray(blocks.reshape(cuts, step).T)
    out = np.empty(count)
    rows = max(cuts, BLOCK // max(cuts, step))
    for lo in range(0, count, rows):
        k = min(rows, count - lo)
        part = x[lo * step : (lo + k + cuts - 1) * step]
        if len(part) < (k + cuts - 1) * step:
            part = np.concatenate([part, np.zeros((k + cuts - 1) * step - len(part))])
        met = part.reshape(-1, step) @ blocks
        line = met.strides[0]
        out[lo : lo + k] = np.lib.stride_tricks.as_strided(met, (k, cuts), (line, line + met.itemsize)).sum(1)
    return out


def products_at(x: np.ndarray, s: np.ndarray, at: np.ndarray, step: int, count: int) -> np.ndarray:
    """sum over j of x[i + j] * s[j] for i in ``at``, which are some of 0, step, .. (count of them)."""
    if len(at) * DENSE > count and len(at) * len(s) > BLOCK:
        return strided_product(x, s, step, count)[at // step] if step > 1 else sliding_product(x, s)[at]
    if len(s) > 2000:
        return np.array([x[i : i + len(s)] @ s for i in at.tolist()])
    view, rows = np.lib.stride_tricks.sliding_window_view(x, len(s)), max(1, BLOCK // len(s))
    return np.concatenate([view[at[k : k + rows]] @ s for k in range(0, len(at), rows)])


class _Tries:
    """The places of one template at one period, and what is known of their residual sums."""

    def __init__(self, row: int, size: int, step: int, count: int, at, mean, k, base, reach) -> None:
        self.row, self.size, self.step, self.count = row, size, step, count
        self.at, self.mean, self.k, self.base, self.reach, self.low = at, mean, k, base, reach, None

    def bounded(self, tm: Templates, pieces: int, sums: np.ndarray, scale: float, iv_sums: np.ndarray | None, top: float) -> float:
        """Lower bounds by the template in flat pieces; gives the least upper bound."""
        cut, means, left, squares, left_squares, whole = coarse(tm, self.row, pieces)
        b, c = np.zeros(len(self.at)), top * whole
        last = sums[self.at]
        for end, mean in zip(cut[1:].tolist(), means.tolist(), strict=True):
            now = sums[self.at + end]
            b += mean * (now - last)
            last = now
        off = 2 * self.k * left * self.reach + 1e-9 * np.abs(self.base)
        if iv_sums is not None:
            c, last = np.zeros(len(self.at)), iv_sums[self.at]
            for end, mean in zip(cut[1:].tolist(), squares.tolist(), strict=True):
                now = iv_sums[self.at + end]
                c += mean * (now - last)
                last = now
            off += self.k * self.k * left_squares * top
        mid = self.base - 2 * self.k * b * scale + self.k * self.k * c
        self.low = mid - off
        return float((mid + off).min())

    def keep(self, most: float) -> None:
        if self.low is not None:
            stay = np.flatnonzero(self.low <= most)
            for name in ("at", "mean", "k", "base", "reach", "low"):
                setattr(self, name, getattr(self, name)[stay])


def best_at(period: float, t: np.ndarray, y: np.ndarray, dy: np.ndarray, tm: Templates, widths: np.ndarray, rows: np.ndarray, p: P.SearchParams) -> tuple[float, int, float]:
    """(chi2, template row, depth) of the best fit at ``period``; inf, 0, 0 if no width is plausible.

    ``widths``: the distinct template widths, ascending; ``rows``: the first template of each.
    A template cut into flat pieces costs some prefix sums a place, and bounds the true sum by what the pieces leave (Cauchy and Schwarz).
    Places whose bound lies above another's are out, finer pieces for the rest; only the last are worked out in full.
    """
    n = len(t)
    fits = eligible(widths, period, n, t[-1] - t[0], p)
    if not len(fits):
        return np.inf, 0, 0.0
    phase = t / period
    phase -= np.floor(phase)
    order = np.argsort(phase, kind="stable")
    del phase
    m = min(tm.maxwidth, n)
    flat = bool((dy == dy[0]).all())
    d = np.empty(n + m)
    np.subtract(1, y[order], out=d[:n])
    d[n:] = d[:m]
    depth_sum = _sums(d)
    if flat:
        top, iv = 1 / dy[0] ** 2, None
        chi_sum, weighted, weighted_sum = _sums(d * d), d, depth_sum
        chi_sum *= top
        scale = top
    else:
        iv = 1 / dy[order] ** 2
        iv = np.concatenate([iv, iv[:m]])
        weighted, top, scale = d * iv, float(iv.max()), 1.0
        chi_sum, weighted_sum, iv_sum = _sums(d * weighted), _sums(weighted), _sums(iv)
    del order
    total = chi_sum[-1] - (chi_sum[n + m] - chi_sum[n])
    iv_sums = None if flat else iv_sum
    best, best_row, best_depth = float(n), 0, 0.0
    least, tries = best, []
    for w in fits.tolist():
        row = int(rows[np.searchsorted(widths, w)])
        size, step = len(tm.signal[row]), stride(w, p.T0_fit_margin)
        mean = (depth_sum[w::step] - depth_sum[: len(d) - w + 1 : step]) / w
        at = np.flatnonzero(mean > p.transit_depth_min)
        if not len(at):
            continue
        count, mean, at = len(mean), mean[at], at * step
        a = chi_sum[at + size] - chi_sum[at]
        x = _Tries(row, size, step, count, at, mean, mean * tm.overshoot[row] / P.SIGNAL_DEPTH, a + total - (chi_sum[at + w] - chi_sum[at]), np.sqrt(np.maximum(a, 0) * top))
        if size > 4 * PIECES[0]:
            least = min(least, x.bounded(tm, PIECES[0], weighted_sum, scale, iv_sums, top))
        tries.append(x)
    for x in tries:
        x.keep(least)
        for pieces in PIECES[1:]:
            if x.low is not None and x.size > 4 * pieces and len(x.at):
                least = min(least, x.bounded(tm, pieces, weighted_sum, scale, iv_sums, top))
                x.keep(least)
    for x in tries:
        x.keep(min(least, best))
        if not len(x.at):
            continue
        s = 1 - tm.signal[x.row]
        b = products_at(weighted, s, x.at, x.step, x.count) * scale
        c = top * (s * s).sum() if flat else products_at(iv, s * s, x.at, x.step, x.count)
        stat = x.base - 2 * x.k * b + x.k * x.k * c
        i = int(stat.argmin())
        if stat[i] < best:
            best, best_row, best_depth = float(stat[i]), x.row, float(1 - x.mean[i] * tm.overshoot[x.row])
    return best, best_row, best_depth


def best_of(periods: np.ndarray, t: np.ndarray, y: np.ndarray, dy: np.ndarray, tm: Templates, widths: np.ndarray, rows: np.ndarray, p: P.SearchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`best_at` for all ``periods``; a short curve's are worked on together, a row of phases for each."""
    if len(t) > SHORT:
        out = [best_at(x, t, y, dy, tm, widths, rows, p) for x in periods]
        chi2, row, depth = zip(*out, strict=True) if out else ((), (), ())
        return np.array(chi2, float), np.array(row, np.int32), np.array(depth, float)
    parts = [_best_together(periods[k : k + max(1, PHASES // len(t))], t, y, dy, tm, widths, rows, p) for k in range(0, len(periods), max(1, PHASES // len(t)))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, np.int32), np.zeros(0))


def _grown(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1)


def _products(x: np.ndarray, s: np.ndarray, n: int, step: int) -> np.ndarray:
    """Sliding products of each row at every step-th of its first n places."""
    out = np.zeros((len(x), -(-n // step)))
    for j, v in enumerate(s):
        out += v * x[:, j : j + n : step]
    return out


def _best_together(periods: np.ndarray, t: np.ndarray, y: np.ndarray, dy: np.ndarray, tm: Templates, widths: np.ndarray, rows: np.ndarray, p: P.SearchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = len(t), tm.maxwidth
    phase = t[None, :] / periods[:, None]
    order = np.argsort(phase - np.floor(phase), axis=1, kind="stable")
    d, iv = (1 - y)[order], (1 / dy**2)[order]
    d, iv = (np.concatenate([x, x[:, :m]], axis=1) for x in (d, iv))
    flat = bool((dy == dy[0]).all())
    chi = d * d * iv
    depth_sum, chi_sum, weighted = _grown(d), _grown(chi), d * iv
    edge, total = chi_sum[:, n + min(m, n)] - chi_sum[:, n], chi_sum[:, -1]
    span = t[-1] - t[0]
    low, high = ends_of(periods, n, span, p)
    best, best_row, best_depth = np.full(len(periods), np.inf), np.zeros(len(periods), np.int32), np.zeros(len(periods))
    for w, row in zip(widths.tolist(), rows.tolist(), strict=True):
        at = np.flatnonzero((low <= w) & (w <= high))
        if not len(at):
            continue
        mine = (lambda x: x) if len(at) == len(periods) else (lambda x: x[at])  # noqa: B023
        s = 1 - tm.signal[row]
        size, step, over = d.shape[1] - w + 1, stride(w, p.T0_fit_margin), tm.overshoot[row]
        sums, chis = mine(depth_sum), mine(chi_sum)
        mean = ((sums[:, w:] - sums[:, :-w]) / w)[:, ::step]
        k = mean * over / P.SIGNAL_DEPTH
        begin = chis[:, :size:step]
        a = chis[:, len(s) : len(s) + size : step] - begin
        b = _products(mine(weighted), s, size, step)
        c = iv[0, 0] * (s * s).sum() if flat else _products(mine(iv), s * s, size, step)
        stat = a - 2 * k * b + k * k * c + mine(total)[:, None] - (chis[:, w : w + size : step] - begin) - mine(edge)[:, None]
        stat[mean <= p.transit_depth_min] = np.inf
        i = stat.argmin(axis=1)
        line = np.arange(len(at))
        least = stat[line, i]
        fit = least < n
        found = np.where(fit, least, float(n))
        less = found < best[at]
        where = at[less]
        best[where] = found[less]
        best_row[where] = np.where(fit, row, 0)[less]
        best_depth[where] = np.where(fit, 1 - mean[line, i] * over, 0.0)[less]
    return best, best_row, best_depth


def best_t0(t: np.ndarray, y: np.ndarray, period: float, signal: np.ndarray, depth: float, margin: float) -> float:
    """The mid-transit time, of a grid over one period from min(t), at which the template of ``depth`` (1 - flux lost) fits best.

    Residuals are weighed by the flux itself, shifted with the data.  A later mid-transit time only turns the folded order, so
    the curve is sorted once and all turns are scored by sliding sums.
    """
    n, dur = len(t), len(signal)
    points = n if margin == 0 else min(n, int(n / (margin * dur)))
    grid = np.linspace(t.min(), t.min() + period, max(points, 1))
    model = 1 - (1 - signal) * (1 - depth) / P.SIGNAL_DEPTH
    x = (t - t.min()) / period
    phase = x - np.floor(x)
    order = np.argsort(phase, kind="stable")
    f = y[order]
    shift = (grid - t.min()) / period
    turn = np.searchsorted(phase[order], shift - np.floor(shift), side="left") % n
    roll = dur // 2 + 1
    wide = np.concatenate([f, f, f[: dur + 1]])
    back = np.roll(wide[:n], roll)
    weight = 1 / np.concatenate([back, back, back[: dur + 1]]) ** 2
    # row s of the rolled curve begins roll points before the turn
    one = (wide - 1) ** 2 * weight
    ones = _sums(one)
    start = (np.arange(n) - roll) % n
    all_ones = ones[n]
    asked, which = np.unique(turn, return_inverse=True)  # the grid asks few turns of a long curve
    start = start[asked]
    fit = np.empty(len(asked))
    view, wview = np.lib.stride_tricks.sliding_window_view(wide, dur), np.lib.stride_tricks.sliding_window_view(weight, dur)
    inside = ones[start + dur] - ones[start]
    rows = max(1, BLOCK // dur)
    for lo in range(0, len(asked), rows):
        s = start[lo : lo + rows]
        fit[lo : lo + rows] = ((view[s] - model) ** 2 * wview[s]).sum(1)
    return float(grid[int((all_ones - inside + fit)[which].argmin())])
