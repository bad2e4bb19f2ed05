"""Constants and parameters of the dip search."""

from __future__ import annotations

import math
import os
import warnings
from dataclasses import dataclass, field, fields, replace

# SI units, and limits on stars that the grids use.
G = 6.673e-11
R_SUN = 695508000.0
R_JUP = 69911000.0
M_SUN = 1.989e30
DAY = 86400.0
R_STAR_MIN, R_STAR_MAX = 0.13, 3.5
M_STAR_MIN, M_STAR_MAX = 0.1, 1.0
#: Longest dip as a share of the period.
UPPER_DURATION = 0.12
#: Depth at which templates are made; samples of the reference template; model samples per cadence.
SIGNAL_DEPTH = 0.5
SUPERSAMPLE = 10_000
MODEL_OVERSAMPLE = 5
#: A template ends where it is this close to 1.
TEMPLATE_CUT = 1e-8
MEDIAN_KERNEL = 30
FEW_PERIODS = 100
DEGREES_OF_FREEDOM = 4

LAWS = {"uniform": 0, "linear": 1, "quadratic": 2, "squareroot": 2, "logarithmic": 2, "exponential": 2, "power2": 2, "nonlinear": 4}
#: Laws for which a radius ratio follows from the depth.
RADIUS_LAWS = ("linear", "quadratic", "squareroot", "logarithmic", "nonlinear")

# The planets of the three template shapes.
PRESETS = {
    "default": {"per": 12.9, "rp": 0.03, "a": 23.1, "inc": 89.21},
    "grazing": {"per": 12.9, "rp": 0.03, "a": 23.1, "b": 0.99},
    "box": {"per": 29.0, "rp": 0.1, "a": 26.9, "b": 0.0, "inc": 90.0, "u": (0.0,), "limb_dark": "linear"},
}


def inclination(b: float, a: float) -> float:
    """Degrees of inclination of impact parameter ``b`` at distance ``a``."""
    return math.degrees(math.acos(b / a))


@dataclass(frozen=True)
class SearchParams:
    """What a search can be told; ``validated`` checks ranges and settles the template's shape."""

    R_star: float = 1.0
    R_star_min: float = R_STAR_MIN
    R_star_max: float = R_STAR_MAX
    M_star: float = 1.0
    M_star_min: float = M_STAR_MIN
    M_star_max: float = M_STAR_MAX
    period_min: float = 0.0
    period_max: float = math.inf
    n_transits_min: int = 2
    per: float = 12.9
    rp: float = 0.03
    a: float = 23.1
    inc: float = 89.21
    b: float | None = None
    ecc: float = 0.0
    w: float = 90.0
    u: tuple[float, ...] = (0.4804, 0.1867)
    limb_dark: str = "quadratic"
    duration_grid_step: float = 1.1
    transit_depth_min: float = 10e-6
    oversampling_factor: int = 3
    T0_fit_margin: float = 0.01
    transit_template: str = "default"
    use_threads: int = field(default_factory=lambda: os.cpu_count() or 1)
    verbose: bool = False
    show_progress_bar: bool = False

    @classmethod
    def of(cls, **given) -> SearchParams:
        """Parameters by keyword; unknown ones are warned about and left out."""
        known = {f.name for f in fields(cls)}
        for name in given.keys() - known:
            warnings.warn(f"unknown parameter {name!r} is ignored", stacklevel=2)
        given = {k: v for k, v in given.items() if k in known}
        if "u" in given:
            u = given["u"]
            given["u"] = tuple(float(x) for x in u) if hasattr(u, "__iter__") else (float(u),)
        return cls(**given).validated()

    def validated(self) -> SearchParams:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.transit_template in PRESETS, f"transit_template must be one of {sorted(PRESETS)}")
        own = {k: getattr(self, k) for k in ("per", "rp", "a", "inc")}
        shape = dict(PRESETS[self.transit_template])
        if self.transit_template == "default" and any(own[k] != shape[k] for k in own):
            warnings.warn("the default template settles per, rp, a and inc", stacklevel=2)
        new = replace(self, b=None, **{k: v for k, v in shape.items() if k != "b"})
        if "b" in shape:
            new = replace(new, b=shape["b"], inc=inclination(shape["b"], new.a))
        need(new.limb_dark in LAWS, f"limb_dark must be one of {sorted(LAWS)}")
        need(len(new.u) == LAWS[new.limb_dark], f"limb darkening {new.limb_dark} takes {LAWS[new.limb_dark]} coefficients")
        for name, least in (("R_star_min", 0.0), ("M_star_min", 0.0), ("R_star", 0.0), ("M_star", 0.0), ("period_min", 0.0), ("transit_depth_min", 0.0)):
            need(getattr(new, name) >= least, f"{name} must be at least {least}")
        need(new.R_star_min <= new.R_star_max and new.M_star_min <= new.M_star_max, "a star's least size must not exceed its greatest")
        need(new.period_min < new.period_max, "period_min must be below period_max")
        need(isinstance(new.n_transits_min, int) and new.n_transits_min >= 1, "n_transits_min must be a whole number from 1")
        need(isinstance(new.oversampling_factor, int) and new.oversampling_factor >= 1, "oversampling_factor must be a whole number from 1")
        need(new.duration_grid_step > 1, "duration_grid_step must exceed 1")
        need(isinstance(new.use_threads, int) and not isinstance(new.use_threads, bool) and new.use_threads >= 1, "use_threads must be a whole number from 1")
        return replace(new, T0_fit_margin=min(max(new.T0_fit_margin, 0.0), 0.1))
