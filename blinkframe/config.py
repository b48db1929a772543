"""Settings of the stages: defaults, limits and enumerations.

A value of the wrong kind is an error, one out of range is clamped, an unknown key is an error. An enumeration is set by
index; an index out of range gives its default.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace
from enum import Enum
from typing import Any


class Polarity(Enum):
    POSITIVE, NEGATIVE, BOTH = range(3)


class Finding(Enum):
    DBSCAN, EIGENFEATURE, FRAME_BASED = range(3)


class Fit(Enum):
    LOG_GAUSSIAN, GAUSSIAN, RADIAL, PHASOR, MEAN_XY = range(5)

    @property
    def gives_sigma(self) -> bool:
        return self in (Fit.LOG_GAUSSIAN, Fit.GAUSSIAN)


class Focus(Enum):
    MEAN_SIGMA, FFT, ASTIGMATISM = range(3)


def label(choice: Enum) -> str:
    return choice.name.lower()


def number(default: float, low: float, high: float, hidden: bool = False) -> Any:
    return field(default=default, metadata={"low": low, "high": high, "hidden": hidden})


@dataclass(frozen=True)
class Settings:
    """Base of all settings; instances are immutable, ``put`` returns another one."""

    def schema(self) -> list[dict]:
        """What can be shown and edited: hidden keys can be set but aren't listed."""
        return [{"key": f.name, "kind": type(f.default).__name__, **{k: v for k, v in f.metadata.items() if k != "hidden"}, "default": f.default} for f in fields(self) if not f.metadata.get("hidden")]

    def get(self, key: str) -> Any:
        """Value of a listed key, an enumeration as its index, an unbounded limit as None; None for any other key."""
        known = {f.name for f in fields(self) if not f.metadata.get("hidden")}
        value = getattr(self, key) if key in known else None
        if isinstance(value, Enum):
            return value.value
        return None if isinstance(value, float) and math.isinf(value) else value

    def put(self, key: str, value: Any) -> Settings:
        spec = {f.name: f for f in fields(self)}.get(key)
        if spec is None:
            raise KeyError(f"unknown setting {key}")
        default = spec.default
        if isinstance(default, bool):
            if not isinstance(value, bool):
                raise TypeError(f"{key} takes a boolean")
            return self._checked(key, value)
        if isinstance(default, Enum):
            kinds = type(default)
            index = whole(key, value)
            return self._checked(key, kinds(index) if index < len(kinds) else default)
        if isinstance(default, int):
            return self._checked(key, int(min(max(whole(key, value), spec.metadata["low"]), spec.metadata["high"])))
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{key} takes a number")
        return self._checked(key, float(min(max(value, spec.metadata["low"]), spec.metadata["high"])))

    def _checked(self, key: str, value: Any) -> Settings:
        return replace(self, **{key: value})


def whole(key: str, value: Any) -> int:
    """A whole number of zero or more; booleans and fractions aren't."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise TypeError(f"{key} takes a whole number")
    return value


@dataclass(frozen=True)
class LocalizationSettings(Settings):
    threshold_factor: float = number(1.5, 0.5, 4.0)
    fit_radius_px: int = number(4, 2, 8)
    initial_sigma_px: float = number(1.6, 0.8, 3.5)
    sigma_min_nm: float = number(100.0, 10.0, 500.0)
    sigma_max_nm: float = number(190.0, 20.0, 800.0)
    max_xy_uncertainty_nm: float = number(35.0, 5.0, 120.0)
    nm_per_pixel: float = number(65.0, 20.0, 150.0, hidden=True)
    show_overlay: bool = True


@dataclass(frozen=True)
class ReconstructionSettings(Settings):
    max_localizations: int = number(1_000_000, 10_000, 10_000_000)
    nm_per_pixel: float = number(65.0, 1.0, 500.0, hidden=True)


@dataclass(frozen=True)
class FocusSettings(Settings):
    method: Focus = Focus.MEAN_SIGMA
    history_depth: int = number(120, 16, 360)
    sigma_min_nm: float = number(100.0, 10.0, 500.0)
    sigma_max_nm: float = number(190.0, 20.0, 800.0)
    nm_per_pixel: float = number(65.0, 20.0, 150.0, hidden=True)


@dataclass(frozen=True)
class CandidateSettings(Settings):
    finding_method: Finding = Finding.DBSCAN
    polarity: Polarity = Polarity.BOTH
    epsilon_px: float = number(3.0, 1.0, 10.0)
    min_events: int = number(5, 1, 64)
    max_spatial_extent_px: float = number(5.0, 1.0, 20.0)
    min_isotropy: float = number(0.2, 0.0, 1.0)
    threshold_factor: float = number(1.5, 0.5, 6.0)
    fit_radius_px: int = number(4, 1, 16)
    max_candidates: int = number(512, 1, 2048)
    show_overlay: bool = True


@dataclass(frozen=True)
class FittingSettings(Settings):
    fit_method: Fit = Fit.LOG_GAUSSIAN
    sigma_min_nm: float = number(80.0, 10.0, 500.0)
    sigma_max_nm: float = number(200.0, 10.0, 500.0)
    max_fit_residual: float = number(0.5, 0.0, 10.0)
    nm_per_pixel: float = number(65.0, 1.0, 500.0, hidden=True)
    show_overlay: bool = True

    def _checked(self, key: str, value: Any) -> Settings:
        """The two sigma limits never cross: the one that isn't set gives way."""
        made = replace(self, **{key: value})
        if key == "sigma_min_nm":
            return replace(made, sigma_max_nm=max(made.sigma_max_nm, value))
        if key == "sigma_max_nm":
            return replace(made, sigma_min_nm=min(made.sigma_min_nm, value))
        return made


@dataclass(frozen=True)
class PostprocSettings(Settings):
    min_n_events: int = number(3, 1, 100)
    max_polarity_imbalance: float = number(1.0, 0.0, 1.0)
    max_fit_residual: float = number(math.inf, 0.0, 1e6)
    drift_correction_enabled: bool = False
    drift_window_frames: int = number(50, 1, 500)
    show_enena: bool = True
    show_insitu_psf: bool = True
    show_on_time: bool = True
    show_overlay: bool = True
    nm_per_pixel: float = number(65.0, 1.0, 500.0, hidden=True)

    def _checked(self, key: str, value: Any) -> Settings:
        """A residual limit near the top of its range is none."""
        return replace(self, **{key: math.inf if key == "max_fit_residual" and value >= 0.999e6 else value})


@dataclass(frozen=True)
class ThresholdSettings(Settings):
    threshold: int = number(0, 0, 4096)


@dataclass(frozen=True)
class GlobalSettings:
    """Calibration and geometry of the host; the calibration goes before a stage's own where it is given."""

    nm_per_pixel: float | None = None
    frame_us: int = 10_000
    sensor_width: int = 1280
    sensor_height: int = 720

    def nm(self, own: float) -> float:
        return own if self.nm_per_pixel is None else self.nm_per_pixel
