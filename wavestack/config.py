"""Settings of each stage, checked on construction."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import ConfigError


def _check(good: bool, said: str) -> None:
    if not good:
        raise ConfigError(said)


@dataclass(frozen=True)
class Grid:
    """A regular 3-D grid: lower corner, spacing and node counts; node = (i * ny + j) * nz + k."""

    origin: tuple[float, float, float]
    spacing: tuple[float, float, float]
    counts: tuple[int, int, int]

    def __post_init__(self) -> None:
        _check(all(s > 0 for s in self.spacing), "node spacing must be positive")
        _check(all(n >= 1 for n in self.counts), "node counts must be at least 1")

    @property
    def nodes(self) -> int:
        return self.counts[0] * self.counts[1] * self.counts[2]

    @property
    def far_corner(self) -> tuple[float, ...]:
        return tuple(o + s * (n - 1) for o, s, n in zip(self.origin, self.spacing, self.counts, strict=True))

    def decimated(self, factor: tuple[int, int, int]) -> tuple[Grid, tuple[int, int, int]]:
        """The grid of every ``factor``-th node, centred, and the index of its first node; the origin moves along."""
        counts = tuple(1 + (n - 1) // f for n, f in zip(self.counts, factor, strict=True))
        first = tuple((n - f * (m - 1) - 1) // 2 for n, f, m in zip(self.counts, factor, counts, strict=True))
        origin = tuple(o + c * s for o, c, s in zip(self.origin, first, self.spacing, strict=True))
        return Grid(origin, tuple(s * f for s, f in zip(self.spacing, factor, strict=True)), counts), first


@dataclass(frozen=True)
class Onset:
    """STA/LTA onset: band-pass (low, high, corners) and (STA, LTA) seconds of each phase."""

    rate: int = 50
    phases: tuple[str, ...] = ("P", "S")
    bandpass: dict = field(default_factory=lambda: {"P": (2.0, 16.0, 2), "S": (2.0, 16.0, 2)})
    windows: dict = field(default_factory=lambda: {"P": (0.2, 1.0), "S": (0.2, 1.0)})
    channels: dict = field(default_factory=lambda: {"P": "*Z", "S": "*[N,E,1,2]"})
    channel_counts: dict = field(default_factory=lambda: {"P": 1, "S": 2})
    position: str = "classic"
    transform: str = "energy"
    floor: float = 0.4
    taper: float = 0.06

    def __post_init__(self) -> None:
        _check(self.position in ("classic", "centred", "recursive"), f"unknown onset position {self.position}")
        _check(self.transform in ("energy", "abs", "env", "env_squared"), f"unknown transform {self.transform}")
        _check(self.floor >= 0.01, "the onset floor must be at least 0.01")
        for phase in self.phases:
            _check(phase in self.bandpass and phase in self.windows, f"no band-pass or window for phase {phase}")
            _check(self.bandpass[phase][1] < self.rate / 2, f"the high corner of {phase} is above Nyquist")
            _check(0 < self.windows[phase][0] < self.windows[phase][1], f"the STA of {phase} must be shorter than its LTA")

    def samples(self, phase: str) -> tuple[int, int]:
        """(STA, LTA) samples, fence post included."""
        return tuple(int(round(w * int(self.rate))) + 1 for w in self.windows[phase])

    @property
    def pre_pad(self) -> float:
        return max(w[1] for w in self.windows.values()) + 3 * max(w[0] for w in self.windows.values())

    def post_pad(self, longest_travel: float) -> float:
        return -(-(longest_travel + 2 * max(w[1] for w in self.windows.values())) // 1)


@dataclass(frozen=True)
class Trigger:
    """Threshold, merging and smoothing of the scan series (seconds)."""

    method: str = "static"
    threshold: float = 1.5
    multiplier: float = 8.0
    window: float = 3600.0
    on: str = "coa"
    marginal: float = 2.0
    interval: float = 4.0
    pad: float = 120.0
    smooth: bool = False
    sigma: float = 0.2
    truncate: float = 4.0

    def __post_init__(self) -> None:
        _check(self.method in ("static", "mad", "dynamic", "median_ratio"), f"unknown threshold method {self.method}")
        _check(self.on in ("coa", "coa_n"), f"cannot trigger on {self.on}")
        _check(self.interval >= 2 * self.marginal, "the event interval must be at least twice the marginal window")


@dataclass(frozen=True)
class Picker:
    """Phase picking: threshold method and pick windows."""

    threshold: str = "mad"
    multiplier: float = 8.0
    percentile: float = 99.0
    fraction_tt: float = 0.1
    marginal: float = 2.0

    def __post_init__(self) -> None:
        _check(self.threshold in ("mad", "percentile"), f"unknown pick threshold {self.threshold}")


@dataclass(frozen=True)
class Amplitude:
    """Amplitude windows (seconds), noise measure and filter."""

    signal_window: float = 0.0
    noise_window: float = 5.0
    noise_measure: str = "RMS"
    bandpass: tuple[float, float, int] | None = None
    highpass: tuple[float, int] | None = None
    prominence: float = 0.0
    loc_method: str = "spline"

    def __post_init__(self) -> None:
        _check(self.noise_measure in ("RMS", "STD", "ENV"), f"unknown noise measure {self.noise_measure}")
        _check(self.signal_window >= 0 and self.noise_window > 0, "windows must be positive")
        _check(not (self.bandpass and self.highpass), "give a band-pass or a high-pass, not both")


@dataclass(frozen=True)
class Magnitude:
    """Local magnitude: attenuation curve and observation filters."""

    attenuation: str = "Hutton-Boore"
    amp_feature: str = "S_amp"
    amp_multiplier: float = 1.0
    station_corrections: dict = field(default_factory=dict)
    noise_filter: float = 1.0
    trace_filter: str | None = None
    station_filter: tuple[str, ...] = ()
    dist_filter: float | None = None
    pick_filter: bool = False
    weighted: bool = False
    use_hyp_dist: bool = False

    def __post_init__(self) -> None:
        _check(self.amp_feature in ("S_amp", "P_amp"), f"unknown amplitude {self.amp_feature}")
