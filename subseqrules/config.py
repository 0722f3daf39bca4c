"""Parameters of mining; presets for known data sets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MiningConfig:
    epsilon_m: float = 0.5
    delta_lo: int = 100
    delta_hi: int = 300
    length_step: int = 10
    window_rate: float = 0.05
    gamma_penalty: float = -0.5
    double_step: int = 1
    k_max: int = 10
    slack: float = 0.5
    subsample: int = 2
    longest_delta_rate: int = 5
    min_count: int = 3
    minimum_interval: float = 1.0
    error_kind: str = "max"
    distance: str = "znormed_ed"
    n_segments: int = 10
    slope_window: int = 5
    max_iter: int = 5000
    confidence: float = 0.95
    epsilon_rate: float = 0.8
    supp: float = 0.7
    max_lhs_len: int = 1
    seed: int = 0

    def lengths(self) -> list[int]:
        return list(range(self.delta_lo, self.delta_hi + 1, self.length_step))

    def but(self, **changes) -> MiningConfig:
        return replace(self, **changes)


# Fixed values: (epsilon_m, delta_lo, delta_hi, length step, gamma penalty, double step) of each data set.
_PRESETS = {
    "glucose_T1": (0.1, 5, 150, 10, -0.5, 1),
    "GPS": (1, 10, 150, 10, -0.5, 1),
    "IMU": (1, 70, 700, 10, 0, 40),
    "MBA": (1, 10, 200, 10, 0, 10),
    "SKAB_VALVE2": (0.1, 100, 400, 10, 0, 10),
    "SMAP": (3, 10, 150, 10, 0, 10),
    "wave": (3, 500, 800, 10, 0, 10),
    "exchange_rate": (0.5, 100, 300, 10, 0, 1),
    "Coffee": (0.1, 5, 30, 5, -0.5, 1),
    "Lighting7": (0.1, 5, 30, 5, -0.5, 1),
    "Trace": (0.1, 10, 40, 5, -0.5, 1),
    "samples": (0.1, 10, 150, 5, -0.5, 1),
}


def preset(name: str) -> MiningConfig:
    """The preset of a data set; unknown names get that of exchange_rate."""
    e, lo, hi, step, gamma, double = _PRESETS.get(name, _PRESETS["exchange_rate"])
    return MiningConfig(epsilon_m=e, delta_lo=lo, delta_hi=hi, length_step=step, gamma_penalty=gamma, double_step=double)
