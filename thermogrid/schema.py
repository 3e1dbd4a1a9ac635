"""Column names, fixed values and parameter records shared by all modules.

The central table is the hourly series ``(series_id, ts, temp, dew)``, unique on
``(series_id, ts)``. A missing measure is NULL, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

KEY = "series_id"
TS = "ts"
MEASURES = ("temp", "dew")

# Hours back of the lag features.
LAGS = (0, 1, 2, 3, 4, 6, 12, 18, 24, 36, 48, 72, 168)
# Widths in hours of the trailing windows.
ROLLING_WIDTHS = (6, 12, 24, 48, 168)
# Fixed value: hours ahead that are forecast.
HORIZON = 24
# Fixed value: missing hours filled after a valid reading.
FILL_LIMIT = 6

# Hours of one series that one window task works on.
CHUNK_HOURS = 2048


@dataclass(frozen=True)
class Bounds:
    """Closed ranges outside of which a reading counts as a sensor fault."""

    # The ranges of the cleaning step.
    temp_min: float = -15.0
    temp_max: float = 42.0
    dew_min: float = -30.0
    dew_max: float = 25.0

    def of(self, measure: str) -> tuple[float, float]:
        return getattr(self, f"{measure}_min"), getattr(self, f"{measure}_max")


CLEANING_BOUNDS = Bounds()
# The ranges of the profiling step.
PROFILE_BOUNDS = Bounds(temp_min=-30.0, temp_max=50.0, dew_min=-40.0, dew_max=40.0)


@dataclass(frozen=True)
class SplitDates:
    """First instant of the validation and of the test period."""

    # Fixed values.
    val_start: str = "2025-01-01"
    test_start: str = "2026-01-01"


def feature_names(lags=LAGS, widths=ROLLING_WIDTHS) -> list[str]:
    names = [f"{c}_lag{k}" for c in ("temp", "dew", "dew_depression") for k in lags]
    for w in widths:
        names += [f"temp_roll_{s}_{w}h" for s in ("mean", "min", "max", "std", "range")]
        names.append(f"dew_roll_mean_{w}h")
    return names + ["sin_hour", "cos_hour", "sin_doy", "cos_doy"]


def target_names(horizon: int = HORIZON) -> list[str]:
    return [f"target_h{h}" for h in range(1, horizon + 1)]


SUMMARY_TARGETS = ("target_tmax", "target_tmin", "target_tavg")
