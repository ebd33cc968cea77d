"""Settings, as values that functions take; the environment can override them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Profile:
    """Which detectors vote for a class of equipment, and whether level steps are normal there."""

    z: bool = True
    iso: bool = True
    dtw: bool = True
    suppress_steps: bool = True


#: Detectors by class of equipment; others have the default.
PROFILES: dict[str, Profile] = {
    "Pressure": Profile(),
    "Flowrate": Profile(),
    "Conductivity": Profile(iso=False),
    "Voltage": Profile(dtw=False),
    "Dissolved Oxygen": Profile(dtw=False),
    "Temperature": Profile(iso=False, dtw=False),
    "LevelSensor": Profile(iso=False, dtw=False),
}
#: The inclusive range of valid readings; other classes are never invalid.
VALID_RANGES: dict[str, tuple[float, float]] = {
    "Temperature": (0, 60),
    "Flowrate": (0, 2000),
    "Conductivity": (0, 50000),
    "Pressure": (0, 20),
    "Voltage": (0, 500),
    "Dissolved Oxygen": (0, 20),
    "LevelSensor": (0, 100),
}


@dataclass(frozen=True)
class DetectorConfig:
    """Thresholds of the detector; windows are rows, not durations."""

    window_hours: int = 72
    z_window: int = 24
    z_soft: float = 4.5
    z_floor: float = 2.5
    z_hard: float = 8.0
    iso_enabled: bool = True
    iso_contamination: float = 0.01
    iso_trees: int = 200
    iso_window: int = 12
    iso_seed: int = 42
    dtw_window: int = 24
    dtw_k: float = 6.0
    target_rate: float = 0.003
    max_rate: float = 0.01
    min_event_len: int = 6
    merge_gap: int = 3
    cooldown: int = 12
    event_z: float = 5.5
    relative_jump: float = 0.10
    event_dtw_rate: float = 0.20
    step_window: int = 20
    step_min_window: int = 5
    step_level: float = 0.10
    suppress_steps: bool = True
    max_sensors: int = 10
    min_methods: int = 2

    @property
    def min_rows(self) -> int:
        return max(2 * self.z_window, self.dtw_window + 5)


@dataclass(frozen=True)
class PipelineConfig:
    """Input window and gates; ``from_env`` reads SENSORLOOM_<NAME>."""

    window_hours: int = 72
    grace_minutes: int = 30
    max_missing_percent: float = 25.0
    excluded_equipment: tuple[str, ...] = ("Others", "Digital Signal")
    time_zone: str = "Asia/Singapore"
    similarity: float = 0.85
    prefix: int = 15
    tolerance_minutes: int = 5
    suppression_enabled: bool = True
    batch_rows: int = 50_000

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "SENSORLOOM_") -> PipelineConfig:
        """Defaults, overridden by the environment; a value that can't be read as its type raises."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(getattr(cls(), f.name))
            try:
                if kind is bool:
                    given[f.name] = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}[raw.strip().lower()]
                elif kind is tuple:
                    given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
                else:
                    given[f.name] = kind(raw)
            except (KeyError, ValueError):
                raise ValueError(f"{prefix}{f.name.upper()}={raw!r} is no {kind.__name__}") from None
        return cls(**given)


def required_env(name: str, env: Mapping[str, str] | None = None) -> str:
    value = (os.environ if env is None else env).get(name)
    if not value:
        raise KeyError(f"{name} is not set")
    return value
