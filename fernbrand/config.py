"""The run configuration: a YAML file checked against fixed ranges."""

from __future__ import annotations

import os
from dataclasses import MISSING, dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Spread:
    fmc: float = 100.0
    curing: float = 85.0
    slope_strength: float = 0.5
    backing_share: float = 0.2
    length_to_breadth: float = 2.0


@dataclass(frozen=True)
class Simulation:
    dt: float = 1.0
    max_duration: float = 1440.0
    n_vertices: int = 300
    initial_radius: float = 0.5
    store_every: int = 10
    min_ros: float = 0.01
    use_markers: bool = True
    marker_step: float = 1.0
    time_varying: bool = True
    start: str | None = None
    start_hour: int = 12

    @property
    def steps(self) -> int:
        return int(self.max_duration / self.dt)


@dataclass(frozen=True)
class Weather:
    compute_indices: bool = True
    latitude: float = 51.0
    high: float = 8.6
    extreme: float = 12.6
    keep: tuple = ("moderate", "high", "extreme")
    event_days_mean: float = 3.76
    time_form: str | None = None


@dataclass(frozen=True)
class Fuel:
    #: Numeric code to fuel name; none: the default map.
    lookup: dict[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Break:
    """A barrier: lines (``path``: table of ``ax``, ``ay``, ``bx``, ``by``) or a grid (cells whose ``value`` is over 0)."""

    path: str
    enabled: bool = True
    kind: str = "lines"
    treatment: str = "fuel_code"
    fuel_code: int = 102
    buffer_m: float = 0.0
    all_touched: bool = True
    keep_non_fuel: bool = True


@dataclass(frozen=True)
class Ignition:
    #: ``points``: those of ``inputs.ignitions``; ``grid``: drawn from ``inputs.probabilities``.
    source: str = "points"
    n_iterations: int = 10
    cause: str = "Lightning"
    season: str = "Summer"
    fires_per_iteration: dict[int, float] = field(default_factory=lambda: {1: 0.2, 2: 0.3, 3: 0.3, 4: 0.2})
    #: Fuels in which a cause (in a season, or any) starts no fire: ``{fuels: [..], cause: .., season: ..}``.
    rules: tuple = ()
    #: Escaped and all fires by ecoregion: ``{eco_id: [escaped, all]}``.
    rates: dict[int, list[float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Inputs:
    cells: str | None = None
    weather: str | None = None
    stations: str | None = None
    ignitions: str | None = None
    probabilities: str | None = None


@dataclass(frozen=True)
class Config:
    inputs: Inputs = Inputs()
    fuel: Fuel = Fuel()
    weather: Weather = Weather()
    spread: Spread = Spread()
    simulation: Simulation = Simulation()
    ignition: Ignition = Ignition()
    breaks: tuple = ()
    crs: str = "EPSG:3005"
    output: str = "out"
    seed: int = 0


# Allowed ranges.
RANGES = {
    "fmc": (0, 300), "curing": (0, 100), "slope_strength": (0, 10), "backing_share": (0, 1), "length_to_breadth": (1, 20), "dt": (1e-6, 1440), "max_duration": (1e-6, 1e7),
    "n_vertices": (4, 100_000), "initial_radius": (1e-9, 1e6), "store_every": (1, 10**9), "min_ros": (0, 1e6), "start_hour": (0, 23), "n_iterations": (1, 10**9), "marker_step": (0, 1e6), "latitude": (-90, 90), "high": (0, 1e6), "extreme": (0, 1e6), "event_days_mean": (0, 1e3), "buffer_m": (0, 1e6),
}
# Allowed words.
CHOICES = {"source": ("points", "grid"), "treatment": ("fuel_code", "zero_ros"), "kind": ("lines", "grid")}


class ConfigError(ValueError):
    """A configuration that can't be used."""


def _build(kind: type, given: dict[str, Any], at: str, unknown: list[str]):
    known = {f.name: f for f in fields(kind)}
    unknown += [f"{at}{k}" for k in given if k not in known]
    values = {}
    for name, value in given.items():
        if name not in known:
            continue
        default = None if kind is Break and name == "path" else known[name].default if known[name].default is not MISSING else known[name].default_factory()
        if name in CHOICES and value not in CHOICES[name]:
            raise ConfigError(f"{at}{name} is one of {', '.join(CHOICES[name])}, not {value!r}")
        if is_dataclass(default):
            if not isinstance(value, dict):
                raise ConfigError(f"{at}{name} is a section")
            value = _build(type(default), value, f"{at}{name}.", unknown)
        elif name in RANGES and not (isinstance(value, (int, float)) and RANGES[name][0] <= value <= RANGES[name][1]):
            raise ConfigError(f"{at}{name} lies between {RANGES[name][0]} and {RANGES[name][1]}, not {value!r}")
        values[name] = value
    return kind(**values)


def _placed(path: Any, folder: str) -> Any:
    return os.path.normpath(os.path.join(folder, path)) if isinstance(path, str) and path.startswith(("./", "../")) else path


def parse(given: dict[str, Any] | None, folder: str = ".") -> tuple[Config, list[str]]:
    """The configuration and the names that it doesn't know. Input paths that begin with a dot are taken from ``folder``."""
    unknown: list[str] = []
    given = dict(given or {})
    if isinstance(given.get("inputs"), dict):
        given["inputs"] = {k: _placed(v, folder) for k, v in given["inputs"].items()}
    barriers = given.pop("breaks", None) or []
    barriers = barriers if isinstance(barriers, list) else [barriers]
    if not all(isinstance(b, dict) and b.get("path") for b in barriers):
        raise ConfigError("each of breaks is a section with a path")
    built = tuple(_build(Break, b | {"path": _placed(b["path"], folder)}, f"breaks[{i}].", unknown) for i, b in enumerate(barriers))
    config = replace(_build(Config, given, "", unknown), breaks=built)
    if config.weather.high > config.weather.extreme:
        raise ConfigError("weather.high is at most weather.extreme")
    shares = config.ignition.fires_per_iteration
    if not shares or any(v < 0 for v in shares.values()) or sum(shares.values()) <= 0:
        raise ConfigError("ignition.fires_per_iteration needs shares over 0")
    return config, unknown


def load(path: str) -> tuple[Config, list[str]]:
    import yaml

    with open(path) as f:
        given = yaml.safe_load(f)
    if given is not None and not isinstance(given, dict):
        raise ConfigError("the file isn't a table of settings")
    return parse(given, os.path.dirname(os.path.abspath(path)))


def absent(path: str | None) -> bool:
    return bool(path) and "://" not in path and not os.path.exists(path)


def missing_inputs(config: Config) -> list[str]:
    """Required inputs that aren't named or don't exist."""
    needed = ("cells", "probabilities" if config.ignition.source == "grid" else "ignitions")
    return [f"inputs.{n}" for n in needed if not getattr(config.inputs, n)] + [f"inputs.{n}: {p}" for n in needed if absent(p := getattr(config.inputs, n))]


def warnings(config: Config) -> list[str]:
    """Inputs that are named, not required and absent, and settings that have no effect."""
    needed = ("cells", "probabilities" if config.ignition.source == "grid" else "ignitions")
    out = [f"inputs.{f.name} isn't there: {p}" for f in fields(config.inputs) if f.name not in needed and absent(p := getattr(config.inputs, f.name))]
    out += [f"breaks[{i}].path isn't there: {b.path}" for i, b in enumerate(config.breaks) if b.enabled and absent(b.path)]
    if not config.inputs.weather:
        out.append("inputs.weather isn't named: usual weather counts")
    return out


TEMPLATE = """inputs:
  cells: ./cells.parquet
  weather: ./weather.csv
  stations: ./stations.csv
  ignitions: ./ignitions.parquet
crs: EPSG:3005
fuel: {lookup: {}}
weather: {compute_indices: true, latitude: 51, high: 8.6, extreme: 12.6, keep: [moderate, high, extreme], event_days_mean: 3.76}
spread: {fmc: 100, curing: 85, slope_strength: 0.5, backing_share: 0.2, length_to_breadth: 2}
simulation: {dt: 1, max_duration: 480, n_vertices: 300, initial_radius: 0.5, store_every: 10, min_ros: 0.01, use_markers: true, time_varying: true, start_hour: 12}
ignition: {source: points, n_iterations: 10, cause: Lightning, season: Summer, fires_per_iteration: {1: 0.2, 2: 0.3, 3: 0.3, 4: 0.2}}
breaks: []
output: out
seed: 0
"""
