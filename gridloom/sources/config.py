"""Settings, their checks and the resolution of meter groups; all of it small and on the driver."""

from __future__ import annotations

import tomllib
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: Defaults of all settings that the operators read.
DEFAULTS: dict[str, Any] = {
    "input": {
        "datetime_col": "datetime", "demand_col": "demand_kw", "meter_id_col": "", "building_id_col": "", "unit": "kW"
    },
    "timezone": {"default_tz": "UTC"},
    "data_quality": {
        "max_interpolation_gap_minutes": 60, "min_completeness_fraction": 0.75, "negative_demand_severity": "ERROR"
    },
    "smoothing": {"method": "rolling_median", "window_minutes": 60},
    "baseline": {
        "method": "hybrid_sustained",
        "min_persistence_minutes": 60,
        "low_demand_percentile": 10,
        "continuous_operation_fallback_percentile": 10,
        "continuous_operation_range_fraction": 0.15,
    },
    "normalization": {"peak_for_normalization": "observed_max"},
    "operating_threshold": {"alpha_entry": 0.20, "alpha_exit": 0.15, "min_state_persistence_minutes": 30},
    "start_detection": {
        "min_magnitude_kw": 10.0,
        "min_ramp_rate_kw_per_hr": 5.0,
        "min_persistence_minutes": 30.0,
        "weight_ramp_magnitude": 0.30,
        "weight_ramp_rate": 0.25,
        "weight_persistence": 0.25,
        "weight_baseline_sep": 0.20,
    },
    "end_detection": {
        "min_magnitude_kw": 10.0,
        "min_ramp_rate_kw_per_hr": 5.0,
        "min_persistence_minutes": 30.0,
        "weight_ramp_magnitude": 0.30,
        "weight_ramp_rate": 0.25,
        "weight_persistence": 0.25,
        "weight_baseline_sep": 0.20,
    },
    "multiple_periods": {"min_baseline_gap_minutes": 60, "min_period_duration_minutes": 30},
    "ramp_detection": {
        "min_magnitude_kw": 10.0,
        "min_rate_kw_per_hr": 5.0,
        "min_duration_minutes": 10.0,
        "reversal_tolerance_fraction": 0.10,
        "min_separation_minutes": 15.0,
    },
    "peak_detection": {
        "min_prominence_fraction": 0.10,
        "min_separation_minutes": 30,
        "min_duration_minutes": 5,
        "plateau_tolerance_fraction": 0.01,
    },
    "breadth": {
        "operating_thresholds": [0.2, 0.4, 0.6, 0.8, 0.9],
        "peak_thresholds": [0.7, 0.8, 0.9],
        "compute_energy_breadth": True,
    },
    "classification": {
        "early_start_before_hour": 6,
        "morning_start_before_hour": 10,
        "midday_start_before_hour": 14,
        "evening_start_at_or_after_hour": 14,
        "rapid_start_ramp_kw_per_hr": 50.0,
        "long_operation_hours": 10.0,
        "short_operation_hours": 4.0,
        "broad_peak_width_80_hours": 3.0,
        "sharp_peak_width_80_hours": 1.0,
        "high_variability_cv_threshold": 0.30,
        "multi_period_min_count": 2,
    },
    "der": {
        "aggregation": {"min_count": 1},
        "calendar": {"holidays": [], "season_map": {}},
        "time_of_day": {
            "segments": {"morning": [6, 10], "midday": [10, 14], "afternoon": [14, 18], "evening": [18, 22]}
        },
        "temperature": {
            "source": None,
            "override_existing": False,
            "join_tolerance_minutes": None,
            "column_mapping": {"timestamp": "datetime", "temperature_f": "temperature_f"},
            "bands": {"boundaries": [32, 50, 65, 80, 90]},
        },
        "peak_events": {"allowable_gap_intervals": 0, "sustained_threshold_hours": 1.0},
        "demand_classification": {"thresholds_kw": [], "top_percentiles": [], "top_n_hours": []},
        "load_shape": {
            "flat_cv_max": 0.15,
            "highly_peaked_ratio_min": 2.0,
            "sharp_peak_width_frac_max": 0.10,
            "sustained_high_frac_min": 0.30,
            "sustained_high_pct_of_peak": 0.90,
            "overnight_heavy_ratio_min": 1.1,
            "multi_peak_min_count": 2,
            "near_peak_segment_fraction": 0.85,
        },
        "clustering": {"max_k": 8, "random_state": 42},
        "patterns": {
            "peak_timing_window_minutes": 30,
            "min_occurrences": 3,
            "outlier_z_threshold": 2.5,
            "min_days_for_outliers": 5,
        },
        "coincidence": {"min_meters": 2},
        "output": {
            "meter_interval_csv": "", "entity_interval_csv": "", "entity_daily_csv": "", "study_coincidence_csv": "",
            "daily_coincidence_csv": "",
        },
    },
    "output": {"daily_features_csv": "", "ramp_events_csv": "", "peak_events_csv": "", "interval_analysis_csv": ""},
    "visualization": {},
    "meters": [],
    "meter_groups": [],
    "portfolio": {"excluded_meters": []},
}


@dataclass(frozen=True)
class Issue:
    severity: str
    path: str
    message: str


class ConfigError(ValueError):
    """Raised with all issues of severity ERROR."""


@dataclass(frozen=True)
class Report:
    issues: list[Issue] = field(default_factory=list)

    @property
    def errors(self) -> list[Issue]:
        return [i for i in self.issues if i.severity == "ERROR"]


def get(cfg: dict, *keys: str, default: Any = None) -> Any:
    for k in keys:
        if not isinstance(cfg, dict) or k not in cfg:
            return default
        cfg = cfg[k]
    return cfg


def _over(base: dict, own: dict) -> dict:
    out = {k: _over(v, {}) if isinstance(v, dict) else list(v) if isinstance(v, list) else v for k, v in base.items()}
    for k, v in own.items():
        out[k] = _over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def with_defaults(cfg: dict | None = None) -> dict:
    return _over(DEFAULTS, cfg or {})


def load(path: str | Path | None = None, check: bool = True) -> dict:
    """Settings of a TOML file over the defaults; those that nothing reads are reported as warnings."""
    own = {}
    if path is not None:
        if not Path(path).exists():
            raise FileNotFoundError(f"no settings at {path}")
        own = tomllib.loads(Path(path).read_text())
    for key in unread(own):
        warnings.warn(f"setting {key} is read by nothing", stacklevel=2)
    cfg = with_defaults(own)
    if check and (bad := validate(cfg).errors):
        raise ConfigError("; ".join(f"{i.path}: {i.message}" for i in bad))
    return cfg


def unread(cfg: dict, known: dict | None = None, path: str = "") -> list[str]:
    """Dotted names of settings that have no default. Free maps (those with an empty default, segments) may hold any."""
    known = DEFAULTS if known is None else known
    out = []
    for k, v in cfg.items():
        name = f"{path}{k}"
        if k not in known:
            out.append(name)
        elif isinstance(v, dict) and isinstance(known[k], dict) and known[k] and k != "segments":
            out += unread(v, known[k], f"{name}.")
    return out


def find_cycle(children: dict[str, list[str]]) -> list[str] | None:
    """The first cycle met in depth-first order, closed by its first name."""
    done: set[str] = set()

    def visit(name: str, trail: list[str]) -> list[str] | None:
        if name in trail:
            return [*trail[trail.index(name) :], name]
        if name in done:
            return None
        for child in children.get(name, []):
            if found := visit(child, [*trail, name]):
                return found
        done.add(name)
        return None

    return next((c for name in children if (c := visit(name, []))), None)


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def validate(cfg: Any) -> Report:
    """All that is wrong with the settings, without a look at any data; never raises."""
    found: list[Issue] = []

    def say(severity: str, path: str, message: str) -> None:
        found.append(Issue(severity, path, message))

    if not isinstance(cfg, dict):
        say("ERROR", "<root>", f"must be a table, not {type(cfg).__name__}")
        return Report(found)
    if get(cfg, "input", "unit", default="kW") not in ("kW", "kWh"):
        say("ERROR", "input.unit", "must be kW or kWh")
    gap, share = get(
        cfg, "data_quality", "max_interpolation_gap_minutes", default=60
    ), get(cfg, "data_quality", "min_completeness_fraction", default=0.75)
    if not _number(gap) or gap < 0:
        say("ERROR", "data_quality.max_interpolation_gap_minutes", f"must be a number of at least 0, not {gap!r}")
    if not _number(share) or not 0 <= share <= 1:
        say("ERROR", "data_quality.min_completeness_fraction", f"must lie in 0..1, not {share!r}")
    if get(cfg, "data_quality", "negative_demand_severity", default="ERROR") not in ("INFO", "WARNING", "ERROR"):
        say("ERROR", "data_quality.negative_demand_severity", "must be INFO, WARNING or ERROR")
    up, down = get(
        cfg, "operating_threshold", "alpha_entry", default=0.2
    ), get(cfg, "operating_threshold", "alpha_exit", default=0.15)
    if not _number(up) or not _number(down) or down >= up:
        say("ERROR", "operating_threshold", "alpha_exit must be a number below alpha_entry")
    for part in ("start_detection", "end_detection"):
        weights = [v for k, v in (get(cfg, part, default={}) or {}).items() if k.startswith("weight_")]
        if any(not _number(w) for w in weights):
            say("ERROR", f"{part}.weight_*", "must be numbers")
        elif weights and abs(sum(weights) - 1) > 1e-6:
            say("WARNING", f"{part}.weight_*", f"weights sum to {sum(weights):.4f}, not 1")
    known = _check_meters(cfg.get("meters") or [], say)
    _check_groups(cfg.get("meter_groups") or [], known, say)
    for m in get(cfg, "portfolio", "excluded_meters", default=[]) or []:
        if m not in known:
            say("ERROR", "portfolio.excluded_meters", f"unknown meter {m}")
    return Report(found)


def _check_meters(meters: list, say: Callable[[str, str, str], None]) -> set[str]:
    if not meters:
        say("WARNING", "meters", "no meters are configured")
    known: set[str] = set()
    for i, m in enumerate(meters):
        name = m.get("meter_id") if isinstance(m, dict) else None
        if not name:
            say("ERROR", f"meters[{i}]", "meter_id is missing")
        elif name in known:
            say("ERROR", f"meters[{i}].meter_id", f"duplicate meter {name}")
        known |= {name} if name else set()
    return known


def _check_groups(groups: list, meters: set[str], say: Callable[[str, str, str], None]) -> None:
    names: set[str] = set()
    for i, g in enumerate(groups):
        if not g.get("name"):
            say("ERROR", f"meter_groups[{i}]", "name is missing")
        elif g["name"] in names:
            say("ERROR", f"meter_groups[{i}].name", f"duplicate group {g['name']}")
        names |= {g["name"]} if g.get("name") else set()
    for i, g in enumerate(groups):
        own = g.get("name", f"<unnamed {i}>")
        for m in g.get("meters", []):
            if m not in meters:
                say("ERROR", f"meter_groups[{i}].meters", f"{own} has the unknown meter {m}")
        for c in g.get("child_groups", []):
            if c == own:
                say("ERROR", f"meter_groups[{i}].child_groups", f"{own} is its own child")
            elif c not in names:
                say("ERROR", f"meter_groups[{i}].child_groups", f"{own} has the unknown group {c}")
    if cycle := find_cycle(
        {g["name"]: [c for c in g.get("child_groups", []) if c in names] for g in groups if g.get("name")}
    ):
        say("ERROR", "meter_groups", "cycle " + " > ".join(cycle))


@dataclass(frozen=True)
class Meter:
    """A configured meter; ``source`` is the path of a CSV file, or a DataFrame."""

    meter_id: str
    display_name: str | None = None
    building_id: str | None = None
    source: Any = None


def meters(cfg: dict) -> list[Meter]:
    return [
        Meter(m["meter_id"], m.get("display_name"), m.get("building_id"), m.get("source"))
        for m in cfg.get("meters", [])
    ]


def entity_members(cfg: dict, portfolio: str = "Portfolio") -> list[tuple[str, str]]:
    """(entity, meter) pairs of all groups, nested ones resolved, and of the portfolio."""
    groups = {g["name"]: g for g in cfg.get("meter_groups", [])}
    if cycle := find_cycle({n: g.get("child_groups", []) for n, g in groups.items()}):
        raise ConfigError("cycle " + " > ".join(cycle))
    known: dict[str, set[str]] = {}

    def members(name: str) -> set[str]:
        if name not in groups:
            raise ConfigError(f"unknown group {name}")
        if name not in known:
            g = groups[name]
            known[name] = set(g.get("meters", [])).union(*map(members, g.get("child_groups", [])))
        return known[name]

    out = [(n, m) for n in groups for m in sorted(members(n))]
    left = {m["meter_id"] for m in cfg.get("meters", [])} - set(get(cfg, "portfolio", "excluded_meters", default=[]))
    return out + [(portfolio, m) for m in sorted(left)]
