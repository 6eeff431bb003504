"""Whole plans: one meter table to all its day tables, and meter groups to their output tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.windows import DAY
from gridloom.operators import entities, events, features, grid, states, weather
from gridloom.sources.config import entity_members, get, with_defaults
from gridloom.sources.demand import load_meters, load_temperature, write_csv
from gridloom.sources.tables import stage


@dataclass
class MeterTables:
    """Lazy tables over the intervals and their states, which are written once in the shared folder."""

    interval: DataFrame
    daily: DataFrame
    ramps: DataFrame
    peaks: DataFrame
    periods: DataFrame


def run_meters(
    readings: DataFrame,
    cfg: dict | None = None,
    *,
    tz: str | None = None,
    order: str | None = "ingest_seq",
    check: bool = True,
) -> MeterTables:
    """All meters and days at once, each meter at its own resolution. ``readings``: meter_id, ts_s, demand_kw, maybe
    building_id, and the column ``order``, by which the first of several readings of one time counts; order = None says
    that times are unique."""
    cfg = with_defaults(cfg)
    tz = tz or cfg["timezone"]["default_tz"]
    if order and order not in readings.columns:
        raise ValueError(f"readings have no column {order} to tell which of several readings of one time came first")
    if check:
        grid.check_report(grid.validate_input(readings), cfg["data_quality"]["negative_demand_severity"])
    unique = grid.dedup_first(readings, order) if order else readings
    resolution = stage(grid.detect_resolution(unique), "resolution")
    if cfg["input"]["unit"] == "kWh":
        unique = grid.convert_units(unique.join(resolution, "meter_id"), "kWh").drop("resolution_minutes")
    regular = grid.regularize(
        unique, max_gap_minutes=cfg["data_quality"]["max_interpolation_gap_minutes"], tz=tz, resolution=resolution
    )
    smooth = grid.smooth(
        regular,
        method=cfg["smoothing"]["method"],
        window_minutes=cfg["smoothing"]["window_minutes"],
        resolution=resolution,
    )
    buildings = readings.groupBy("meter_id").agg(
        F.first("building_id", ignorenulls=True).alias("building_id")
    ) if "building_id" in readings.columns else None
    b = cfg["baseline"]
    base = states.baseline(
        smooth,
        low_percentile=b["low_demand_percentile"],
        fallback_percentile=b["continuous_operation_fallback_percentile"],
        min_minutes=b["min_persistence_minutes"],
        range_fraction=b["continuous_operation_range_fraction"],
    )
    s = states.normalize_demand(smooth, base, peak=cfg["normalization"]["peak_for_normalization"])
    t = cfg["operating_threshold"]
    s = states.persistence(
        states.hysteresis(s, entry=t["alpha_entry"], exit=t["alpha_exit"]),
        min_minutes=t["min_state_persistence_minutes"],
    )
    # All day tables start from here, the baseline and the quality of the days included.
    s = stage(s, "states")
    base = s.where("baseline_kw is not null").select(
        *DAY, "baseline_kw", "operating_range_kw", "is_continuous"
    ).distinct()
    periods = states.operating_periods(
        s,
        min_minutes=cfg["multiple_periods"]["min_period_duration_minutes"],
        gap_minutes=cfg["multiple_periods"]["min_baseline_gap_minutes"],
    )
    gradual = cfg["smoothing"]["window_minutes"]
    starts = events.best_event(events.start_candidates(s), cfg["start_detection"], gradual_minutes=gradual)
    ends = events.best_event(events.end_candidates(s), cfg["end_detection"], gradual_minutes=gradual)
    ramps = events.ramp_events(s, cfg=cfg["ramp_detection"])
    peaks = events.peak_events(s, cfg=cfg["peak_detection"], widths=tuple(cfg["breadth"]["peak_thresholds"]))
    quality = grid.daily_quality(s, min_completeness=cfg["data_quality"]["min_completeness_fraction"])
    vector = features.daily_features(
        s,
        base,
        quality,
        starts,
        ends,
        ramps,
        peaks,
        periods,
        tuple(cfg["breadth"]["operating_thresholds"]),
        tz=tz,
        resolution=resolution,
        buildings=buildings,
        energy=cfg["breadth"]["compute_energy_breadth"],
    )
    keep = [
        "meter_id",
        "ts_s",
        "local_date",
        "hour",
        "demand_kw",
        "demand_kw_raw",
        "is_observed",
        "is_interpolated",
        "is_missing",
        "data_quality_flag",
        F.col("smooth_kw").alias("analysis_demand_kw"),
        "normalized_demand",
        "baseline_kw",
        "state",
    ]
    return MeterTables(
        s.select(*keep), features.classify_day(vector, cfg["classification"], tz=tz), ramps, peaks, periods
    )


@dataclass
class EntityTables:
    meter_interval: DataFrame
    entity_interval: DataFrame
    entity_daily: DataFrame
    study_coincidence: DataFrame
    daily_coincidence: DataFrame


def run_entities(
    interval: DataFrame,
    members: DataFrame,
    cfg: dict | None = None,
    *,
    tz: str | None = None,
    temperature: DataFrame | None = None,
) -> EntityTables:
    """The five output tables by the settings of [der]. ``interval``: of run_meters; ``members``: entity_id, meter_id."""
    cfg = with_defaults(cfg)
    tz, d = tz or cfg["timezone"]["default_tz"], cfg["der"]
    seasons = {int(k): v for k, v in d["calendar"]["season_map"].items()} or None
    total = entities.entity_sum(interval, members, min_count=d["aggregation"]["min_count"])
    frame = entities.calendar(total, tz=tz, holidays=tuple(map(str, d["calendar"]["holidays"])), seasons=seasons)
    if temperature is not None:
        t = d["temperature"]
        minutes = t["join_tolerance_minutes"]
        joined = weather.asof_nearest(
            frame, temperature, tolerance_seconds=None if minutes is None else int(minutes * 60)
        )
        frame = weather.temp_policy(joined, override=t["override_existing"])
        frame = frame.withColumn(
            "temperature_band", weather.band(F.col("temperature_f"), tuple(t["bands"]["boundaries"]))
        )
    segments = {k: tuple(v) for k, v in d["time_of_day"]["segments"].items()}
    daily = entities.daily_summary(frame, tz=tz).join(
        entities.tod_segments(frame, segments), entities.ENTITY_DAY, "left"
    )
    least = d["coincidence"]["min_meters"]
    return EntityTables(
        interval,
        frame,
        daily,
        entities.coincidence(interval, members, min_meters=least),
        entities.coincidence(interval, members, daily=True, min_meters=least),
    )


def run_configured(spark: SparkSession, cfg: dict) -> tuple[MeterTables, EntityTables]:
    """The whole run from settings alone: the sources of all meters, their groups and the portfolio, and temperature."""
    cfg = with_defaults(cfg)
    tables = run_meters(load_meters(spark, cfg), cfg)
    members = spark.createDataFrame(entity_members(cfg), "entity_id string, meter_id string")
    source = cfg["der"]["temperature"]["source"]
    outside = None if source is None else load_temperature(spark, source, cfg)
    return tables, run_entities(tables.interval, members, cfg, temperature=outside)


#: Settings that name the files of the tables.
OUTPUTS = {
    "daily": "daily_features_csv",
    "ramps": "ramp_events_csv",
    "peaks": "peak_events_csv",
    "interval": "interval_analysis_csv",
}


def export_configured(tables: MeterTables | EntityTables, cfg: dict, folder: str = "") -> dict[str, str]:
    """Writes the tables that are not empty and whose path is set in [output] or [der.output]."""
    meters = isinstance(tables, MeterTables)
    paths = get(cfg, "output", default={}) if meters else get(cfg, "der", "output", default={})
    out = {}
    for f in fields(tables):
        path = paths.get(OUTPUTS.get(f.name, "") if meters else f"{f.name}_csv")
        if path and (written := write_csv(_flat(getattr(tables, f.name)), f"{folder}/{path}" if folder else path)):
            out[f.name] = written
    return out


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes]
    )


def export(tables: MeterTables | EntityTables, folder: str, names: tuple[str, ...] | None = None) -> dict[str, str]:
    """Writes the tables that are not empty (those in ``names``, or all) as CSV; nested columns as JSON. Returns paths."""
    out = {}
    for f in fields(tables):
        if names and f.name not in names:
            continue
        df = getattr(tables, f.name)
        if path := write_csv(_flat(df), f"{folder}/{f.name}"):
            out[f.name] = path
    return out


__all__ = [
    "DAY", "EntityTables", "MeterTables", "export", "export_configured", "run_configured", "run_entities", "run_meters"
]
