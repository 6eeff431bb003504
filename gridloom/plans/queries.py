"""Registered queries of the demand operators, over the hourly event demand of a test folder.

Times come out as epoch seconds, dates as text, and floats rounded to four places, so that they compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.windows import DAY, iso_text, local
from gridloom.operators import changepoint, clustering, entities, events, features, grid, states, weather
from gridloom.plans import pipeline
from gridloom.sources import synthetic
from gridloom.sources.config import with_defaults
from gridloom.sources.demand import hourly_events, instant, project_demand
from gridloom.sources.tables import stage

Query = Callable[[SparkSession, str], DataFrame]
#: Hourly data: gaps of two hours are filled, and three points smoothed.
CFG = {"data_quality": {"max_interpolation_gap_minutes": 120}, "smoothing": {"window_minutes": 180}}
MEMBERS = [
    ("interest", "click"), ("interest", "view"), ("sales", "purchase"), ("sales", "signup"), ("all", "click"),
    ("all", "view"), ("all", "purchase"), ("all", "signup"), ("all", "error"),
]


def show(df: DataFrame) -> DataFrame:
    """Floats rounded, dates as text. A hair more, as halves that binary fractions just miss would go either way."""
    fix = {"double": four, "date": lambda c: F.col(c).cast("string")}
    return df.select(*[fix[t](c).alias(c) if t in fix else F.col(c) for c, t in df.dtypes])


def four(c: str) -> Column:
    return (F.round(F.col(c) + 1e-7, 4) + 0.0).alias(c)


def members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEMBERS, "entity_id string, meter_id string")


def regular(spark: SparkSession, d: str) -> DataFrame:
    return grid.regularize(hourly_events(spark, d), max_gap_minutes=120)


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    return grid.smooth(regular(spark, d), window_minutes=180, resolution_minutes=60)


def based(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = smoothed(spark, d)
    b = states.baseline(s)
    return s, b


def stated(spark: SparkSession, d: str) -> DataFrame:
    s, b = based(spark, d)
    return states.persistence(states.hysteresis(states.normalize_demand(s, b)))


def frame(spark: SparkSession, d: str) -> DataFrame:
    return entities.calendar(entities.entity_sum(regular(spark, d), members(spark)), holidays=("2024-01-15",))


def order_days(spark: SparkSession, d: str) -> DataFrame:
    """The calendar of the orders, which have all months."""
    at = spark.read.parquet(f"{d}/orders.parquet").select(F.unix_timestamp("o_orderdate").alias("ts_s"))
    return entities.calendar(at, holidays=("1995-07-04", "1995-12-25", "1996-07-04", "1996-12-25"))


def temperature(spark: SparkSession, d: str) -> DataFrame:
    """Three-hourly, twenty minutes past, from the hours of the events."""
    hours = hourly_events(spark, d).select("ts_s").distinct().where("ts_s % 10800 = 0")
    return hours.select(
        (F.col("ts_s") + 1200).alias("ts_s"), F.round(60 + 20 * F.sin(F.col("ts_s") / 86400), 1).alias("temperature_f")
    )


def weathered(spark: SparkSession, d: str) -> DataFrame:
    return weather.asof_nearest(
        frame(spark, d).select("entity_id", "ts_s", "demand_kw"), temperature(spark, d), tolerance_seconds=4800
    )


def xy(spark: SparkSession, d: str) -> DataFrame:
    days = local(weathered(spark, d)).groupBy("entity_id", "local_date").agg(
        F.avg("external_temperature_f").alias("x"), F.avg("demand_kw").alias("y")
    )
    return changepoint.clean(days.select("entity_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d)
    return entities.load_shape(events.local_extrema(f, key="entity_id"), entities.tod_segments(f), per_day=24)


def summary(spark: SparkSession, d: str) -> DataFrame:
    return entities.daily_summary(frame(spark, d), per_day=24, resolution_minutes=60)


def model(df: DataFrame) -> DataFrame:
    return df.select(
        "entity_id",
        "model_type",
        four("r_squared"),
        four("adjusted_r_squared"),
        "n_points",
        F.array_join(F.transform("breakpoints", lambda x: x.cast("int").cast("string")), ",").alias("breakpoints"),
    )


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Readings with some repeated and some negated ones, in an order of arrival."""
    h = hourly_events(spark, d)
    again = h.where("ts_s % 50400 = 0").select(
        "meter_id", "ts_s", (F.col("demand_kw") + 1).alias("demand_kw"), F.lit(2).alias("ingest_seq")
    )
    low = h.withColumn(
        "demand_kw", F.when(F.col("ts_s") % 72000 == 0, -F.col("demand_kw")).otherwise(F.col("demand_kw"))
    )
    return low.withColumn("ingest_seq", F.lit(1)).unionByName(again)


SHAPE_FLAGS = [
    *[f"has_{k}_peak" for k in entities.SEGMENTS],
    "is_unusual",
    "is_highly_peaked",
    "is_overnight_heavy",
    "has_peak_valley_pattern",
    "has_sharp_peak",
    "has_sustained_high_load",
]


def quarter(spark: SparkSession, d: str) -> pipeline.MeterTables:
    """The same demand by quarter hours for two meters and by hours for the others, in one plan."""
    e = spark.read.parquet(f"{d}/events.parquet").select(
        "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "value"
    )
    step = F.when(F.col("event_type").isin("click", "view"), 900).otherwise(3600)
    fine = e.groupBy(
        F.col("event_type").alias("meter_id"), (F.col("at") - F.col("at") % step).alias("ts_s")
    ).agg(F.round(F.sum("value"), 2).alias("demand_kw"))
    return pipeline.run_meters(
        fine,
        {"smoothing": {"window_minutes": 60}, "data_quality": {"max_interpolation_gap_minutes": 120}},
        order=None,
        check=False,
    )


def repeated(spark: SparkSession, d: str) -> DataFrame:
    """Local texts of the hours around an autumn change, without offsets, in the order of the readings."""
    hours = hourly_events(spark, d).where("meter_id = 'click'").select(
        "ts_s", "demand_kw", F.row_number().over(Window.partitionBy("meter_id").orderBy("ts_s")).alias("ingest_seq")
    )
    first = hours.groupBy().agg(F.min("ts_s").alias("a"))
    moved = hours.join(F.broadcast(first)).withColumn(
        "true_s", F.col("ts_s") - F.col("a") + 1730505600
    ).drop("a", "ts_s")
    wall = moved.withColumn(
        "wall",
        F.date_format(F.from_utc_timestamp(F.timestamp_seconds("true_s"), "America/Chicago"), "yyyy-MM-dd HH:mm:ss"),
    )
    return project_demand(
        wall, ts="wall", demand="demand_kw", tz="America/Chicago", seq="ingest_seq"
    ).select("ts_s", four("demand_kw"))


def local_summary(spark: SparkSession, d: str) -> DataFrame:
    tz = "America/Chicago"
    f = entities.calendar(entities.entity_sum(regular(spark, d), members(spark)), tz=tz)
    return entities.daily_summary(f, tz=tz)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Portfolio demand by hour, its daily peak and when it is."""
    s = entities.entity_sum(hourly_events(spark, d), members(spark).where("entity_id = 'all'"))
    return show(
        local(s).groupBy("entity_id", "local_date").agg(
            F.max("demand_kw").alias("peak_kw"),
            F.min_by("hour", F.struct((-F.col("demand_kw")).alias("v"), "ts_s")).alias("peak_hour"),
            F.max("n_meters_reporting").alias("meters"),
        )
    )


def tables(spark: SparkSession, d: str) -> pipeline.MeterTables:
    return pipeline.run_meters(hourly_events(spark, d), CFG, order=None, check=False)


def written(spark: SparkSession, d: str) -> DataFrame:
    """The hours as a file would hold them: local wall-clock text, and columns of other names."""
    return hourly_events(spark, d).select(
        F.col("meter_id").alias("m"),
        F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd HH:mm:ss").alias("wall"),
        F.col("demand_kw").alias("kw"),
    )


def daily(*columns: str) -> Query:
    return lambda s, d: show(tables(s, d).daily.select(*DAY, *columns))


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Absolute and peak-normalized days of all entities, and their clusters, written once."""
    m = stage(clustering.profiles(frame(spark, d), per_day=24), "profiles")
    return m, stage(clustering.cluster_profiles(m), "clusters")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return show(clustering.labels(_clusters(spark, d)[1]))


def _cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    m, c = _clusters(spark, d)
    return show(clustering.cluster_stats(c, m).drop("center"))


def _select_k(spark: SparkSession, d: str) -> DataFrame:
    c = _clusters(spark, d)[1].where("success")
    return show(
        c.select("entity_id", "profile_kind", F.col("k").alias("chosen_k"), F.explode("scores").alias("s")).select(
            "entity_id", "profile_kind", "s.k", (F.col("s.k") == F.col("chosen_k")).alias("chosen"), "s.silhouette"
        )
    )


def _ext(column: str) -> Query:
    return lambda s, d: show(getattr(pipeline.run_entities(tables(s, d).interval, members(s)), column))


G = ["meter_id", "ts_s"]
cfg = with_defaults(CFG)
QUERIES: dict[str, Query] = {
    "flagship": flagship,
    "scan_demand": lambda s, d: show(hourly_events(s, d)),
    "dedup_first": lambda s, d: show(grid.dedup_first(dirty(s, d), "ingest_seq").select(*G, "demand_kw")),
    "detect_resolution": lambda s, d: show(grid.detect_resolution(hourly_events(s, d))),
    "validate_input": lambda s, d: show(grid.validate_input(dirty(s, d))),
    "convert_units": lambda s, d: show(
        grid.convert_units(
            hourly_events(s, d).withColumn("resolution_minutes", F.lit(15.0)), "kWh"
        ).select(*G, "demand_kw", "demand_input_raw")
    ),
    "regularize": lambda s, d: show(
        regular(s, d).select(
            *G, "demand_kw", "demand_kw_raw", "is_observed", "is_interpolated", "is_missing", "data_quality_flag"
        )
    ),
    "interpolate": lambda s, d: show(
        regular(s, d).where("is_interpolated").select(*G, "demand_kw", "interpolation_method")
    ),
    "segment_days": lambda s, d: show(regular(s, d).groupBy(*DAY).agg(F.count("*").alias("n_intervals"))),
    "longest_gap": lambda s, d: show(grid.longest_gap(regular(s, d))),
    "daily_quality": lambda s, d: show(grid.daily_quality(regular(s, d))),
    "complete_days": lambda s, d: show(grid.complete_days(regular(s, d), 24)),
    "smooth_median": lambda s, d: show(smoothed(s, d).select(*G, "smooth_kw")),
    "smooth_mean": lambda s, d: show(
        grid.smooth(
            regular(s, d), method="rolling_mean", window_minutes=180, resolution_minutes=60
        ).select(*G, "smooth_kw")
    ),
    "sustained_region": lambda s, d: show(states.sustained_region(smoothed(s, d))),
    "baseline": lambda s, d: show(based(s, d)[1]),
    "normalize_demand": lambda s, d: show(stated(s, d).select(*G, "normalized_demand")),
    "hysteresis": lambda s, d: show(stated(s, d).select(*G, "raw_state")),
    "persistence": lambda s, d: show(stated(s, d).select(*G, "state")),
    "operating_periods": lambda s, d: show(states.operating_periods(stated(s, d))),
    "start_candidates": lambda s, d: show(
        events.start_candidates(stated(s, d)).select(
            *DAY, "transition_s", "crossing_s", "delta_kw", "duration_hours", "persistence_hours", "avg_rate"
        )
    ),
    "end_candidates": lambda s, d: show(
        events.end_candidates(stated(s, d)).select(
            *DAY, "transition_s", "crossing_s", "delta_kw", "duration_hours", "persistence_hours", "avg_rate"
        )
    ),
    "start_event": lambda s, d: show(
        events.best_event(events.start_candidates(stated(s, d)), cfg["start_detection"], gradual_minutes=180)
    ),
    "end_event": lambda s, d: show(
        events.best_event(events.end_candidates(stated(s, d)), cfg["end_detection"], gradual_minutes=180)
    ),
    "interval_ramps": lambda s, d: show(events.interval_ramps(smoothed(s, d)).select(*G, "ramp_kw_per_hr")),
    "ramp_groups": lambda s, d: show(events.ramp_groups(smoothed(s, d))),
    "ramp_events": lambda s, d: show(events.ramp_events(stated(s, d), cfg=cfg["ramp_detection"])),
    "local_maxima": lambda s, d: show(
        events.local_maxima(regular(s, d)).select(*DAY, F.explode("peaks").alias("p")).select(
            *DAY, "p.ts_s", F.col("p.v").alias("kw")
        )
    ),
    "prominence": lambda s, d: show(events.prominence(events.local_maxima(regular(s, d)))),
    "peak_nms": lambda s, d: show(
        events.separated(events.prominence(events.local_maxima(regular(s, d))), min_minutes=180)
    ),
    "peak_events": lambda s, d: show(events.peak_events(stated(s, d), cfg=cfg["peak_detection"])),
    "local_extrema": lambda s, d: show(
        events.local_extrema(regular(s, d)).select(*G, "is_local_peak", "is_local_valley")
    ),
    "der_peak_events": lambda s, d: show(
        events.der_peak_events(
            frame(s, d), F.col("demand_kw") >= 300, definition="over_300", key="entity_id", gap=1, sustained_hours=2.0
        )
    ),
    "entity_sum": lambda s, d: show(entities.entity_sum(regular(s, d), members(s))),
    "calendar": lambda s, d: show(frame(s, d).drop("demand_kw", "n_meters_reporting", "is_missing")),
    "season_daytype": lambda s, d: order_days(s, d).groupBy("season", "day_type").agg(
        F.count("*").alias("n"), F.count_distinct("local_date").alias("n_days")
    ),
    "tod_segments": lambda s, d: show(entities.tod_segments(frame(s, d))),
    "peak_normalize": lambda s, d: show(
        entities.peak_normalize(frame(s, d)).select("entity_id", "ts_s", "peak_normalized")
    ),
    "fam_threshold": lambda s, d: show(
        entities.demand_families(frame(s, d), thresholds=(300.0,)).select("entity_id", "ts_s", "meets_threshold_300")
    ),
    "fam_percentile": lambda s, d: show(
        entities.demand_families(frame(s, d), percentiles=(0.9,)).select("entity_id", "ts_s", "top_pct_0_9")
    ),
    "fam_rank": lambda s, d: show(
        entities.demand_families(frame(s, d), ranks=(10,)).select("entity_id", "ts_s", "top_rank_10")
    ),
    "daily_summary": lambda s, d: show(summary(s, d)),
    "load_shape": lambda s, d: show(
        shapes(s, d).select(
            "entity_id", "local_date", "mean_demand_kw", "cv", "n_local_peaks", "high_fraction", "is_flat",
            "is_multi_peak", "der_primary_shape",
        )
    ),
    "recurring_timing": lambda s, d: entities.recurring_timing(summary(s, d)).select(
        "entity_id",
        "window_start_minutes",
        "n_days",
        four("statistical_support"),
        F.array_join(F.transform("dates", lambda x: x.cast("string")), ",").alias("dates"),
    ),
    "recurring_shape": lambda s, d: entities.recurring_shape(summary(s, d), shapes(s, d)).select(
        "entity_id", "primary_shape", "n_days", four("statistical_support")
    ),
    "outlier_days": lambda s, d: show(entities.outlier_days(summary(s, d), limit=1.5)),
    "coincidence_study": lambda s, d: show(entities.coincidence(regular(s, d), members(s))),
    "coincidence_daily": lambda s, d: show(entities.coincidence(regular(s, d), members(s), daily=True)),
    "asof_nearest": lambda s, d: show(weathered(s, d)),
    "temp_policy": lambda s, d: show(
        weather.temp_policy(weathered(s, d).withColumn("temperature_f", F.when(F.col("ts_s") % 7200 == 0, 50.0)))
    ),
    "temp_band": lambda s, d: show(
        weathered(s, d).select(
            "entity_id", "ts_s", weather.band(F.col("external_temperature_f")).alias("temperature_band")
        )
    ),
    "cp_grid": lambda s, d: show(changepoint.breakpoints(xy(s, d))),
    "cp_2p": lambda s, d: model(changepoint.fit_2p(xy(s, d))),
    "cp_3p_cool": lambda s, d: model(changepoint.fit_3p(xy(s, d), "cooling")),
    "cp_3p_heat": lambda s, d: model(changepoint.fit_3p(xy(s, d), "heating")),
    "cp_4p": lambda s, d: model(changepoint.fit_4p(xy(s, d))),
    "cp_5p": lambda s, d: model(changepoint.fit_5p(xy(s, d))),
    "cp_select": lambda s, d: model(changepoint.select_model(xy(s, d))),
    "daily_stats": lambda s, d: show(features.daily_stats(regular(s, d))),
    "breadth": lambda s, d: show(features.breadth(stated(s, d), (0.2, 0.5, 0.8))),
    "peak_concentration": lambda s, d: show(features.peak_concentration(regular(s, d))),
    "mean_abs_ramp": lambda s, d: show(features.mean_abs_ramp(regular(s, d))),
    "daily_features": lambda s, d: show(
        tables(s, d).daily.drop("attributes", "primary_class", "classification_confidence", "classification_notes")
    ),
    "classify_day": lambda s, d: tables(s, d).daily.select(
        *DAY[:1],
        F.col("local_date").cast("string").alias("local_date"),
        "primary_class",
        F.array_join("attributes", ",").alias("attributes"),
        "classification_confidence",
        "classification_notes",
    ),
    "class_distribution": lambda s, d: features.class_distribution(tables(s, d).daily),
    "profile_matrix": lambda s, d: clustering.profile_matrix(frame(s, d), per_day=24).select(
        "entity_id",
        F.col("local_date").cast("string").alias("local_date"),
        F.size("profile").alias("n"),
        F.round(F.aggregate("profile", F.lit(0.0), lambda a, x: a + x) + 1e-7, 2).alias("total"),
    ),
    "kmeans_labels": _labels,
    "cluster_stats": _cluster_stats,
    "meter_interval": lambda s, d: show(tables(s, d).interval),
    "entity_interval": _ext("entity_interval"),
    "entity_daily": _ext("entity_daily"),
    "study_coincidence": lambda s, d: show(pipeline.run_entities(tables(s, d).interval, members(s)).study_coincidence),
    "daily_coincidence": lambda s, d: show(pipeline.run_entities(tables(s, d).interval, members(s)).daily_coincidence),
    "project_demand": lambda s, d: show(
        project_demand(written(s, d), ts="wall", demand="kw", meter="m").drop("building_id")
    ),
    "parse_ts": lambda s, d: (
        lambda w: w.select("wall", instant(w, "wall", "America/Chicago").alias("ts_s"))
    )(written(s, d).select("wall").distinct()),
    "scan_temperature": lambda s, d: show(temperature(s, d)),
    "states": lambda s, d: show(stated(s, d).select(*G, "entry_kw", "exit_kw", "raw_state", "state")),
    "entity_frame": lambda s, d: show(
        frame(s, d).select("entity_id", "ts_s", "local_date", "hour", "demand_kw", "n_meters_reporting", "is_missing")
    ),
    "breadth_hours": lambda s, d: show(
        features.breadth(stated(s, d), (0.2, 0.5, 0.8)).select(
            *DAY, *[f"duration_above_{t}pct_hours" for t in (20, 50, 80)]
        )
    ),
    "breadth_energy": lambda s, d: show(
        features.breadth(stated(s, d), (0.2, 0.5, 0.8)).select(
            *DAY, *[f"energy_frac_above_{t}pct" for t in (20, 50, 80)]
        )
    ),
    "peakiness": daily("peak_to_average_ratio", "peak_to_baseline_ratio", "load_factor"),
    "event_counts": daily(
        "operating_period_count",
        "total_operating_duration_hours",
        "ramp_event_count",
        "up_ramp_count",
        "down_ramp_count",
        "secondary_peak_count",
    ),
    "class_confidence": daily("primary_class", "classification_confidence"),
    "day_attributes": lambda s, d: show(
        tables(s, d).daily.select(*DAY, F.array_join("attributes", ",").alias("attributes"))
    ),
    "peak_width": lambda s, d: (
        lambda p: show(p.select(*DAY, "peak_s", *[c for c in p.columns if c.startswith("width_")]))
    )(events.peak_events(stated(s, d), cfg=cfg["peak_detection"])),
    "primary_shape": lambda s, d: show(shapes(s, d).select("entity_id", "local_date", "der_primary_shape")),
    "select_k": _select_k,
    "quarter_smooth": lambda s, d: show(quarter(s, d).interval.select(*G, "demand_kw", "analysis_demand_kw")),
    "asof_unlimited": lambda s, d: show(
        weather.asof_nearest(
            frame(s, d).select("entity_id", "ts_s", "demand_kw"), temperature(s, d).where("ts_s % 864000 < 259200")
        )
    ),
    "repeated_hour": lambda s, d: repeated(s, d),
    "iso_times": lambda s, d: hourly_events(s, d).select(
        "ts_s", iso_text(F.col("ts_s"), "America/Chicago").alias("iso")
    ).distinct(),
    "meter_peaks": lambda s, d: show(entities.meter_peaks(regular(s, d), members(s))),
    "population_summary": lambda s, d: show(features.population_summary(tables(s, d).daily)),
    "load_shape_flags": lambda s, d: show(shapes(s, d).select("entity_id", "local_date", *SHAPE_FLAGS)),
    "synthetic_days": lambda s, d: show(
        pipeline.run_meters(synthetic.days(s), tz="America/Chicago").daily.drop("attributes")
    ),
    "local_peak_time": lambda s, d: show(local_summary(s, d)),
}
