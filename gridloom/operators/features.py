"""The daily feature vector and its rule-based class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.windows import DAY, iso_text, near, ordered, whole


def daily_stats(df: DataFrame, *, value: str = "demand_kw") -> DataFrame:
    got = df.groupBy(*DAY).agg(
        F.avg(value).alias("average_kw"),
        F.percentile(value, F.lit(0.5)).alias("median_kw"),
        F.min(value).alias("minimum_kw"),
        F.max(value).alias("maximum_kw"),
        F.stddev_samp(value).alias("std_kw"),
    )
    return got.withColumn("cv", F.col("std_kw") / F.nullif(F.col("average_kw"), F.lit(0.0)))


def breadth(df: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Hours and energy shares of the day at or above shares of the normalised demand; shares only where there is a range."""
    stepped = df.withColumn("_step", F.col("ts_s") - F.lag("ts_s").over(ordered(DAY)))
    hours = F.percentile("_step", F.lit(0.5)) / 3600
    ranged = F.max("operating_range_kw") > 0
    out = []
    for t in thresholds:
        name = round(t * 100)
        above = F.col("normalized_demand") >= t
        part = F.sum(F.when(above, F.col("demand_kw")).otherwise(0.0)) / F.nullif(F.sum("demand_kw"), F.lit(0.0))
        out += [
            (F.count_if(above) * hours).alias(f"duration_above_{name}pct_hours"),
            F.when(ranged, part).alias(f"energy_frac_above_{name}pct"),
        ]
    return stepped.groupBy(*DAY).agg(*out)


def peak_concentration(df: DataFrame) -> DataFrame:
    """Shares of the day's sum within the hour, and the two hours, around its first greatest value."""
    key = F.when(F.col("demand_kw").isNotNull(), F.struct((-F.col("demand_kw")).alias("v"), "ts_s"))
    near = df.withColumn("_away", F.abs(F.col("ts_s") - F.min(key).over(whole(DAY))["ts_s"]))
    share = lambda s: F.sum(F.when(F.col("_away") <= s, F.col("demand_kw"))) / F.nullif(F.sum("demand_kw"), F.lit(0.0))
    return near.groupBy(*DAY).agg(
        share(1800).alias("peak_concentration_1hr"), share(3600).alias("peak_concentration_2hr")
    )


def mean_abs_ramp(df: DataFrame) -> DataFrame:
    w = ordered(DAY)
    rate = F.abs((F.col("demand_kw") - F.lag("demand_kw").over(w)) / ((F.col("ts_s") - F.lag("ts_s").over(w)) / 3600))
    return df.withColumn("_rate", rate).groupBy(*DAY).agg(F.avg("_rate").alias("mean_absolute_ramp_kw_per_hr"))


def daily_features(
    states: DataFrame,
    base: DataFrame,
    quality: DataFrame,
    starts: DataFrame,
    ends: DataFrame,
    ramps: DataFrame,
    peaks: DataFrame,
    periods: DataFrame,
    thresholds: tuple[float, ...],
    *,
    tz: str = "UTC",
    resolution: DataFrame | None = None,
    buildings: DataFrame | None = None,
    energy: bool = True,
) -> DataFrame:
    """One row per meter and day; all parts share the day's partitioning. Times are ISO text in ``tz``. ``resolution``:
    meter_id, resolution_minutes; ``buildings``: meter_id, building_id."""
    c = F.col

    def event(df: DataFrame, kind: str, at: str, prefix: str) -> DataFrame:
        return df.select(
            *DAY,
            c("transition_s").alias(f"{prefix}_s"),
            iso_text(c("transition_s"), tz).alias(f"probable_{prefix}_time"),
            iso_text(c("crossing_s"), tz).alias(f"{prefix}_threshold_crossing"),
            at,
            c("delta_kw").alias(f"{kind}_delta_kw"),
            c("duration_hours").alias(f"{kind}_duration_hours"),
            c("ramp_rate_kw_per_hr").alias(f"{kind}_ramp_kw_per_hr"),
            c("max_ramp_rate_kw_per_hr").alias(f"{kind}_max_ramp_kw_per_hr"),
            c("confidence").alias(f"{prefix}_confidence"),
            c("is_gradual").alias(f"{prefix}_is_gradual"),
        )

    period = periods.groupBy(*DAY).agg(
        F.count("*").alias("operating_period_count"),
        near(F.sum("duration_hours"), 4).alias("total_operating_duration_hours"),
    )
    ramp = ramps.groupBy(*DAY).agg(
        F.count("*").alias("ramp_event_count"),
        F.count_if(c("event_type") == "UP").alias("up_ramp_count"),
        F.count_if(c("event_type") == "DOWN").alias("down_ramp_count"),
    )
    first = peaks.where("rank = 1").select(
        *DAY,
        "peak_kw",
        iso_text(c("peak_s"), tz).alias("peak_time"),
        "peak_is_interpolated",
        c("prominence_kw").alias("peak_prominence_kw"),
        c("prominence_fraction").alias("peak_prominence_fraction"),
        *[c(x).alias(f"peak_{x}") for x in peaks.columns if x.startswith("width_")],
        c("confidence").alias("peak_confidence"),
    )
    more = peaks.groupBy(*DAY).agg((F.count("*") - 1).alias("secondary_peak_count"))
    q = quality.select(*DAY, *[c(x).alias(f"dq_{x}") for x in quality.columns if x not in DAY])
    b = base.select(*DAY, "baseline_kw", "operating_range_kw", c("is_continuous").alias("is_continuous_operation"))
    wide = breadth(states, thresholds)
    shares = [x for x in wide.columns if x.startswith("energy_")]
    out = daily_stats(states)
    parts = (
        b,
        q,
        wide,
        peak_concentration(states),
        mean_abs_ramp(states),
        event(starts, "startup", "start_kw", "start"),
        event(ends, "shutdown", "end_kw", "end"),
        period,
        ramp,
        first,
        more,
    )
    for part in parts:
        out = out.join(part, DAY, "left")
    for part in (resolution, buildings):
        out = out if part is None else out.join(part, "meter_id", "left")
    counts = [
        "operating_period_count",
        "total_operating_duration_hours",
        "ramp_event_count",
        "up_ramp_count",
        "down_ramp_count",
        "secondary_peak_count",
    ]
    out = out.fillna(0, counts).fillna(False, ["is_continuous_operation"])
    out = out if energy else out.drop(*shares)
    positive = lambda x, y: F.when(y > 0, x / y)
    known = c("baseline_kw").isNotNull()
    out = out.withColumns(
        {
            "peak_to_average_ratio": F.when(known, positive(c("maximum_kw"), c("average_kw"))),
            "peak_to_baseline_ratio": positive(c("maximum_kw"), c("baseline_kw")),
            "load_factor": F.when(known, positive(c("average_kw"), c("maximum_kw"))),
            "intraday_variability": c("cv"),
            "timezone": F.lit(tz),
            "date": c("local_date").cast("string"),
        }
    )
    exact = {"baseline_kw", "operating_range_kw"}
    return out.select(*[near(x, 4).alias(x) if t == "double" and x not in exact else c(x) for x, t in out.dtypes])


def _hour(seconds: Column, tz: str) -> Column:
    t = F.from_utc_timestamp(F.timestamp_seconds(seconds), tz)
    return F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600


def classify_day(features: DataFrame, cfg: dict, *, tz: str = "UTC") -> DataFrame:
    """Adds primary_class, attributes, classification_confidence and classification_notes."""
    c = F.col
    spread = c("maximum_kw") - c("minimum_kw")
    hour = _hour(c("start_s"), tz)
    primary = (
        F.when(
            F.coalesce("is_continuous_operation", F.lit(False)), "CONTINUOUS"
        ).when(F.coalesce(spread < 5, F.lit(True)), "MINIMAL_LOAD").when(hour < cfg["early_start_before_hour"], "EARLY_START").when(
            hour < cfg["morning_start_before_hour"], "MORNING_START"
        ).when(hour < cfg["midday_start_before_hour"], "MIDDAY_START").when(hour.isNotNull(), "EVENING_START").when(
            F.coalesce("total_operating_duration_hours", F.lit(0.0)) != 0, "NO_CLEAR_START"
        ).otherwise("UNKNOWN")
    )
    either = lambda a, x, b, y: F.when(F.coalesce(a, F.lit(False)), x).when(F.coalesce(b, F.lit(False)), y)
    one = lambda a, x: F.when(F.coalesce(a, F.lit(False)), x)
    hours = F.coalesce("total_operating_duration_hours", F.lit(0.0))
    rapid = cfg["rapid_start_ramp_kw_per_hr"]
    named = F.array(
        either(c("startup_ramp_kw_per_hr") >= rapid, "rapid_start", c("start_is_gradual"), "gradual_start"),
        either(c("shutdown_ramp_kw_per_hr") >= rapid, "rapid_shutdown", c("end_is_gradual"), "gradual_shutdown"),
        either(
            hours >= cfg["long_operation_hours"],
            "long_operating_duration",
            (hours <= cfg["short_operation_hours"]) & (hours > 0),
            "short_operating_duration",
        ),
        either(
            c("peak_width_80_hours") >= cfg["broad_peak_width_80_hours"],
            "broad_peak",
            c("peak_width_80_hours") <= cfg["sharp_peak_width_80_hours"],
            "sharp_peak",
        ),
        one(c("peak_concentration_1hr") >= 0.40, "high_peak_concentration"),
        one(c("operating_period_count") >= cfg["multi_period_min_count"], "multiple_operating_periods"),
        one(c("secondary_peak_count") >= 1, "multiple_peaks"),
        one(c("cv") >= cfg["high_variability_cv_threshold"], "high_intraday_variability"),
    )
    f = features.withColumn("primary_class", primary).withColumn("attributes", F.filter(named, lambda a: a.isNotNull()))
    share = F.when(
        F.coalesce("dq_completeness_fraction", F.lit(0.0)) == 0, 0.5
    ).otherwise(c("dq_completeness_fraction"))
    sure = 0.5 * share + 0.25 * (F.coalesce("start_confidence", F.lit(0.0)) + F.coalesce("end_confidence", F.lit(0.0)))
    note = F.when(
        c("primary_class") == "CONTINUOUS", "Operating range too small relative to daily mean."
    ).when(c("primary_class") == "MINIMAL_LOAD", "Daily demand range is negligible.")
    note = note.when(
        c("primary_class") == "NO_CLEAR_START", "Building operated but no credible start transition was detected."
    ).when(c("primary_class") == "UNKNOWN", "Insufficient information to classify.")
    f = f.withColumn("classification_notes", note.otherwise("Classified from rule-based logic."))
    return f.withColumn(
        "classification_confidence",
        near(
            F.least(
                F.lit(1.0), sure * F.when(c("primary_class").isin("UNKNOWN", "NO_CLEAR_START"), 0.5).otherwise(1.0)
            ),
            4,
        ),
    )


def class_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy("primary_class").agg(F.count("*").alias("n_days"))


def population_summary(classified: DataFrame) -> DataFrame:
    """The counts behind a picture of many days: panel, low (edge of a bin, null for classes), label, n_days. Starts by
    hour of day, widths of peaks and peaks in 20 bins between their least and greatest value."""
    hour = F.substring(
        "probable_start_time", 12, 2
    ).cast("int") + F.substring("probable_start_time", 15, 2).cast("int") / 60
    starts = classified.where("probable_start_time is not null").select(
        F.lit("start_hour").alias("panel"),
        F.floor(hour).cast("double").alias("low"),
        F.lit(None).cast("string").alias("label"),
    )
    out = classified.select(
        F.lit("primary_class").alias("panel"),
        F.lit(None).cast("double").alias("low"),
        F.col("primary_class").alias("label"),
    ).unionByName(starts)
    for panel, value in (("operating_hours", "total_operating_duration_hours"), ("peak_kw", "peak_kw")):
        ends = classified.agg(F.min(value).alias("a"), F.max(value).alias("b"))
        width = (F.col("b") - F.col("a")) / 20
        place = F.when(width > 0, F.least(F.lit(19), F.floor((F.col(value) - F.col("a")) / width))).otherwise(0)
        # One row of ends, joined as such.
        binned = classified.where(F.col(value).isNotNull()).select(value).join(F.broadcast(ends)).select(
            F.lit(panel).alias("panel"),
            F.round(F.col("a") + place * width, 6).alias("low"),
            F.lit(None).cast("string").alias("label"),
        )
        out = out.unionByName(binned)
    return out.groupBy("panel", "low", "label").agg(F.count("*").alias("n_days"))


__all__ = [
    "breadth", "class_distribution", "classify_day", "daily_features", "daily_stats", "mean_abs_ramp",
    "peak_concentration", "population_summary",
]
