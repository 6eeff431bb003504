"""Baseline, normalisation, the operating state machine and operating periods, per meter and local day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.windows import DAY, label_runs, near, ordered, run_bounds, so_far, whole


def sustained_region(
    df: DataFrame, *, value: str = "smooth_kw", low_percentile: float = 10, min_minutes: float = 60
) -> DataFrame:
    """Per day the longest run at or below the low percentile, the earliest of ties; end_s is the first time after it."""
    marked = df.withColumn(
        "thr", F.expr(f"percentile({value}, {low_percentile / 100}D)").over(whole(DAY))
    ).withColumn("low", F.coalesce(F.col(value) <= F.col("thr"), F.lit(False)))
    runs = run_bounds(
        label_runs(marked, F.col("low"), DAY), DAY, "run", "low"
    ).where("low").withColumn("minutes", (F.col("end_s") - F.col("start_s")) / 60)
    best = runs.where(F.col("minutes") >= min_minutes).groupBy(*DAY).agg(
        F.min(F.struct((-F.col("minutes")).alias("m"), "start_s", "end_s")).alias("best")
    )
    return best.select(
        *DAY,
        F.col("best.start_s").alias("region_start_s"),
        F.col("best.end_s").alias("region_end_s"),
        (-F.col("best.m")).alias("region_minutes"),
    )


def baseline(
    df: DataFrame,
    *,
    value: str = "smooth_kw",
    low_percentile: float = 10,
    fallback_percentile: float = 10,
    min_minutes: float = 60,
    range_fraction: float = 0.15,
) -> DataFrame:
    """Per day baseline_kw (median of the sustained low run, else a percentile), peak_kw, operating_range_kw, flags."""
    region = sustained_region(df, value=value, low_percentile=low_percentile, min_minutes=min_minutes)
    joined = df.join(region, DAY, "left")
    inside = F.when(F.col("ts_s").between(F.col("region_start_s"), F.col("region_end_s")), F.col(value))
    got = joined.withColumn("inside", inside).groupBy(*DAY).agg(
        F.expr("percentile(inside, 0.5D)").alias("held"),
        F.expr(f"percentile({value}, {fallback_percentile / 100}D)").alias("fallback"),
        F.max(value).alias("peak"),
        F.avg(value).alias("mean"),
        F.max("region_minutes").alias("region_minutes"),
    )
    base = F.coalesce("held", "fallback")
    # A hair more: halves of a cent that binary fractions just miss round up as the others do.
    cents = lambda c: F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, 2)
    return got.select(
        *DAY,
        cents(base).alias("baseline_kw"),
        cents("peak").alias("peak_kw"),
        cents(F.col("peak") - base).alias("operating_range_kw"),
        F.round(F.coalesce(F.col("region_minutes") / 60, F.lit(0.0)), 3).alias("baseline_hours"),
        F.when(F.col("held").isNotNull(), "hybrid_sustained").otherwise("fallback_percentile").alias("baseline_method"),
        F.coalesce(
            (F.col("mean") > 0) & ((F.col("peak") - base) / F.col("mean") < range_fraction), F.lit(False)
        ).alias("is_continuous"),
    ).where("peak_kw is not null")


def normalize_demand(
    df: DataFrame, base: DataFrame, *, value: str = "demand_kw", peak: str = "observed_max"
) -> DataFrame:
    """Adds baseline columns and normalized_demand: (value - baseline) / (peak - baseline), null without a range. The peak
    is that of the baseline, the rounded greatest smoothed value (values may exceed 1), or the 99th percentile of value."""
    j = df.join(base, DAY, "left")
    top = F.col("peak_kw") if peak == "observed_max" else F.expr(f"percentile({value}, 0.99D)").over(whole(DAY))
    span = top - F.col("baseline_kw")
    return j.withColumn("_span", span).withColumn(
        "normalized_demand", F.when(F.col("_span") > 0, (F.col(value) - F.col("baseline_kw")) / F.col("_span"))
    ).drop("_span")


def hysteresis(df: DataFrame, *, value: str = "smooth_kw", entry: float = 0.20, exit: float = 0.15) -> DataFrame:
    """Adds raw_state. ``df`` has baseline_kw and peak_kw. At or above the entry level the state is OPERATING, at or below
    the exit level BASELINE, between them the last one; missing values are UNKNOWN and leave the latent state alone."""
    if exit >= entry:
        raise ValueError("the exit fraction must be below the entry fraction")
    span = F.col("peak_kw") - F.col("baseline_kw")
    up, down = F.col("baseline_kw") + entry * span, F.col("baseline_kw") + exit * span
    latent = F.coalesce(
        F.last(F.when(F.col(value) >= up, 1).when(F.col(value) <= down, 0), ignorenulls=True).over(so_far(DAY)),
        F.lit(0),
    )
    state = F.when(
        F.col("baseline_kw").isNull() | F.col(value).isNull(), "UNKNOWN"
    ).when(span <= 0, "BASELINE").when(latent == 1, "OPERATING").otherwise("BASELINE")
    return df.withColumn("entry_kw", up).withColumn("exit_kw", down).withColumn("raw_state", state)


def persistence(df: DataFrame, *, min_minutes: float = 30) -> DataFrame:
    """Adds state: runs of raw_state shorter than ``min_minutes`` join the run before; UNKNOWN and the first run stay."""
    runs = label_runs(df, F.col("raw_state"), DAY)
    w = Window.partitionBy(*DAY, "run")
    minutes = (F.max("ts_s").over(w) - F.min("ts_s").over(w)) / 60
    keep = (F.col("run") == 1) | (minutes >= min_minutes) | (F.col("raw_state") == "UNKNOWN")
    return runs.withColumn("_keep", keep).withColumn(
        "state", F.last(F.when(F.col("_keep"), F.col("raw_state")), ignorenulls=True).over(so_far(DAY))
    ).drop("_keep", "run")


def operating_periods(df: DataFrame, *, min_minutes: float = 30, gap_minutes: float = 60) -> DataFrame:
    """Runs of OPERATING of at least ``min_minutes``, those with less than ``gap_minutes`` between them as one, ranked by
    length. A run ends at the first time in another state."""
    runs = run_bounds(
        label_runs(df, F.col("state"), DAY), DAY, "run", "state"
    ).where("state = 'OPERATING'").where((F.col("end_s") - F.col("start_s")) / 60 >= min_minutes)
    w = Window.partitionBy(*DAY).orderBy("start_s")
    fresh = F.coalesce((F.col("start_s") - F.lag("end_s").over(w)) / 60 >= gap_minutes, F.lit(True)).cast("int")
    grouped = runs.withColumn("fresh", fresh).withColumn("grp", F.sum("fresh").over(w)).groupBy(*DAY, "grp").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")
    )
    hours = (F.col("end_s") - F.col("start_s")) / 3600
    rank = F.row_number().over(Window.partitionBy(*DAY).orderBy(hours.desc(), "start_s"))
    return grouped.select(*DAY, "start_s", "end_s", near(hours, 4).alias("duration_hours"), rank.alias("rank"))
