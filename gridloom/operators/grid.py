"""Validation, units, regular grids, gap-limited interpolation, day quality and smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.windows import DAY, label_runs, local, ordered, run_bounds

#: Steps of a grid that are made from one row.
LOT = 100_000


def convert_units(df: DataFrame, unit: str, resolution: str = "resolution_minutes") -> DataFrame:
    """kWh of an interval to kW; the input value is kept. A resolution that is not positive raises as the plan runs."""
    if unit not in ("kW", "kWh"):
        raise ValueError(f"unit must be kW or kWh, not {unit}")
    kept = df.withColumn("demand_input_raw", F.col("demand_kw"))
    if unit == "kW":
        return kept
    minutes = F.col(resolution)
    known = F.when(F.coalesce(minutes > 0, F.lit(False)), minutes).otherwise(
        F.raise_error(F.lit("kWh needs a resolution of more than 0 minutes")).cast("double")
    )
    out = kept.withColumn("demand_kw", F.col("demand_kw") * 60 / known)
    return out.withColumn(
        "demand_kw_raw", F.col("demand_kw_raw") * 60 / known
    ) if "demand_kw_raw" in df.columns else out


def dedup_first(df: DataFrame, seq: str) -> DataFrame:
    w = Window.partitionBy("meter_id", "ts_s").orderBy(seq)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def detect_resolution(df: DataFrame) -> DataFrame:
    """meter_id, resolution_minutes: the commonest gap, the smallest of ties; null for a meter of one reading."""
    gaps = df.select("meter_id", "ts_s").distinct().withColumn(
        "gap", F.col("ts_s") - F.lag("ts_s").over(ordered(["meter_id"]))
    )
    counted = gaps.groupBy("meter_id", "gap").agg(F.count("*").alias("n")).where("gap is not null")
    best = counted.groupBy("meter_id").agg(F.min_by("gap", F.struct((-F.col("n")).alias("n"), "gap")).alias("gap"))
    return df.select("meter_id").distinct().join(best, "meter_id", "left").select(
        "meter_id", F.round(F.col("gap") / 60, 4).alias("resolution_minutes")
    )


def validate_input(df: DataFrame) -> DataFrame:
    """Counts of what is wrong with each meter's readings; findings never raise."""
    by_time = df.groupBy("meter_id", "ts_s").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("demand_kw") < 0).alias("neg"),
        F.count_if(F.col("demand_kw") == 0).alias("zero"),
    )
    gaps = by_time.withColumn("gap", F.col("ts_s") - F.lag("ts_s").over(ordered(["meter_id"])))
    got = gaps.join(detect_resolution(df), "meter_id")
    return got.groupBy("meter_id").agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum("neg").alias("negatives"),
        F.sum("zero").alias("zeros"),
        F.max("resolution_minutes").alias("resolution_minutes"),
        F.count_if(F.col("gap") != F.round(F.col("resolution_minutes") * 60)).alias("irregular_intervals"),
    )


def check_report(report: DataFrame, severity: str) -> None:
    """The one forced action: raises where negatives are errors."""
    if severity == "ERROR" and (bad := report.where("negatives > 0").limit(1).collect()):
        raise ValueError(f"negative demand at meter {bad[0]['meter_id']}")


def regularize(
    df: DataFrame, *, max_gap_minutes: float, tz: str = "UTC", resolution: DataFrame | None = None
) -> DataFrame:
    """Each meter on its own grid, from its first reading; bracketed gaps up to ``max_gap_minutes`` are interpolated."""
    steps = (resolution or detect_resolution(df)).select(
        "meter_id", F.coalesce(F.round(F.col("resolution_minutes") * 60), F.lit(3600)).cast("long").alias("step")
    )
    span = df.groupBy("meter_id").agg(F.min("ts_s").alias("a"), F.max("ts_s").alias("b")).join(steps, "meter_id")
    # Steps by the hundred thousand first, so that no row holds a meter's whole life.
    last = F.floor((F.col("b") - F.col("a")) / F.col("step"))
    lots = span.withColumn("last", last).withColumn(
        "lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / LOT)))
    )
    grid = lots.select(
        "meter_id",
        "a",
        "step",
        F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("last"), F.col("lot") * LOT + LOT - 1))).alias("i"),
    )
    grid = grid.select("meter_id", (F.col("a") + F.col("i") * F.col("step")).alias("ts_s"))
    joined = grid.join(
        df.select("meter_id", "ts_s", F.col("demand_kw").alias("read_kw")), ["meter_id", "ts_s"], "left"
    ).withColumn("v", F.expr("if(read_kw >= 0, read_kw, null)"))
    w = ordered(["meter_id"])
    point = F.when(F.col("v").isNotNull(), F.struct("ts_s", "v"))
    prev = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # The next point, as a running last in the reverse order, so that every frame grows.
    following = F.last(point, ignorenulls=True).over(
        Window.partitionBy("meter_id").orderBy(F.desc("ts_s")).rowsBetween(Window.unboundedPreceding, -1)
    )
    b = joined.withColumn("p", prev).withColumn("n", following)
    fill = F.when(
        F.col("v").isNull() & ((F.col("n.ts_s") - F.col("p.ts_s")) <= max_gap_minutes * 60),
        F.col("p.v") + (F.col("ts_s") - F.col("p.ts_s")) / (
            F.col("n.ts_s") - F.col("p.ts_s")
        ) * (F.col("n.v") - F.col("p.v")),
    )
    out = b.withColumn("fill", fill).withColumn("demand_kw", F.coalesce("v", "fill"))
    out = out.withColumn("is_observed", F.col("read_kw").isNotNull()).withColumn(
        "is_interpolated", F.col("fill").isNotNull() & ~F.col("is_observed")
    )
    out = out.withColumn("is_missing", F.col("demand_kw").isNull()).withColumn(
        "interpolation_method", F.when(F.col("is_interpolated"), F.lit("linear"))
    )
    flag = F.when(F.col("is_observed"), "observed").when(F.col("is_interpolated"), "interpolated").otherwise("missing")
    out = out.withColumn("data_quality_flag", flag).withColumnRenamed("read_kw", "demand_kw_raw")
    return local(out.drop("v", "p", "n", "fill"), tz)


def longest_gap(df: DataFrame) -> DataFrame:
    """Per day the longest missing run in minutes, up to the first reading after it."""
    runs = run_bounds(label_runs(df, F.col("is_missing"), DAY), DAY, "run", "is_missing").where("is_missing")
    return runs.groupBy(*DAY).agg(F.max((F.col("end_s") - F.col("start_s")) / 60).alias("longest_missing_gap_minutes"))


def daily_quality(df: DataFrame, *, min_completeness: float = 0.75) -> DataFrame:
    counts = df.groupBy(*DAY).agg(
        F.count("*").alias("expected_intervals"),
        F.count_if("is_observed").alias("observed_intervals"),
        F.count_if("is_interpolated").alias("interpolated_intervals"),
        F.count_if("is_missing").alias("missing_intervals"),
    )
    got = counts.join(longest_gap(df), DAY, "left").withColumn(
        "gap", F.coalesce("longest_missing_gap_minutes", F.lit(0.0))
    )
    share = F.col("observed_intervals") / F.col("expected_intervals")
    status = F.when(
        (share >= min_completeness) & (F.col("gap") <= 60), "GOOD"
    ).when(share >= 0.5, "ACCEPTABLE").when(share >= 0.25, "POOR").otherwise("UNUSABLE")
    return got.select(
        *DAY,
        "expected_intervals",
        "observed_intervals",
        "interpolated_intervals",
        "missing_intervals",
        F.round(share, 4).alias("completeness_fraction"),
        F.round(F.col("interpolated_intervals") / F.col("expected_intervals"), 4).alias("interpolation_fraction"),
        F.round("gap", 1).alias("longest_missing_gap_minutes"),
        status.alias("quality_status"),
    )


def complete_days(df: DataFrame, per_day: int) -> DataFrame:
    return df.groupBy(*DAY).agg(
        F.count("*").alias("n"), F.count("demand_kw").alias("seen")
    ).where((F.col("n") == per_day) & (F.col("seen") == per_day)).select(*DAY)


def smooth(
    df: DataFrame,
    *,
    method: str = "rolling_median",
    window_minutes: float = 60,
    resolution_minutes: float = 60,
    resolution: DataFrame | None = None,
) -> DataFrame:
    """Adds smooth_kw: a centred median or mean within the day, of an odd number of intervals. ``resolution`` (meter_id,
    resolution_minutes) gives each meter its own window; a meter that it does not know has ``resolution_minutes``."""
    if method == "none":
        return df.withColumn("smooth_kw", F.col("demand_kw"))
    if resolution is None:
        n = max(1, round(window_minutes / resolution_minutes))
        half = (n + (n % 2 == 0)) // 2
        w = ordered(DAY).rowsBetween(-half, half)
        return df.withColumn(
            "smooth_kw",
            (F.expr("percentile(demand_kw, 0.5D)") if method == "rolling_median" else F.avg("demand_kw")).over(w),
        )
    # Windows of several lengths in one plan: the day as an array, and each point's slice of it.
    own = resolution.select(
        "meter_id", F.coalesce("resolution_minutes", F.lit(float(resolution_minutes))).alias("_minutes")
    )
    n = F.greatest(F.lit(1), F.bround(window_minutes / F.col("_minutes")).cast("int"))
    half = F.floor((n + (n % 2 == 0).cast("int")) / 2).cast("int")
    days = df.groupBy(*DAY).agg(
        F.array_sort(
            F.collect_list(
                F.struct("ts_s", F.struct(*[F.col(c) for c in df.columns if c not in (*DAY, "ts_s")]).alias("row"))
            )
        ).alias("points")
    )
    days = days.join(own, "meter_id", "left").withColumn(
        "_minutes", F.coalesce("_minutes", F.lit(float(resolution_minutes)))
    ).withColumn("_half", half)
    values = F.transform("points", lambda p: p["row"]["demand_kw"])
    near = lambda i: F.filter(
        F.slice(
            F.col("values"),
            F.greatest(F.lit(1), i + 1 - F.col("_half")),
            F.least(F.size("values"), i + 1 + F.col("_half")) - F.greatest(F.lit(0), i - F.col("_half")),
        ),
        lambda v: v.isNotNull(),
    )
    mid = lambda xs: (
        F.get(xs, F.floor((F.size(xs) - 1) / 2).cast("int")) + F.get(xs, F.floor(F.size(xs) / 2).cast("int"))
    ) / 2
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs))
    days = days.withColumn("values", values)
    days = days.withColumn(
        "smooth",
        F.transform("points", lambda p, i: mid(F.array_sort(near(i))) if method == "rolling_median" else mean(near(i))),
    )
    each = days.select(*DAY, F.explode(F.arrays_zip("points", "smooth")).alias("x"))
    return each.select(
        *[
            F.col(c) if c in DAY
            else F.col("x.points.ts_s").alias(c) if c == "ts_s"
            else F.col(f"x.points.row.`{c}`").alias(c) for c in df.columns
        ],
        F.col("x.smooth").alias("smooth_kw"),
    )
