"""Meter groups: sums, calendar, time of day, demand families, load shape, recurring patterns, outliers, coincidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.windows import first_max
from gridloom.operators.grid import detect_resolution
from gridloom.sources.tables import stage

ENTITY_DAY = ["entity_id", "local_date"]
#: Seconds of a stretch of time within which ranks are taken first.
STRETCH = 86_400 * 7
#: Slices of an entity's values, of which only those that hold a wanted rank are sorted.
SLICES = 128
#: Day segments, half-open hours; and seasons by month.
SEGMENTS = {"morning": (6, 10), "midday": (10, 14), "afternoon": (14, 18), "evening": (18, 22)}
SEASONS = {
    12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer",
    8: "summer", 9: "fall", 10: "fall", 11: "fall",
}
#: Limits of load shapes.
SHAPE = {
    "flat_cv_max": 0.15,
    "highly_peaked_ratio_min": 2.0,
    "sharp_peak_width_frac_max": 0.10,
    "sustained_high_frac_min": 0.30,
    "sustained_high_pct_of_peak": 0.90,
    "overnight_heavy_ratio_min": 1.1,
    "multi_peak_min_count": 2,
    "near_peak_segment_fraction": 0.85,
}


#: Rows of a membership table up to which it is broadcast; beyond it the join shuffles by meter.
BROADCAST_ROWS = 500_000


def _with_members(df: DataFrame, members: DataFrame) -> DataFrame:
    few = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(members) if few else members, "meter_id")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def entity_sum(df: DataFrame, members: DataFrame, *, min_count: int = 1) -> DataFrame:
    """Sums of the members' demand. ``members``: entity_id, meter_id."""
    j = _with_members(df, members)
    got = j.groupBy("entity_id", "ts_s").agg(
        F.sum("demand_kw").alias("total"), F.count("demand_kw").alias("n_meters_reporting")
    )
    total = F.coalesce("total", F.lit(0.0)) if min_count == 0 else F.when(
        F.col("n_meters_reporting") >= min_count, F.col("total")
    )
    return got.select(
        "entity_id", "ts_s", total.alias("demand_kw"), "n_meters_reporting"
    ).withColumn("is_missing", F.col("demand_kw").isNull())


def calendar(
    df: DataFrame, *, holidays: tuple[str, ...] = (), tz: str = "UTC", seasons: dict[int, str] | None = None
) -> DataFrame:
    t = F.from_utc_timestamp(F.timestamp_seconds("ts_s"), tz)
    day = F.to_date(t)
    free = F.lit(False) if not holidays else day.cast("string").isin(*holidays)
    season = F.create_map(*[x for k, v in (seasons or SEASONS).items() for x in (F.lit(k), F.lit(v))])
    return df.withColumns(
        {
            "local_date": day,
            "year": F.year(t),
            "month": F.month(t),
            "day": F.dayofmonth(t),
            "day_of_year": F.dayofyear(t),
            "hour": F.hour(t),
            "minute": F.minute(t),
            "day_of_week": F.weekday(t),
            "day_name": F.date_format(t, "EEEE"),
            "is_weekday": F.weekday(t) < 5,
            "is_weekend": F.weekday(t) >= 5,
            "season": season[F.month(t)],
            "day_type": F.when(free, "holiday").when(F.weekday(t) < 5, "weekday").otherwise("weekend"),
        }
    )


def tod_segments(df: DataFrame, segments: dict[str, tuple[int, int]] = SEGMENTS) -> DataFrame:
    """Greatest demand of each segment, and means over the night (22-05) and the day (06-21)."""
    night = (F.col("hour") >= 22) | (F.col("hour") < 6)
    mean = F.avg(F.when(night, F.col("demand_kw")))
    return df.groupBy(*ENTITY_DAY).agg(
        *[
            F.max(F.when((F.col("hour") >= a) & (F.col("hour") < b), F.col("demand_kw"))).alias(f"{k}_peak_kw")
            for k, (a, b) in segments.items()
        ],
        mean.alias("overnight_mean_kw"),
        mean.alias("nighttime_mean_kw"),
        F.avg(F.when(~night, F.col("demand_kw"))).alias("daytime_mean_kw"),
    )


def peak_normalize(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "peak_normalized",
        F.col("demand_kw") / F.nullif(F.max("demand_kw").over(Window.partitionBy(*ENTITY_DAY)), F.lit(0.0)),
    )


def exact_percentiles(df: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """entity_id and a column for each wanted share: the exact percentile of demand_kw, linear between two ranks; no row
    where an entity has no demand. No task sorts a whole entity: its values are counted and written, cut into SLICES
    slices by approximate percentiles, and only slices with a wanted rank are sorted. The cuts affect cost alone."""
    d = F.col("demand_kw")
    shares = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    values = stage(df.where(d.isNotNull()).groupBy("entity_id", "demand_kw").agg(F.count("*").alias("_n")), "values")
    edges = values.groupBy("entity_id").agg(F.percentile_approx(d, shares, 20 * SLICES).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < d))
    sliced = values.join(edges, "entity_id").withColumn("_slice", below).drop("_edges")
    by_slice = Window.partitionBy("entity_id").orderBy("_slice")
    held = sliced.groupBy("entity_id", "_slice").agg(F.sum("_n").alias("_in"))
    held = held.withColumn("_before", F.sum("_in").over(by_slice) - F.col("_in")).withColumn(
        "_last", F.sum("_in").over(Window.partitionBy("entity_id")) - 1
    )
    places = {k: F.lit(float(p)) * F.col("_last") for k, p in wanted.items()}
    ranks = [f(x) for x in places.values() for f in (F.floor, F.ceil)]
    has = [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")) for r in ranks]
    asked = held.where(reduce(Column.__or__, has)).drop("_in")
    upto = F.sum("_n").over(Window.partitionBy("entity_id", "_slice").orderBy("demand_kw"))
    ranked = sliced.join(asked, ["entity_id", "_slice"]).withColumn("_upto", F.col("_before") + upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")), d))

    found = ranked.groupBy("entity_id").agg(
        *[at(F.floor(x)).alias(f"{k}_low") for k, x in places.items()],
        *[at(F.ceil(x)).alias(f"{k}_high") for k, x in places.items()],
        *[F.first(x - F.floor(x)).alias(f"{k}_part") for k, x in places.items()],
    )
    low, high, part = (lambda k, end=end: F.col(f"{k}_{end}") for end in ("low", "high", "part"))
    return found.select("entity_id", *[(low(k) + (high(k) - low(k)) * part(k)).alias(k) for k in wanted])


def demand_families(
    df: DataFrame,
    *,
    thresholds: tuple[float, ...] = (),
    percentiles: tuple[float, ...] = (),
    ranks: tuple[int, ...] = (),
) -> DataFrame:
    name = lambda x: f"{x:g}".replace(".", "_")
    d = F.col("demand_kw")
    for k in thresholds:
        df = df.withColumn(f"meets_threshold_{name(k)}", yes(d >= k))
    if percentiles:
        df = df.join(exact_percentiles(df, {f"_p{name(p)}": p for p in percentiles}), "entity_id", "left")
        for p in percentiles:
            df = df.withColumn(f"top_pct_{name(p)}", yes(d >= F.col(f"_p{name(p)}"))).drop(f"_p{name(p)}")
    for n in ranks:
        # The n of an entity are among the n of each of its stretches of time, so that no sort holds a whole entity.
        stretch = F.floor(F.col("ts_s") / STRETCH)
        near = F.row_number().over(Window.partitionBy("entity_id", stretch).orderBy(d.desc_nulls_last(), "ts_s"))
        some = df.select(
            "entity_id", "ts_s", "demand_kw"
        ).where("demand_kw is not null").withColumn("_near", near).where(F.col("_near") <= n)
        place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("demand_kw"), "ts_s"))
        top = some.withColumn("_place", place).where(F.col("_place") <= n).select(
            "entity_id", "ts_s", F.lit(True).alias(f"top_rank_{n}")
        )
        df = df.join(top, ["entity_id", "ts_s"], "left").withColumn(f"top_rank_{n}", yes(F.col(f"top_rank_{n}")))
    return df


def with_resolution(df: DataFrame) -> DataFrame:
    """Adds resolution_minutes of each entity: its commonest step, 60 where it has none."""
    found = detect_resolution(
        df.select(F.col("entity_id").alias("meter_id"), "ts_s")
    ).withColumnRenamed("meter_id", "entity_id")
    return df.join(found, "entity_id", "left").withColumn(
        "resolution_minutes", F.coalesce("resolution_minutes", F.lit(60.0))
    )


def daily_summary(
    df: DataFrame, *, per_day: int | None = None, resolution_minutes: float | None = None, tz: str = "UTC"
) -> DataFrame:
    """A row for each entity and day; peak_time_minutes counts from local midnight in ``tz``. Without ``per_day`` and
    ``resolution_minutes`` each entity has those of its commonest step."""
    if per_day is None or resolution_minutes is None:
        df = with_resolution(df)
        minutes = F.first("resolution_minutes")
    else:
        minutes = F.lit(float(resolution_minutes))
    got = df.groupBy(*ENTITY_DAY).agg(
        F.count("*").alias("n"),
        F.count("demand_kw").alias("seen"),
        F.sum("demand_kw").alias("total"),
        F.max("demand_kw").alias("maximum_demand_kw"),
        first_max("demand_kw").alias("at"),
        minutes.alias("minutes"),
    )
    whole = F.round(1440 / F.col("minutes")) if per_day is None else F.lit(per_day)
    at = F.from_utc_timestamp(F.timestamp_seconds("at"), tz)
    return got.select(
        *ENTITY_DAY,
        ((F.col("n") == whole) & (F.col("seen") == whole)).alias("is_complete_day"),
        (F.col("total") * F.col("minutes") / 60).alias("daily_energy_kwh"),
        "maximum_demand_kw",
        (F.hour(at) * 60 + F.minute(at)).alias("peak_time_minutes"),
    )


def load_shape(df: DataFrame, tod: DataFrame, *, per_day: int, cfg: dict = SHAPE) -> DataFrame:
    """Flags of a day's shape and the first that fits, in a fixed order. ``df`` has is_local_peak and is_local_valley."""
    top = F.max("demand_kw").over(Window.partitionBy(*ENTITY_DAY))
    high = yes(F.col("demand_kw") >= cfg["sustained_high_pct_of_peak"] * F.col("_top")).cast("double")
    got = df.withColumn("_top", top).withColumn("_high", high).groupBy(*ENTITY_DAY).agg(
        F.avg("demand_kw").alias("mean_demand_kw"),
        F.stddev_samp("demand_kw").alias("std_demand_kw"),
        F.max("demand_kw").alias("max_demand_kw"),
        F.count("demand_kw").alias("n_observed"),
        F.count_if("is_local_peak").alias("n_local_peaks"),
        F.count_if("is_local_valley").alias("n_local_valleys"),
        F.avg("_high").alias("high_fraction"),
    )
    c = F.col
    s = got.join(tod, ENTITY_DAY, "left").withColumn(
        "cv", c("std_demand_kw") / F.nullif(c("mean_demand_kw"), F.lit(0.0))
    ).withColumn(
        "peak_to_average_ratio", c("max_demand_kw") / F.nullif(c("mean_demand_kw"), F.lit(0.0))
    )
    s = s.withColumns(
        {
            f"has_{k}_peak": yes(c(f"{k}_peak_kw") >= cfg["near_peak_segment_fraction"] * c("max_demand_kw"))
            for k in SEGMENTS
        }
    )
    s = s.withColumns(
        {
            "is_unusual": c("n_observed") / per_day < 0.5,
            "is_flat": yes(c("cv") <= cfg["flat_cv_max"]),
            "is_highly_peaked": yes(c("peak_to_average_ratio") >= cfg["highly_peaked_ratio_min"]),
            "is_overnight_heavy": yes(
                c("overnight_mean_kw") / F.nullif(c("daytime_mean_kw"), F.lit(0.0)) >= cfg["overnight_heavy_ratio_min"]
            ),
            "is_multi_peak": c("n_local_peaks") >= cfg["multi_peak_min_count"],
            "has_peak_valley_pattern": (c("n_local_peaks") >= 1) & (c("n_local_valleys") >= 1),
            "has_sharp_peak": yes(c("high_fraction") <= cfg["sharp_peak_width_frac_max"]),
            "has_sustained_high_load": yes(c("high_fraction") >= cfg["sustained_high_frac_min"]),
        }
    )
    sharp = c("is_highly_peaked") & c("has_sharp_peak")
    shape = (
        F.when(c("is_unusual"), "insufficient_data").when(
            sharp & c("has_morning_peak") & ~c("has_afternoon_peak") & ~c("has_evening_peak"), "morning_peak"
        ).when(
            sharp & c("has_afternoon_peak"), "afternoon_peak"
        ).when(
            sharp & c("has_evening_peak"), "evening_peak"
        ).when(
            sharp & c("has_midday_peak"), "midday_peak"
        ).when(c("is_multi_peak"), "multi_peak").when(
            c("is_overnight_heavy"), "overnight_heavy"
        ).when(c("is_flat"), "flat").otherwise("mixed_other")
    )
    return s.withColumn("der_primary_shape", shape)


def _support(days: DataFrame, keys: list[str], complete: DataFrame, min_days: int) -> DataFrame:
    got = days.groupBy("entity_id", *keys).agg(
        F.count("*").alias("n_days"), F.array_sort(F.collect_list("local_date")).alias("dates")
    ).where(F.col("n_days") >= min_days)
    return got.join(complete, "entity_id").withColumn(
        "statistical_support", F.col("n_days") / F.col("n_complete")
    ).drop("n_complete")


def recurring_timing(summary: DataFrame, *, window_minutes: int = 30, min_days: int = 3) -> DataFrame:
    days = summary.where("is_complete_day").withColumn(
        "window_start_minutes", (F.floor(F.col("peak_time_minutes") / window_minutes) * window_minutes).cast("int")
    )
    complete = days.groupBy("entity_id").agg(F.count("*").alias("n_complete"))
    return _support(days, ["window_start_minutes"], complete, min_days).withColumn(
        "window_end_minutes", F.col("window_start_minutes") + window_minutes
    )


def recurring_shape(summary: DataFrame, shapes: DataFrame, *, min_days: int = 3) -> DataFrame:
    days = summary.where("is_complete_day").join(
        shapes.select(*ENTITY_DAY, F.col("der_primary_shape").alias("primary_shape")), ENTITY_DAY
    )
    complete = summary.where("is_complete_day").groupBy("entity_id").agg(F.count("*").alias("n_complete"))
    return _support(days.where("primary_shape <> 'insufficient_data'"), ["primary_shape"], complete, min_days)


def outlier_days(summary: DataFrame, *, limit: float = 2.5, min_days: int = 5) -> DataFrame:
    w = Window.partitionBy("entity_id", "metric")
    long = summary.where("is_complete_day").select(
        *ENTITY_DAY,
        F.expr(
            "stack(2, 'daily_energy_kwh', daily_energy_kwh, 'maximum_demand_kw', maximum_demand_kw) as (metric, value)"
        ),
    )
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    return long.withColumn("n", F.count("*").over(w)).withColumn("z_score", z).where(
        (F.col("n") >= min_days) & (F.abs("z_score") >= limit)
    ).drop("n")


def coincidence(
    df: DataFrame, members: DataFrame, *, daily: bool = False, min_meters: int = 2, order: str | None = None
) -> DataFrame:
    """Greatest sum of the meters over the sum of their own greatest demands, for the study or each day. ``order``: a
    column by which the first of several readings of a meter at one time counts; without it readings are unique."""
    keys = ["entity_id", *(["local_date"] if daily else [])]
    some = df.where("demand_kw is not null")
    if order:
        days = [c for c in ("local_date",) if c in df.columns]
        some = some.groupBy("meter_id", "ts_s", *days).agg(F.min_by("demand_kw", order).alias("demand_kw"))
    j = _with_members(some, members)
    own = j.groupBy(*keys, "meter_id").agg(F.max("demand_kw").alias("m"))
    enough = j.groupBy("entity_id", "meter_id").agg(F.lit(1)).groupBy("entity_id").agg(F.count("*").alias("n_study"))
    own = own.groupBy(*keys).agg(F.sum("m").alias("sum_of_individual_peaks_kw"), F.count("*").alias("n_meters"))
    total = j.groupBy(*keys, "ts_s").agg(F.sum("demand_kw").alias("t"))
    group = total.groupBy(*keys).agg(
        F.max("t").alias("group_peak_kw"),
        F.min_by("ts_s", F.struct((-F.col("t")).alias("t"), "ts_s")).alias("coincident_peak_s"),
    )
    got = own.join(group, keys).join(enough, "entity_id")
    ok = (F.col("n_study") >= min_meters) & (F.col("sum_of_individual_peaks_kw") > 0)
    got = got.withColumn("success", ok).withColumn(
        "coincidence_factor", F.when(ok, F.col("group_peak_kw") / F.col("sum_of_individual_peaks_kw"))
    )
    if daily:
        return got.where(F.col("n_study") >= min_meters).drop("n_study")
    # Of the study every entity has a row, with no figures where it has too few meters.
    figures = ["sum_of_individual_peaks_kw", "group_peak_kw", "coincident_peak_s"]
    got = members.select("entity_id").distinct().join(got.drop("n_study"), "entity_id", "left").withColumn(
        "success", F.coalesce("success", F.lit(False))
    )
    return got.withColumns({c: F.when(F.col("success"), F.col(c)) for c in figures}).withColumn(
        "n_meters", F.coalesce("n_meters", F.lit(0).cast("long"))
    )


def meter_peaks(df: DataFrame, members: DataFrame, *, daily: bool = False) -> DataFrame:
    """meter_peak_kw of each entity's meters, a row for each."""
    keys = ["entity_id", *(["local_date"] if daily else []), "meter_id"]
    return _with_members(
        df.where("demand_kw is not null"), members
    ).groupBy(*keys).agg(F.max("demand_kw").alias("meter_peak_kw"))
