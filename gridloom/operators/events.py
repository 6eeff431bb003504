"""Start, end, ramp and peak events of a day, local extrema, and gap-bridged peak events.

Steps that depend on what was accumulated before (ramp groups, plateaus, separation) are folds over a day's array of
points; everything else is windows and aggregates on (meter, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.windows import DAY, near, ordered, whole

POINTS = "array<struct<ts_s:bigint,v:double>>"


def points(df: DataFrame, value: str) -> DataFrame:
    """Per day the non-null points in time order."""
    p = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("ts_s", F.col(value).alias("v")))))
    return df.groupBy(*DAY).agg(p.alias("pts"))


def _max_rate(pts: Column, a: Column, b: Column) -> Column:
    """Greatest change per hour between neighbouring points of [a, b]."""
    inside = F.filter(pts, lambda p: (p["ts_s"] >= a) & (p["ts_s"] <= b))
    rate = lambda x, y: F.abs(y["v"] - x["v"]) / ((y["ts_s"] - x["ts_s"]) / 3600)
    return F.array_max(F.zip_with(inside, F.slice(inside, 2, 100000), rate))


def _range(seconds_before: int, seconds_after: int):
    return Window.partitionBy(*DAY).orderBy("ts_s").rangeBetween(-seconds_before, seconds_after)


def start_candidates(df: DataFrame, *, value: str = "smooth_kw") -> DataFrame:
    """Changes from BASELINE (or the day's opening) to OPERATING, with where the rise began and how long it lasts."""
    v = F.col(value)
    before = F.lag("state").over(ordered(DAY))
    low = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("ts_s").alias("ts_s")))).over(_range(7200, 0))
    below = F.min(F.when(v < F.col("entry_kw"), F.col("ts_s"))).over(
        ordered(DAY).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    missing = F.avg(v.isNull().cast("double")).over(_range(3600, 3600))
    marked = df.withColumn("low", low).withColumn(
        "until", F.coalesce(below, F.max("ts_s").over(whole(DAY)))
    ).withColumn("missing_near", missing).withColumn("before", before)
    near = marked.select(*DAY, F.col("ts_s").alias("transition_s"), "missing_near")
    c = marked.where("state = 'OPERATING' and (before = 'BASELINE' or before is null)").select(
        *DAY,
        F.coalesce("low.ts_s", "ts_s").alias("transition_s"),
        F.col("ts_s").alias("crossing_s"),
        F.coalesce(F.col("low.v"), v).alias("start_kw"),
        F.col("entry_kw").alias("threshold_kw"),
        (v - F.coalesce(F.col("low.v"), v)).alias("delta_kw"),
        ((F.col("ts_s") - F.coalesce("low.ts_s", "ts_s")) / 3600).alias("duration_hours"),
        ((F.col("until") - F.col("ts_s")) / 3600).alias("persistence_hours"),
        (v - F.col("entry_kw")).alias("baseline_sep"),
        (F.col("peak_kw") - F.col("baseline_kw")).alias("span"),
    )
    return _rates(c.join(near, [*DAY, "transition_s"], "left"), df, value, "transition_s", "crossing_s")


def end_candidates(df: DataFrame, *, value: str = "smooth_kw") -> DataFrame:
    """Changes from OPERATING to BASELINE. The fall begins at the highest point of the two hours before and ends at the
    lowest of the two hours after; persistence counts the day's BASELINE time up to the change."""
    v = F.col(value)
    high = F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), F.col("ts_s").alias("ts_s")))).over(_range(7200, 0))
    low = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("ts_s").alias("ts_s")))).over(_range(0, 7200))
    step = F.percentile(F.col("step"), F.lit(0.5)).over(whole(DAY))
    idle = F.count_if(F.col("state") == "BASELINE").over(
        ordered(DAY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    missing = F.avg(v.isNull().cast("double")).over(_range(3600, 3600))
    marked = df.withColumn(
        "step", F.col("ts_s") - F.lag("ts_s").over(ordered(DAY))
    ).withColumn("high", high).withColumn("low", low)
    marked = marked.withColumn("idle", idle * step / 3600).withColumn("missing_near", missing).withColumn(
        "before", F.lag("state").over(ordered(DAY))
    )
    c = marked.where("state = 'BASELINE' and before = 'OPERATING'").select(
        *DAY,
        F.col("ts_s").alias("transition_s"),
        F.coalesce("low.ts_s", "ts_s").alias("crossing_s"),
        F.coalesce("high.ts_s", "ts_s").alias("origin_s"),
        F.col("low.v").alias("end_kw"),
        F.col("exit_kw").alias("threshold_kw"),
        F.coalesce(-F.col("high.v") - F.col("low.v"), F.lit(0.0)).alias("delta_kw"),
        ((F.coalesce("low.ts_s", "ts_s") - F.coalesce("high.ts_s", "ts_s")) / 3600).alias("duration_hours"),
        F.col("idle").alias("persistence_hours"),
        F.abs(F.coalesce(F.col("low.v") - F.col("exit_kw"), F.lit(0.0))).alias("baseline_sep"),
        (F.col("peak_kw") - F.col("baseline_kw")).alias("span"),
        "missing_near",
    )
    return _rates(c, df, value, "origin_s", "crossing_s")


def _rates(c: DataFrame, df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    c = c.withColumn(
        "avg_rate", F.when(F.col("duration_hours") > 0, F.col("delta_kw") / F.col("duration_hours")).otherwise(0.0)
    )
    return c.join(points(df, value), DAY, "left").withColumn(
        "max_rate", F.coalesce(_max_rate(F.col("pts"), F.col(a), F.col(b)), "avg_rate")
    ).drop("pts")


def best_event(candidates: DataFrame, cfg: dict, *, gradual_minutes: float = 60) -> DataFrame:
    """The candidate of the best score per day that passes the gates; the earliest of ties."""
    rate = cfg["min_ramp_rate_kw_per_hr"]
    part = lambda x, most: F.least(F.lit(1.0), x / F.greatest(most, F.lit(1e-6)))
    score = (
        cfg["weight_ramp_magnitude"] * part(F.col("delta_kw"), F.col("span"))
        + cfg["weight_ramp_rate"] * part(F.col("avg_rate"), F.lit(rate * 10.0))
        + cfg["weight_persistence"] * part(F.col("persistence_hours"), F.lit(4.0))
        + cfg["weight_baseline_sep"] * part(F.col("baseline_sep"), F.col("span"))
    )
    ok = (F.col("delta_kw") >= cfg["min_magnitude_kw"]) & (F.col("avg_rate") >= rate) & (
        F.col("persistence_hours") * 60 >= cfg["min_persistence_minutes"]
    )
    passed = candidates.where(ok).withColumn("score", score)
    order = F.row_number().over(Window.partitionBy(*DAY).orderBy(F.desc("score"), "transition_s", "crossing_s"))
    best = passed.withColumn("_n", order).where("_n = 1")
    kw = "start_kw" if "start_kw" in candidates.columns else "end_kw"
    confidence = F.col("score") * (1 - 0.5 * F.coalesce("missing_near", F.lit(0.0)))
    two, four = (lambda c: near(c, 2).alias(c)), (lambda c: near(c, 4).alias(c))
    return best.select(
        *DAY,
        "transition_s",
        "crossing_s",
        two(kw),
        two("threshold_kw"),
        two("delta_kw"),
        four("duration_hours"),
        near("avg_rate", 2).alias("ramp_rate_kw_per_hr"),
        near("max_rate", 2).alias("max_ramp_rate_kw_per_hr"),
        four("persistence_hours"),
        four("score"),
        near(confidence, 4).alias("confidence"),
        (F.col("duration_hours") > gradual_minutes / 60).alias("is_gradual"),
    )


def interval_ramps(df: DataFrame, *, value: str = "smooth_kw") -> DataFrame:
    w = ordered(DAY)
    hours = (F.col("ts_s") - F.lag("ts_s").over(w)) / 3600
    return df.withColumn("step_hours", hours).withColumn(
        "ramp_kw_per_hr", (F.col(value) - F.lag(value).over(w)) / F.col("step_hours")
    )


def ramp_groups(df: DataFrame, *, value: str = "smooth_kw", tolerance: float = 0.10) -> DataFrame:
    """Runs of one direction per day. A reversal smaller than ``tolerance`` of what was climbed so far is absorbed; a flat
    step ends a run. A run starts at the point before its first step, but for the day's first step."""
    r = interval_ramps(df, value=value).where("ramp_kw_per_hr is not null")
    item = F.struct(
        "ts_s", F.col(value).alias("v"), F.col("ramp_kw_per_hr").alias("ramp"), F.col("step_hours").alias("h")
    )
    days = r.groupBy(*DAY).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    ev = "array<struct<start_s:bigint,start_kw:double,end_s:bigint,end_kw:double>>"
    zero = F.struct(
        F.array().cast(ev).alias("out"),
        F.lit(False).alias("open"),
        F.lit(None).cast("bigint").alias("start_s"),
        F.lit(None).cast("double").alias("start_kw"),
        F.lit(0.0).alias("dir"),
        F.lit(0.0).alias("cum"),
        F.lit(None).cast("bigint").alias("last_s"),
        F.lit(None).cast("double").alias("last_kw"),
    )
    closed = lambda a: F.when(
        a["open"],
        F.concat(
            a["out"],
            F.array(
                F.struct(
                    a["start_s"].alias("start_s"),
                    a["start_kw"].alias("start_kw"),
                    a["last_s"].alias("end_s"),
                    a["last_kw"].alias("end_kw"),
                )
            ),
        ),
    ).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        sign = F.signum(x["ramp"])
        same = sign == a["dir"]
        goes_on = a["open"] & (
            same | ((sign != 0) & (a["cum"] != 0) & (F.abs(x["ramp"]) < tolerance * F.abs(a["cum"])))
        )
        climbed = x["ramp"] * x["h"]
        return F.struct(
            F.when(goes_on, a["out"]).otherwise(closed(a)).alias("out"),
            (goes_on | (sign != 0)).alias("open"),
            F.when(goes_on, a["start_s"]).otherwise(F.coalesce(a["last_s"], x["ts_s"])).alias("start_s"),
            F.when(goes_on, a["start_kw"]).otherwise(F.coalesce(a["last_kw"], x["v"])).alias("start_kw"),
            F.when(goes_on, a["dir"]).otherwise(sign).alias("dir"),
            F.when(goes_on, a["cum"] + F.when(same, climbed).otherwise(0.0)).otherwise(climbed).alias("cum"),
            x["ts_s"].alias("last_s"),
            x["v"].alias("last_kw"),
        )

    runs = F.aggregate("xs", zero, step, closed)
    return days.select(
        *DAY, F.explode(F.filter(runs, lambda e: e["start_s"] != e["end_s"])).alias("e")
    ).select(*DAY, "e.*")


def ramp_events(df: DataFrame, *, value: str = "smooth_kw", cfg: dict) -> DataFrame:
    """Ramp groups that pass the gates and keep their distance from the last one that did."""
    g = ramp_groups(df, value=value, tolerance=cfg["reversal_tolerance_fraction"])
    minutes = (F.col("end_s") - F.col("start_s")) / 60
    delta = F.abs(F.col("end_kw") - F.col("start_kw"))
    ok = (delta >= cfg["min_magnitude_kw"]) & (
        delta / (minutes / 60) >= cfg["min_rate_kw_per_hr"]
    ) & (minutes >= cfg["min_duration_minutes"])
    item = F.struct("start_s", "end_s", "start_kw", "end_kw")
    days = g.where(ok).groupBy(*DAY).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    zero = F.struct(F.slice("xs", 1, 0).alias("out"), F.lit(None).cast("bigint").alias("last"))

    def step(a: Column, x: Column) -> Column:
        far = a["last"].isNull() | ((x["start_s"] - a["last"]) / 60 >= cfg["min_separation_minutes"])
        return F.struct(
            F.when(far, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"),
            F.when(far, x["end_s"]).otherwise(a["last"]).alias("last"),
        )

    kept = days.select(
        *DAY, F.explode(F.aggregate("xs", zero, step, lambda a: a["out"])).alias("e")
    ).select(*DAY, "e.*")
    states = F.array_sort(F.collect_list(F.struct("ts_s", F.col(value).alias("v"), "ramp_kw_per_hr", "state")))
    day = interval_ramps(df, value=value).groupBy(*DAY).agg(
        states.alias("rows"), F.first("operating_range_kw").alias("span")
    )
    inside = F.filter("rows", lambda p: (p["ts_s"] >= F.col("start_s")) & (p["ts_s"] <= F.col("end_s")))
    got = kept.join(day, DAY).withColumn("inside", inside).withColumn(
        "hours", (F.col("end_s") - F.col("start_s")) / 3600
    ).withColumn("delta", delta)
    rate = F.col("delta") / F.col("hours")
    span = F.greatest(F.col("span"), F.lit(1e-6))
    return got.select(
        *DAY,
        F.when(F.col("end_kw") > F.col("start_kw"), "UP").otherwise("DOWN").alias("event_type"),
        "start_s",
        "end_s",
        near("start_kw", 2).alias("start_kw"),
        near("end_kw", 2).alias("end_kw"),
        near("delta", 2).alias("delta_kw"),
        near("hours", 4).alias("duration_hours"),
        near(rate, 2).alias("average_ramp_kw_per_hr"),
        near(F.array_max(F.transform("inside", lambda p: F.abs(p["ramp_kw_per_hr"]))), 2).alias("max_ramp_kw_per_hr"),
        F.when(F.col("start_kw") != 0, near(F.col("delta") / F.abs("start_kw") * 100, 2)).alias("percent_change"),
        near(F.col("delta") / span / F.col("hours"), 4).alias("normalized_ramp_rate"),
        near(F.least(F.lit(1.0), F.col("delta") / span * 0.5 + F.least(rate / 100, F.lit(0.5))), 4).alias("confidence"),
        (
            F.exists("inside", lambda p: p["state"] == "OPERATING")
            & F.exists("inside", lambda p: p["state"] == "BASELINE")
        ).alias("is_operating_transition"),
    )


def local_maxima(df: DataFrame, *, value: str = "demand_kw", tolerance: float = 0.01) -> DataFrame:
    """Per day pts and peaks: plateaus (within ``tolerance`` of their first value) no neighbour of which is higher, each
    by its middle point."""
    days = points(df, value)
    zero = F.struct(
        F.array().cast("array<struct<a:int,b:int,kw:double>>").alias("out"),
        F.lit(0).alias("i"),
        F.lit(0).alias("a"),
        F.lit(None).cast("double").alias("kw"),
    )
    closed = lambda s: F.when(
        s["kw"].isNotNull(),
        F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), (s["i"] - 1).alias("b"), s["kw"].alias("kw")))),
    ).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        flat = s["kw"].isNotNull() & (F.abs(p["v"] - s["kw"]) / F.greatest(s["kw"], F.lit(1e-6)) <= tolerance)
        return F.struct(
            F.when(flat, s["out"]).otherwise(closed(s)).alias("out"),
            (s["i"] + 1).alias("i"),
            F.when(flat, s["a"]).otherwise(s["i"]).alias("a"),
            F.when(flat, s["kw"]).otherwise(p["v"]).alias("kw"),
        )

    days = days.withColumn("flats", F.aggregate("pts", zero, step, closed))
    at = lambda i: F.get("pts", i)
    tops = F.filter(
        "flats",
        lambda f: ~F.coalesce(
            (f["a"] > 0) & (at(f["a"] - 1)["v"] > f["kw"]), F.lit(False)
        ) & ~F.coalesce(at(f["b"] + 1)["v"] > f["kw"], F.lit(False)),
    )
    return days.withColumn(
        "peaks", F.transform(tops, lambda f: at(f["a"] + F.floor((f["b"] - f["a"] + 1) / 2).cast("int")))
    ).drop("flats")


def prominence(maxima: DataFrame) -> DataFrame:
    """A row for each peak: ts_s, kw, prominence (above the higher of the valleys towards the nearest higher peaks)."""
    lowest = lambda a, b: F.array_min(
        F.transform(F.filter("pts", lambda p: (p["ts_s"] >= a) & (p["ts_s"] <= b)), lambda p: p["v"])
    )
    p = maxima.select(*DAY, "pts", "peaks", F.explode("peaks").alias("p"))
    higher = F.filter("peaks", lambda q: q["v"] > F.col("p.v"))
    left = F.array_max(F.transform(F.filter(higher, lambda q: q["ts_s"] < F.col("p.ts_s")), lambda q: q["ts_s"]))
    right = F.array_min(F.transform(F.filter(higher, lambda q: q["ts_s"] > F.col("p.ts_s")), lambda q: q["ts_s"]))
    p = p.withColumn("l", left).withColumn("r", right)
    valley = F.greatest(
        F.when(F.col("l").isNotNull(), lowest(F.col("l"), F.col("p.ts_s"))),
        F.when(F.col("r").isNotNull(), lowest(F.col("p.ts_s"), F.col("r"))),
    )
    floor = F.coalesce(valley, F.array_min(F.transform("pts", lambda x: x["v"])))
    return p.select(
        *DAY, F.col("p.ts_s").alias("ts_s"), F.col("p.v").alias("kw"), (F.col("p.v") - floor).alias("prominence_kw")
    )


def separated(peaks: DataFrame, *, min_minutes: float = 30) -> DataFrame:
    """From the highest down, peaks at least ``min_minutes`` from all that were kept."""
    days = peaks.groupBy(*DAY).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("kw")).alias("k"), "ts_s", "prominence_kw"))).alias("xs")
    )
    near = lambda a, x: F.exists(a, lambda k: F.abs(k["ts_s"] - x["ts_s"]) / 60 < min_minutes)
    kept = F.aggregate("xs", F.slice("xs", 1, 0), lambda a, x: F.when(near(a, x), a).otherwise(F.concat(a, F.array(x))))
    return days.select(*DAY, F.explode(kept).alias("e")).select(
        *DAY, "e.ts_s", (-F.col("e.k")).alias("kw"), "e.prominence_kw"
    )


def peak_events(
    df: DataFrame, *, value: str = "demand_kw", cfg: dict, widths: tuple[float, ...] = (0.7, 0.8, 0.9)
) -> DataFrame:
    """Ranked peaks of days with a range, with widths (hours) of the stretch around them at or above each share of it."""
    maxima = local_maxima(df, value=value, tolerance=cfg["plateau_tolerance_fraction"])
    # Widths go by the operating range, whatever peak the normalised demand takes.
    share = (F.col(value) - F.col("baseline_kw")) / F.col("operating_range_kw")
    filled = F.col("is_interpolated") if "is_interpolated" in df.columns else F.lit(False)
    point = F.struct("ts_s", F.coalesce(share, F.lit(-1.0)).alias("n"), filled.alias("filled"))
    day = df.where("operating_range_kw > 0").groupBy(*DAY).agg(
        F.first("operating_range_kw").alias("span"), F.array_sort(F.collect_list(point)).alias("norm")
    )
    tall = prominence(maxima).join(day.select(*DAY, "span"), DAY).where(
        F.col("prominence_kw") >= cfg["min_prominence_fraction"] * F.col("span")
    ).drop("span")
    kept = separated(tall, min_minutes=cfg["min_separation_minutes"]).join(day, DAY)
    rank = F.row_number().over(Window.partitionBy(*DAY).orderBy(F.desc("kw"), "ts_s"))
    first = F.first("ts_s").over(Window.partitionBy(*DAY).orderBy(F.desc("kw"), "ts_s"))

    def width(share: float) -> Column:
        own = F.get(F.filter("norm", lambda p: p["ts_s"] == F.col("ts_s")), F.lit(0))["n"]
        low = lambda side: F.transform(
            F.filter("norm", lambda p: (p["n"] < share) & side(p["ts_s"], F.col("ts_s"))), lambda p: p["ts_s"]
        )
        after = F.array_max(low(lambda a, b: a < b))
        before = F.array_min(low(lambda a, b: a > b))
        span = F.transform(
            F.filter(
                "norm",
                lambda p: (
                    p["ts_s"] > F.coalesce(after, F.lit(-(1 << 60)))
                ) & (p["ts_s"] < F.coalesce(before, F.lit(1 << 60))),
            ),
            lambda p: p["ts_s"],
        )
        return near(
            F.when(own >= share, (F.array_max(span) - F.array_min(span)) / 3600).otherwise(0.0), 4
        ).alias(f"width_{int(share * 100)}_hours")

    got = kept.withColumn("rank", rank).withColumn("first_s", first)
    return got.select(
        *DAY,
        "rank",
        F.col("ts_s").alias("peak_s"),
        near("kw", 2).alias("peak_kw"),
        F.exists("norm", lambda p: (p["ts_s"] == F.col("ts_s")) & p["filled"]).alias("peak_is_interpolated"),
        near("prominence_kw", 2).alias("prominence_kw"),
        near(F.col("prominence_kw") / F.greatest("span", F.lit(1e-6)), 4).alias("prominence_fraction"),
        near(F.abs(F.col("ts_s") - F.col("first_s")) / 3600, 4).alias("separation_hours"),
        *[width(w) for w in widths],
        near(F.least(F.lit(1.0), 2 * F.col("prominence_kw") / F.greatest("span", F.lit(1e-6))), 4).alias("confidence"),
    )


def local_extrema(df: DataFrame, *, key: str = "meter_id", value: str = "demand_kw") -> DataFrame:
    """Strict maxima and minima of three points; days do not matter."""
    w = Window.partitionBy(key).orderBy("ts_s")
    v, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn("is_local_peak", F.coalesce((v > a) & (v > b), F.lit(False))).withColumn(
        "is_local_valley", F.coalesce((v < a) & (v < b), F.lit(False))
    )


def der_peak_events(
    df: DataFrame, criterion: Column, *, definition: str, key: str = "meter_id", value: str = "demand_kw", gap: int = 0,
    sustained_hours: float = 1.0,
) -> DataFrame:
    """Events of any criterion; up to ``gap`` intervals that do not qualify are bridged."""
    w = Window.partitionBy(key).orderBy("ts_s")
    at = df.withColumn("pos", F.row_number().over(w)).withColumn("ok", F.coalesce(criterion, F.lit(False)))
    hits = at.where("ok").withColumn(
        "new", F.coalesce(F.col("pos") - F.lag("pos").over(w) - 1 > gap, F.lit(True)).cast("int")
    ).withColumn("seq", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Bridged intervals belong to the event of the last hit before them, up to its last hit.
    marks = at.join(hits.select(key, "pos", "seq"), [key, "pos"], "left").withColumn(
        "seq", F.last("seq", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    last = F.max(F.when(F.col("ok"), F.col("pos"))).over(Window.partitionBy(key, "seq"))
    inside = marks.where("seq is not null").withColumn("last", last).where("pos <= last")
    got = inside.groupBy(key, "seq").agg(
        F.min("ts_s").alias("start_s"),
        F.max("ts_s").alias("end_s"),
        F.max(value).alias("max_demand_kw"),
        F.avg(value).alias("mean_demand_kw"),
        F.min(value).alias("min_demand_kw"),
        F.count("*").alias("n_intervals"),
    )
    hours = (F.col("end_s") - F.col("start_s")) / 3600
    return got.select(
        F.format_string("%s_%s_%04d", F.col(key), F.lit(definition), F.col("seq")).alias("event_id"),
        F.col(key).alias("entity_id"),
        F.lit(definition).alias("peak_definition"),
        "start_s",
        "end_s",
        hours.alias("duration_hours"),
        "max_demand_kw",
        "mean_demand_kw",
        "min_demand_kw",
        "n_intervals",
        F.when(hours >= sustained_hours, "sustained").otherwise("short").alias("duration_class"),
    )
