"""Change-point regression of demand on temperature, by moments: no point meets every breakpoint pair.

Excesses h = max(bp - x, 0) and c = max(x - bp, 0) of breakpoints h_bp <= c_bp never overlap, so that the sum of h*c is 0
and the moments of each side depend on its own breakpoint only. Fits with slopes of at least 0 try the four sets of
slopes that may be positive and keep the feasible one of least error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.sources.tables import stage

PARAMS = {"2P": 2, "3P_cooling": 3, "3P_heating": 3, "4P": 4, "5P": 5}


def clean(df: DataFrame) -> DataFrame:
    """entity_id, x, y with both finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.select(
        "entity_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    ).where(ok("x") & ok("y"))


def totals(p: DataFrame) -> DataFrame:
    return p.groupBy("entity_id").agg(
        F.count("*").alias("n"),
        F.sum("y").alias("sy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
    )


def breakpoints(p: DataFrame) -> DataFrame:
    """entity_id, bp: whole degrees strictly inside the range."""
    t = totals(p).select("entity_id", (F.floor("x0") + 1).alias("a"), (F.ceil("x1") - 1).alias("b")).where("a <= b")
    return t.select(
        "entity_id", F.explode(F.sequence("a", "b")).alias("bp")
    ).withColumn("bp", F.col("bp").cast("double"))


def _sse(syy: Column, sy: Column, n: Column) -> Column:
    return syy - sy * sy / n


def moments(p: DataFrame) -> DataFrame:
    """Per breakpoint: sums of the excesses below and above, their squares and products with y.

    Points are summed by whole degree first (a point between two breakpoints is on the same side of both); each
    breakpoint then meets degrees, of which there are as few as breakpoints, and no points.
    """
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.count("*"), "x": F.sum("x"), "xx": F.sum(x * x), "y": F.sum("y"), "xy": F.sum(x * y)}
    degrees = p.groupBy(
        "entity_id", F.floor("x").cast("double").alias("deg")
    ).agg(*[v.alias(f"s_{k}") for k, v in sums.items()])
    j = breakpoints(p).join(degrees, "entity_id")
    bp, n, sx, sxx, sy, sxy = (F.col(c) for c in ("bp", "s_n", "s_x", "s_xx", "s_y", "s_xy"))
    below = F.col("deg") < bp
    # Of points below: bp - x; above: x - bp. A point at bp itself adds nothing on either side.
    gap, square, product = n * bp - sx, n * bp * bp - 2 * bp * sx + sxx, bp * sy - sxy
    side = lambda is_side, v: F.sum(F.when(is_side, v).otherwise(0.0))
    return j.groupBy("entity_id", "bp").agg(
        side(below, gap).alias("h"),
        side(below, square).alias("hh"),
        side(below, product).alias("hy"),
        side(~below, -gap).alias("c"),
        side(~below, square).alias("cc"),
        side(~below, -product).alias("cy"),
    )


def with_totals(p: DataFrame) -> DataFrame:
    return moments(p).join(totals(p), "entity_id")


def fit_2p(p: DataFrame) -> DataFrame:
    """A line; of constant x the one whose intercept and slope have the least squares."""
    fits = [
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.avg("y").alias("my"),
        F.avg("x").alias("mx"),
    ]
    got = p.groupBy("entity_id").agg(F.count("*").alias("n_points"), *fits).where("n_points >= 4")
    flat = F.col("my") / (1 + F.col("mx") * F.col("mx"))
    params = {"base": F.coalesce("intercept", flat), "slope": F.coalesce("slope", flat * F.col("mx"))}
    return _model(
        got,
        "2P",
        F.when(F.col("slope").isNull(), 0.0).otherwise(F.coalesce("r2", F.lit(0.0))),
        params,
        F.array().cast("array<double>"),
    )


def fit_3p(p: DataFrame, side: str, m: DataFrame | None = None) -> DataFrame:
    """One free slope beyond a breakpoint; side is cooling or heating."""
    k = "c" if side == "cooling" else "h"
    m = (with_totals(p) if m is None else m).where("n >= 5")
    s, ss, sy = F.col(k), F.col(k + k), F.col(k + "y")
    d = ss - s * s / F.col("n")
    slope = F.when(d > 1e-9, (sy - s * F.col("sy") / F.col("n")) / d).otherwise(0.0)
    sst = _sse(F.col("syy"), F.col("sy"), F.col("n"))
    m = m.withColumn("slope", slope).withColumn("sst", sst).withColumn(
        "sse", sst - slope * (sy - s * F.col("sy") / F.col("n"))
    ).withColumn("base", (F.col("sy") - slope * s) / F.col("n"))
    best = _least(m, [F.col("bp")])
    return _model(
        best.withColumn("n_points", F.col("n")),
        f"3P_{side}",
        _r2(),
        {"baseline": F.col("base"), f"{side}_slope": F.col("slope")},
        F.array("bp"),
    )


def _least(m: DataFrame, ties: list[Column]) -> DataFrame:
    return m.withColumn(
        "_n",
        F.row_number().over(
            Window.partitionBy("entity_id").orderBy(
                F.round(F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0)), 9), *ties
            )
        ),
    ).where("_n = 1").drop("_n")


def _r2() -> Column:
    return F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0)


def _two_slopes(m: DataFrame) -> DataFrame:
    """Adds sh, sc, base, sse, sst: slopes of at least 0 with a free base, by the four sets that may be positive."""
    n, y = F.col("n"), F.col("sy")
    hh, cc, hc = F.col(
        "hh"
    ) - F.col("h") * F.col("h") / n, F.col("cc") - F.col("c") * F.col("c") / n, -F.col("h") * F.col("c") / n
    hy, cy = F.col("hy") - F.col("h") * y / n, F.col("cy") - F.col("c") * y / n
    sst = _sse(F.col("syy"), y, n)
    det = hh * cc - hc * hc
    m = m.withColumns({"_hh": hh, "_cc": cc, "_hc": hc, "_hy": hy, "_cy": cy, "sst": sst, "_det": det})
    bh = F.when(F.col("_det") > 1e-9, (F.col("_cc") * F.col("_hy") - F.col("_hc") * F.col("_cy")) / F.col("_det"))
    bc = F.when(F.col("_det") > 1e-9, (F.col("_hh") * F.col("_cy") - F.col("_hc") * F.col("_hy")) / F.col("_det"))
    err = lambda a, b: F.col("sst") - 2 * (
        a * F.col("_hy") + b * F.col("_cy")
    ) + a * a * F.col("_hh") + 2 * a * b * F.col("_hc") + b * b * F.col("_cc")
    option = lambda a, b: F.when((a >= 0) & (b >= 0), F.struct(err(a, b).alias("sse"), a.alias("sh"), b.alias("sc")))
    zero = F.lit(0.0)
    one_h = F.when(F.col("_hh") > 1e-9, F.col("_hy") / F.col("_hh"))
    one_c = F.when(F.col("_cc") > 1e-9, F.col("_cy") / F.col("_cc"))
    m = m.withColumn(
        "_best",
        F.array_min(
            F.filter(
                F.array(option(bh, bc), option(one_h, zero), option(zero, one_c), option(zero, zero)),
                lambda o: o.isNotNull(),
            )
        ),
    )
    m = m.withColumns({"sse": F.col("_best.sse"), "sh": F.col("_best.sh"), "sc": F.col("_best.sc")})
    return m.withColumn("base", (y - F.col("sh") * F.col("h") - F.col("sc") * F.col("c")) / n)


def fit_4p(p: DataFrame, m: DataFrame | None = None) -> DataFrame:
    m = _two_slopes((with_totals(p) if m is None else m).where("h > 0 and c > 0 and n >= 8"))
    best = _least(m, [F.col("bp")])
    return _model(
        best.withColumn("n_points", F.col("n")),
        "4P",
        _r2(),
        {"baseline": F.col("base"), "heating_slope": F.col("sh"), "cooling_slope": F.col("sc")},
        F.array("bp"),
    )


def fit_5p(p: DataFrame, m: DataFrame | None = None) -> DataFrame:
    """Pairs of breakpoints are pairs of two rows of moments, a table of whole degrees, not of points."""
    m = with_totals(p) if m is None else m
    low = m.where("h > 0 and n >= 10").select("entity_id", F.col("bp").alias("h_bp"), "h", "hh", "hy")
    high = m.where("c > 0 and n >= 10").select(
        "entity_id", F.col("bp").alias("c_bp"), "c", "cc", "cy", "n", "sy", "syy"
    )
    pairs = low.join(high, "entity_id").where("h_bp <= c_bp")
    many = pairs.withColumn("_pairs", F.count("*").over(Window.partitionBy("entity_id"))).where("_pairs >= 2")
    best = _least(_two_slopes(many), [F.col("h_bp"), F.col("c_bp")])
    return _model(
        best.withColumn("n_points", F.col("n")),
        "5P",
        _r2(),
        {"baseline": F.col("base"), "heating_slope": F.col("sh"), "cooling_slope": F.col("sc")},
        F.array("h_bp", "c_bp"),
    )


def _model(df: DataFrame, kind: str, r2: Column, params: dict[str, Column], bps: Column) -> DataFrame:
    p = F.lit(PARAMS[kind])
    free = F.col("n_points") - p - 1
    adjusted = F.when(free > 0, 1 - (1 - r2) * (F.col("n_points") - 1) / free)
    return df.select(
        "entity_id",
        F.lit(kind).alias("model_type"),
        F.lit(True).alias("success"),
        r2.alias("r_squared"),
        adjusted.alias("adjusted_r_squared"),
        F.col("n_points").alias("n_points"),
        F.create_map(*[x for k, v in params.items() for x in (F.lit(k), v.cast("double"))]).alias("params"),
        bps.alias("breakpoints"),
    )


def select_model(p: DataFrame) -> DataFrame:
    """The model of the best adjusted R-squared; of ties the one of fewer parameters, then as listed. The points and their
    moments are written once, since five fits read them."""
    p = stage(p, "points")
    m = stage(with_totals(p), "moments")
    fits = [fit_2p(p), fit_3p(p, "cooling", m), fit_3p(p, "heating", m), fit_4p(p, m), fit_5p(p, m)]
    every = fits[0]
    for f in fits[1:]:
        every = every.unionByName(f)
    place = F.create_map(*[x for i, k in enumerate(PARAMS) for x in (F.lit(k), F.lit(i))])
    order = Window.partitionBy("entity_id").orderBy(F.round("adjusted_r_squared", 9).desc(), place[F.col("model_type")])
    return every.where(
        "adjusted_r_squared is not null"
    ).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
