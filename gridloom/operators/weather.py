"""As-of temperature joins, merge policies, and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper limits of the bands, degrees Fahrenheit.
BANDS = (32, 50, 65, 80, 90)


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: tuple[str, ...] = (),
    block_seconds: int = 86_400 * 7,
    tolerance_seconds: int | None = None,
) -> DataFrame:
    """The nearest right row by ts_s, within the tolerance if there is one, the earlier of ties; its temperature_f may be
    null.

    Both sides are swept in blocks of time. What a block needs from outside is the last right row before it and the
    first after it; these are carried over the blocks, of which there are few, and not over the rows.
    """
    block = lambda c: F.floor(c / block_seconds)
    a = left.select(
        *keys,
        "ts_s",
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"),
        block(F.col("ts_s")).alias("_block"),
    )
    r = right.select(
        *keys,
        "ts_s",
        F.struct(F.col("ts_s").alias("t"), F.col("temperature_f").alias("f")).alias("_hit"),
        block(F.col("ts_s")).alias("_block"),
    )
    at = [*keys, "_block"]
    ends = a.select(*at).distinct().join(
        r.groupBy(*at).agg(F.min("_hit").alias("_low"), F.max("_hit").alias("_high")), at, "full"
    )
    order = Window.partitionBy(*keys).orderBy("_block")
    back = F.last("_high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.last("_low", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(*at, back.alias("_back"), ahead.alias("_ahead"))
    both = a.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*at).orderBy("ts_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    f = Window.partitionBy(*at).orderBy(F.desc("ts_s")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Max of the struct's time is the last hit at or before; min of the reverse sweep the first at or after.
    got = both.withColumn(
        "b", F.max("_hit").over(w)
    ).withColumn("n", F.min("_hit").over(f)).where("_row is not null").join(carried, at, "left")
    got = got.withColumn("b", F.coalesce("b", "_back")).withColumn("n", F.coalesce("n", "_ahead"))
    db, dn = F.col("ts_s") - F.col("b.t"), F.col("n.t") - F.col("ts_s")
    earlier = db.isNotNull() & (dn.isNull() | (db <= dn))
    near = lambda d: F.lit(True) if tolerance_seconds is None else d <= tolerance_seconds
    hit = F.when(earlier & near(db), F.col("b.f")).when(~earlier & near(dn), F.col("n.f"))
    return got.select("_row.*", hit.alias("external_temperature_f"))


def temp_policy(df: DataFrame, *, override: bool = False) -> DataFrame:
    own = F.col("temperature_f") if "temperature_f" in df.columns else F.lit(None).cast("double")
    pair = (F.col("external_temperature_f"), own) if override else (own, F.col("external_temperature_f"))
    return df.withColumn("temperature_f", F.coalesce(*pair)).drop("external_temperature_f")


def band(t: Column, limits: tuple[float, ...] = BANDS) -> Column:
    """Right-closed bands; null stays null."""
    out = F.when(t <= limits[0], f"below-{limits[0]}")
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        out = out.when(t <= b, f"{a}-{b}")
    return out.when(t > limits[-1], f"{limits[-1]}-above")
