"""Window pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = ["meter_id", "local_date"]


def ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts_s")


def whole(keys: list[str]):
    return Window.partitionBy(*keys)


def so_far(keys: list[str]):
    return ordered(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def label_runs(df: DataFrame, value: Column, keys: list[str], name: str = "run") -> DataFrame:
    """Numbers the maximal runs of equal ``value`` (null is a value)."""
    changed = (~value.eqNullSafe(F.lag(value).over(ordered(keys)))) | (F.row_number().over(ordered(keys)) == 1)
    return df.withColumn("_changed", changed.cast("int")).withColumn(
        name, F.sum("_changed").over(so_far(keys))
    ).drop("_changed")


def run_bounds(df: DataFrame, keys: list[str], run: str = "run", *values: str) -> DataFrame:
    """A row for each run: start_s, last_s, end_s (the first time after it, else its last) and the values of its rows."""
    after = df.withColumn("_next", F.lead("ts_s").over(ordered(keys)))
    got = after.groupBy(*keys, run).agg(
        F.min("ts_s").alias("start_s"),
        F.max("ts_s").alias("last_s"),
        F.max(F.struct("ts_s", "_next"))["_next"].alias("_end"),
        *[F.first(v).alias(v) for v in values],
    )
    return got.withColumn("end_s", F.coalesce("_end", "last_s")).drop("_end")


def first_max(value: str) -> Column:
    """Time of the first greatest value."""
    return F.min_by("ts_s", F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col("ts_s"))))


def local(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Adds local_date, hour and minute_of_day of the instant in ``tz`` (the session is in UTC)."""
    t = F.from_utc_timestamp(F.timestamp_seconds("ts_s"), tz)
    return df.withColumn("local_date", F.to_date(t)).withColumn("hour", F.hour(t)).withColumn(
        "minute_of_day", F.hour(t) * 60 + F.minute(t)
    )


def iso_text(seconds: Column, tz: str = "UTC") -> Column:
    """ISO 8601 text of an instant in ``tz``, with its offset."""
    wall = F.from_utc_timestamp(F.timestamp_seconds(seconds), tz)
    ahead = ((F.unix_timestamp(wall) - seconds) / 60).cast("int")
    offset = F.concat(
        F.when(ahead < 0, "-").otherwise("+"),
        F.lpad(F.floor(F.abs(ahead) / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.abs(ahead) % 60).cast("string"), 2, "0"),
    )
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def near(c: Column | str, digits: int) -> Column:
    """Rounded, halves up; a hair more, as binary fractions that just miss a half would go either way."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, digits)
