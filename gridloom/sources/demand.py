"""Readers and writers of demand and temperature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.sources.config import meters

#: Text times that end like this carry their offset.
OFFSET = r"([Zz]|[+-]\d{2}:?\d{2})$"


def scan_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text, with ingest_seq, the order of the rows within each file, and source_path."""
    df = spark.read.option("header", True).csv(paths)
    return df.withColumns({"ingest_seq": F.monotonically_increasing_id(), "source_path": F.col("_metadata.file_path")})


def load_demand(spark: SparkSession, source: str | DataFrame, cfg: dict) -> DataFrame:
    """Demand of a CSV file or a DataFrame by the settings of [input] and [timezone]. A DataFrame may bring its own order
    of rows in ingest_seq; without one, its rows are taken as they come."""
    df = scan_csv(spark, source) if isinstance(source, str) else source
    if "ingest_seq" not in df.columns:
        df = df.withColumn("ingest_seq", F.monotonically_increasing_id())
    i = cfg["input"]
    return project_demand(
        df,
        ts=i["datetime_col"],
        demand=i["demand_col"],
        meter=i["meter_id_col"],
        building=i["building_id_col"],
        tz=cfg["timezone"]["default_tz"],
        seq="ingest_seq",
    )


def load_meters(spark: SparkSession, cfg: dict) -> DataFrame:
    """Demand of all configured meters. All CSV files are one scan, told apart by their paths; DataFrames are added."""
    specs = meters(cfg)
    files = [m for m in specs if isinstance(m.source, str)]
    parts = []
    if files:
        table = spark.createDataFrame(
            [(m.meter_id, m.building_id, m.source.rstrip("/")) for m in files],
            "_meter string, _building string, _path string",
        )
        rows = scan_csv(spark, sorted({m.source for m in files}))
        # The table has a row for each configured meter, which the driver holds anyway.
        named = rows.join(F.broadcast(table), F.contains(F.col("source_path"), F.col("_path")))
        parts.append(named.withColumns({"_meter_id": F.col("_meter"), "_building_id": F.col("_building")}))
    for m in specs:
        if isinstance(m.source, DataFrame):
            seq = {} if "ingest_seq" in m.source.columns else {"ingest_seq": F.monotonically_increasing_id()}
            parts.append(
                m.source.withColumns(
                    {"_meter_id": F.lit(m.meter_id), "_building_id": F.lit(m.building_id).cast("string")} | seq
                )
            )
    if not parts:
        return spark.createDataFrame(
            [],
            "meter_id string, building_id string, ts_s long, demand_kw double, demand_kw_raw double, ingest_seq long",
        )
    i, tz = cfg["input"], cfg["timezone"]["default_tz"]
    return reduce(
        DataFrame.unionByName,
        [
            project_demand(
                p, ts=i["datetime_col"], demand=i["demand_col"], meter="_meter_id", building="_building_id", tz=tz,
                seq="ingest_seq",
            )
            for p in parts
        ],
    )


def load_temperature(spark: SparkSession, source: str | DataFrame, cfg: dict) -> DataFrame:
    """ts_s, temperature_f by the column names of [der.temperature.column_mapping]."""
    df = scan_csv(spark, source) if isinstance(source, str) else source
    names = cfg["der"]["temperature"]["column_mapping"]
    if missing := [c for c in (names["timestamp"], names["temperature_f"]) if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    value = F.col(f"`{names['temperature_f']}`").cast("double")
    return df.select(
        instant(df, names["timestamp"], cfg["timezone"]["default_tz"]).alias("ts_s"),
        F.when(~F.isnan(value), value).alias("temperature_f"),
    )


def project_demand(
    df: DataFrame, *, ts: str, demand: str, meter: str = "", building: str = "", tz: str = "UTC", seq: str | None = None
) -> DataFrame:
    """meter_id, building_id, ts_s (epoch seconds), demand_kw, demand_kw_raw; NaN becomes null here and nowhere else.
    ``seq``: a column with the order of the rows, kept as ingest_seq; with it the second pass through a repeated autumn
    hour is told from the first."""
    missing = [c for c in (ts, demand) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    value = F.col(f"`{demand}`").cast("double")
    value = F.when(~F.isnan(value), value)
    name = lambda c, default: F.col(f"`{c}`") if c and c in df.columns else F.lit(default)
    columns = [
        name(meter, "meter").alias("meter_id"),
        name(building, None).cast("string").alias("building_id"),
        instant(df, ts, tz).alias("ts_s"),
        value.alias("demand_kw"),
        value.alias("demand_kw_raw"),
    ]
    if not seq:
        return df.select(*columns)
    text = dict(df.dtypes)[ts] == "string"
    naive = ~F.rlike(F.col(ts), F.lit(OFFSET)) if text else F.lit(dict(df.dtypes)[ts] == "timestamp_ntz")
    got = df.select(*columns, F.col(seq).alias("ingest_seq"), naive.alias("_naive"))
    return order_repeated_hour(got, ["meter_id"], "ingest_seq", tz=tz, where=F.col("_naive")).drop("_naive")


def instant(df: DataFrame, c: str, tz: str) -> Column:
    """Epoch seconds. Times without an offset are local; those in a spring gap move to its end."""
    kind = dict(df.dtypes)[c]
    if kind == "timestamp":
        return F.unix_timestamp(F.col(c))
    if kind == "string":
        with_offset = F.rlike(F.col(c), F.lit(OFFSET))
        return F.when(with_offset, F.unix_timestamp(F.try_to_timestamp(F.col(c)))).otherwise(
            local_instant(F.try_to_timestamp(F.regexp_replace(c, OFFSET, "")), tz)
        )
    return local_instant(F.col(c).cast("timestamp"), tz)


def local_instant(wall: Column, tz: str) -> Column:
    """``wall`` holds a local wall-clock time (in a UTC session). A time that does not exist becomes the gap's end: the
    first instant whose local time is later than it."""
    utc = F.to_utc_timestamp(wall, tz)
    back = F.from_utc_timestamp(utc, tz)
    skipped = F.unix_timestamp(back) - F.unix_timestamp(wall)
    # After a skip, the local minutes past the gap are those by which the wall time overshot it.
    return F.unix_timestamp(utc) - F.when(skipped > 0, F.pmod(F.unix_timestamp(wall), F.lit(3600))).otherwise(F.lit(0))


def order_repeated_hour(df: DataFrame, keys: list[str], seq: str, *, tz: str, where: Column | None = None) -> DataFrame:
    """Second readings of a repeated autumn hour, told by their order, move on by an hour: those that come after a
    later time of the same day, or repeat a time, where the local time is one that occurs twice."""
    wall = lambda s: F.from_utc_timestamp(F.timestamp_seconds(s), tz)
    twice = (wall(F.col("ts_s")) == wall(F.col("ts_s") + 3600)) & (F.lit(True) if where is None else where)
    day = [*keys, "_day"]
    marked = df.withColumn("_twice", F.coalesce(twice, F.lit(False))).withColumn("_day", F.to_date(wall(F.col("ts_s"))))
    nth = F.row_number().over(Window.partitionBy(*day, "ts_s").orderBy(seq))
    later = F.max("ts_s").over(Window.partitionBy(*day).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    again = F.col("_twice") & (nth == 2) & (later >= F.col("ts_s"))
    return marked.withColumn(
        "ts_s", F.when(again, F.col("ts_s") + 3600).otherwise(F.col("ts_s"))
    ).drop("_twice", "_day")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as demand: a meter for each event type, summed by hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return events.groupBy(
        F.col("event_type").alias("meter_id"), hour.alias("ts_s")
    ).agg(F.round(F.sum("value"), 2).alias("demand_kw"))


def write_csv(df: DataFrame, path: str) -> str | None:
    """One directory of CSV with a header; nothing is written for an empty table."""
    if df.isEmpty():
        return None
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
