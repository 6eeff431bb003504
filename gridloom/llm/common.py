"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Fixed value: ASCII white space that separates words.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of (long, long) up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Keys with more than this share of all rows are dealt to several tasks.
HOT_KEYS = 500

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary folder, but only if driver and executors are
    one process; on a cluster without a shared folder this raises."""
    conf = spark.sparkContext.getConf()
    if set_by_cluster := conf.get("spark.checkpoint.dir", None):
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _fallback.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="gridloom-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def materialize_with(df: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, dict[str, Any]]:
    """As materialize, with aggregates of the rows, which the job that writes them gathers on its way."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in totals.items()]), name)
    return out, dict.fromkeys(totals) | seen.get


def drop(df: DataFrame) -> None:
    """Delete a table of materialize that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int) -> DataFrame:
    """Join; ``right`` (narrow rows of numbers, ``rows`` of them at most, counted before) is broadcast while it is small.
    Beyond that both sides are shuffled; if ``right`` is a written table, Spark splits hot keys of ``left`` as it runs."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("merge"), on, how)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, by: str) -> DataFrame:
    """Inner join with ``right``, which has one row for each key and in ``count`` the number of rows of ``left`` with it,
    of ``total`` or fewer. Keys with more than a HOT_KEYS-th of all rows (fewer than HOT_KEYS, so that they may be
    broadcast) are cut into parts by the hash of ``by``, so that no task gets all rows of such a key."""
    parts = F.ceil(F.col(count) / max(1, total // HOT_KEYS)).cast("int")
    counted = right.withColumn("_parts", parts)
    hot = counted.where("_parts > 1").select(*on, "_parts")
    salt = F.coalesce(F.pmod(F.xxhash64(by), "_parts").cast("int"), F.lit(0))
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_parts")
    dealt = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", count)
    return salted.join(dealt, [*on, "_salt"]).drop("_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
