"""Written intermediate tables, from which several others start."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a folder of this machine, but only if driver and executors
    are one process; on a cluster without a shared folder this raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/") if found else _fallback.setdefault(
        spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="gridloom-")
    )


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, read by column, short in lineage, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
