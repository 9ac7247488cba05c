"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def fresh_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a temporary one only where that is unset and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lattica-"))
        folder = f"file://{_OWN[0]}"
    return f"{folder.rstrip('/')}/lattica-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared folder and reading back."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
