"""Tensors that grow: a stream of element updates is summed into a stored tensor.

A tensor of sums is additive: its state after any batch is the sum of all updates so far. Each
micro-batch is aggregated by coordinates and written as one increment named by its batch id, so that
a batch that is delivered twice replaces its own increment (exactly once). ``compacted`` folds the
increments into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.tensor import Tensor
from lattica.tiling import TiledRange


def accumulate(updates: DataFrame, rank: int, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """updates: a streaming DataFrame of i0.. and v."""
    keys = [f"i{k}" for k in range(rank)]

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum("v").alias("v")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = updates.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def accumulated(spark: SparkSession, path: str, trange: TiledRange) -> Tensor:
    """The tensor as of the increments that are there."""
    keys = [f"i{k}" for k in range(trange.rank)]
    return Tensor(spark.read.parquet(path).groupBy(*keys).agg(F.sum("v").alias("v")), trange)


def compacted(spark: SparkSession, path: str, to: str, trange: TiledRange) -> Tensor:
    """One increment in the place of many, in another folder."""
    accumulated(spark, path, trange).df.write.mode("overwrite").parquet(f"{to}/batch=0")
    return accumulated(spark, to, trange)
