"""Tensors of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.tensor import DENSE, Tensor, from_table
from lattica.tiling import TiledRange, Tiling

#: Tiles of these sizes whatever the extent, so that a key's tile is known without the table.
SUPPLIER_TILE, PART_TILE, USER_TILE, VECTOR_TILE = 25, 100, 50, 125


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def extent(self, name: str, key: str) -> int:
        """Keys start at 0; the dimension table has them all."""
        return (self[name].agg(F.max(key)).collect()[0][0] or 0) + 1

    def codes(self, name: str, column: str) -> tuple[DataFrame, int]:
        """Numbers of a column's few values, in order."""
        values = self[name].select(column).distinct()
        coded = values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint").alias("code"))
        return coded, values.count()

    def _coded(self, name: str, column: str) -> tuple[DataFrame, int]:
        coded, n = self.codes(name, column)
        return self[name].join(coded, column), n

    def supplier_part(self, sparse: bool = True) -> Tensor:
        """Q(s, p): the quantity of part p that supplier s sold."""
        df = self["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
        trange = TiledRange((Tiling.every(self.extent("supplier", "s_suppkey"), SUPPLIER_TILE), Tiling.every(self.extent("part", "p_partkey"), PART_TILE)))
        return from_table(df, ["l_suppkey", "l_partkey"], "q", trange)

    def prices(self) -> Tensor:
        """P(s, p): order lines of part p from supplier s."""
        df = self["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("q"))
        return from_table(df, ["l_suppkey", "l_partkey"], "q", self.supplier_part().trange)

    def supplier_month_flag(self) -> Tensor:
        """L(s, m, f)."""
        df, flags = self._coded("lineitem", "l_returnflag")
        df = df.groupBy("l_suppkey", (F.month("l_shipdate") - 1).alias("m"), "code").agg(F.sum("l_quantity").alias("q"))
        trange = TiledRange((Tiling.every(self.extent("supplier", "s_suppkey"), SUPPLIER_TILE), Tiling.uniform(12, 4), Tiling.whole(flags)))
        return from_table(df, ["l_suppkey", "m", "code"], "q", trange)

    def user_event(self) -> Tensor:
        """E(u, t): events of type t of user u."""
        df, kinds = self._coded("events", "event_type")
        users = (self["events"].agg(F.max("user_id")).collect()[0][0] or 0) + 1
        return from_table(df.groupBy("user_id", "code").agg(F.count("*").alias("n")), ["user_id", "code"], "n", TiledRange((Tiling.every(users, USER_TILE), Tiling.whole(kinds))))

    def embedding(self) -> Tensor:
        """X(n, f): dense, in whole thousandths."""
        df = self["embeddings"].select("vec_id", F.posexplode("embedding").alias("f", "x"))
        value: Column = F.floor(F.col("x").cast("double") * 1000)
        n = (self["embeddings"].agg(F.max("vec_id")).collect()[0][0] or 0) + 1
        width = self["embeddings"].agg(F.max(F.size("embedding"))).collect()[0][0] or 0
        return from_table(df, ["vec_id", "f"], value, TiledRange((Tiling.every(n, VECTOR_TILE), Tiling.every(width, 64))), policy=DENSE)

    def part_suppliers(self) -> Tensor:
        """T(p; n): the quantities of part p's suppliers, by supplier; cells differ in length."""
        q = self["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
        place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey")) - 1
        df = q.select("l_partkey", place.alias("n"), "q")
        return from_table(df, ["l_partkey"], "q", TiledRange((Tiling.every(self.extent("part", "p_partkey"), PART_TILE),)), inner=["n"])
