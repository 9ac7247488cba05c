"""Tensors as relations: a row for each stored element, with its coordinates and value."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import product as grid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import labels as L
from lattica.functions.values import COMPLEX, REAL
from lattica.tiling import TiledRange, Tiling

DENSE, SPARSE = "dense", "sparse"
#: Below this norm per element a tile counts as zero.
EPSILON = float(np.finfo(np.float32).eps)
#: The most elements that are brought to the driver, or taken from it.
LOCAL_ELEMENTS = 25_000_000


class Tensor:
    """A handle: a DataFrame of i0.. (and n0.. for tensors of tensors) and v, or re and im, with its tiled range.

    A dense tensor stores every element of its range, a sparse one those of its non-zero tiles (a tile
    is there if it has a row). Rows left out of a stored tile are zeros. DataFrames never change;
    ``t["i,j"] = expression`` binds the handle to a new one.
    """

    def __init__(self, df: DataFrame | None, trange: TiledRange, policy: str = SPARSE, inner: int = 0):
        self.trange, self.policy, self.inner = trange, policy, inner
        self.df = None if df is None else self._checked(df)

    def _checked(self, df: DataFrame) -> DataFrame:
        values = COMPLEX if "re" in df.columns else REAL
        wanted = [*self.coordinates, *values]
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise L.AnnotationError(f"missing columns {missing}")
        return df.select(*wanted)

    @property
    def rank(self) -> int:
        return self.trange.rank

    @property
    def outer_columns(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    @property
    def inner_columns(self) -> list[str]:
        return [f"n{k}" for k in range(self.inner)]

    @property
    def coordinates(self) -> list[str]:
        return self.outer_columns + self.inner_columns

    @property
    def values(self) -> tuple[str, ...]:
        return COMPLEX if self.df is not None and "re" in self.df.columns else REAL

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def extents(self) -> tuple[int, ...]:
        return self.trange.elements.extents

    @property
    def is_dense(self) -> bool:
        return self.policy == DENSE

    @property
    def is_initialised(self) -> bool:
        return self.df is not None

    def __bool__(self) -> bool:
        return self.is_initialised

    def _with(self, df: DataFrame, **changes) -> Tensor:
        return Tensor(df, changes.get("trange", self.trange), changes.get("policy", self.policy), changes.get("inner", self.inner))

    def clone(self) -> Tensor:
        return self._with(self.df)

    def swap(self, other: Tensor) -> None:
        self.__dict__, other.__dict__ = other.__dict__, self.__dict__

    # ---- annotated access

    def __getitem__(self, annotation: str):
        from lattica.plans.nodes import Leaf

        outer, inner = L.parse(annotation)
        if len(outer) != self.rank or len(inner) != self.inner:
            raise L.AnnotationError(f"{annotation!r} does not fit a tensor of rank {self.rank}" + f" with inner rank {self.inner}" * bool(self.inner))
        return Leaf(self, outer, inner)

    def __setitem__(self, annotation: str, expression) -> None:
        from lattica.plans.planner import evaluate

        outer, inner = L.parse(annotation)
        found = evaluate(expression, outer, inner, self.policy if self.is_initialised else None)
        self.__dict__.update(found.__dict__)

    # ---- tiles

    def tile_columns(self) -> list[Column]:
        return [m.tile_column(F.col(f"i{k}")).alias(f"t{k}") for k, m in enumerate(self.trange.modes)]

    def find(self, tile: Sequence[int]) -> DataFrame:
        """The stored elements of one tile; the bounds reach the scan."""
        box = self.trange.tile_range(tile)
        return self.df.where(inside(self.outer_columns, box.lower, box.upper))

    def elements(self, lower: Sequence[int], upper: Sequence[int]) -> Tensor:
        """The elements from lower to upper - 1, as one tile that keeps its bounds."""
        box = self.trange.elements
        if any(not a <= x < y <= b for a, b, x, y in zip(box.lower, box.upper, lower, upper)):
            raise L.AnnotationError(f"{tuple(lower)} to {tuple(upper)} is not within {box}")
        trange = TiledRange(tuple(Tiling((a, b)) for a, b in zip(lower, upper)))
        return self._with(self.df.where(inside(self.outer_columns, lower, upper)), trange=trange)

    def stored_tiles(self) -> DataFrame:
        """A row t0.., stored for each tile that has elements, with their number."""
        return self.df.select(*self.tile_columns()).groupBy(*[f"t{k}" for k in range(self.rank)]).agg(F.count("*").alias("stored"))

    def size_of(self) -> int:
        """Bytes of the coordinates and values stored, as 8 each, uncompressed."""
        return 8 * (len(self.coordinates) + len(self.values)) * self.df.count()

    def set_tile(self, tile: Sequence[int], values: float | np.ndarray | DataFrame) -> None:
        """Put one tile in the place of what is stored there."""
        box = self.trange.tile_range(tile)
        if not isinstance(values, DataFrame):
            block = np.broadcast_to(np.asarray(values), box.extents)
            values = from_numpy(self.spark, block).df
            values = values.select(*[(F.col(f"i{k}") + F.lit(a)).alias(f"i{k}") for k, a in enumerate(box.lower)], *self.values)
        self.df = self.df.where(~inside(self.outer_columns, box.lower, box.upper)).unionByName(self._checked(values))

    def is_zero(self, tile: Sequence[int]) -> bool:
        return not self.is_dense and self.find(tile).limit(1).count() == 0

    # ---- placement

    def repartitioned(self, partitions: int | None = None, by: Sequence[str] | None = None, ranged: bool = False) -> Tensor:
        """Rows dealt out by coordinates: hashed, or in ranges so that neighbours stay together."""
        columns = list(by or self.outer_columns)
        deal = self.df.repartitionByRange if ranged else self.df.repartition
        return self._with(deal(partitions, *columns) if partitions else deal(*columns))

    def replicated(self, most_rows: int = 1_000_000) -> Tensor:
        """Marked for broadcast, if its rows have been counted and are few enough; unchanged else."""
        return self._with(F.broadcast(self.df)) if self.df.limit(most_rows + 1).count() <= most_rows else self.clone()

    # ---- conversion

    def cast(self, kind: str) -> Tensor:
        return self._with(self.df.select(*self.coordinates, *[F.col(c).cast(kind).alias(c) for c in self.values]))

    def to_complex(self) -> Tensor:
        return self if self.values == COMPLEX else self._with(self.df.select(*self.coordinates, F.col("v").alias("re"), F.lit(0.0).alias("im")))

    def real(self) -> Tensor:
        return self if self.values == REAL else self._with(self.df.select(*self.coordinates, F.col("re").alias("v")))

    def imag(self) -> Tensor:
        part = F.lit(0.0) if self.values == REAL else F.col("im")
        return self._with(self.df.select(*self.coordinates, part.alias("v")))

    def to_numpy(self) -> np.ndarray:
        """All elements on the driver, absent ones as zeros; refused beyond LOCAL_ELEMENTS."""
        if self.inner:
            raise L.AnnotationError("tensors of tensors have no one shape")
        if self.trange.elements.volume > LOCAL_ELEMENTS:
            raise ValueError(f"{self.trange.elements.volume} elements are too many for the driver")
        rows = self.df.toPandas()
        out = np.zeros(self.extents, complex if self.values == COMPLEX else float)
        at = tuple(rows[c].to_numpy(int) - a for c, a in zip(self.outer_columns, self.trange.elements.lower))
        out[at] = rows["re"] + 1j * rows["im"] if self.values == COMPLEX else rows["v"]
        return out

    def save(self, path: str) -> None:
        """Parquet, sorted within partitions by coordinates so that blocks prune, and the ranges beside it."""
        self.df.sortWithinPartitions(*self.outer_columns).write.mode("overwrite").parquet(f"{path}/elements")
        facts = {"marks": [m.marks for m in self.trange.modes], "policy": self.policy, "inner": self.inner}
        self.spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tensor:
        facts = json.loads(spark.read.text(f"{path}/facts").collect()[0].value)
        trange = TiledRange(tuple(Tiling(tuple(m)) for m in facts["marks"]))
        return cls(spark.read.parquet(f"{path}/elements"), trange, facts["policy"], facts["inner"])

    def __repr__(self) -> str:
        return f"Tensor({self.policy}, {'x'.join(map(str, self.extents))}{', inner rank ' + str(self.inner) if self.inner else ''})"

    def show(self, rows: int = 20) -> None:
        self.df.orderBy(*self.coordinates).show(rows)


def inside(columns: Sequence[str], lower: Sequence[int], upper: Sequence[int]) -> Column:
    """A condition on coordinates, as plain comparisons that scans can use."""
    found = F.lit(True)
    for c, a, b in zip(columns, lower, upper):
        found = found & (F.col(c) >= F.lit(a)) & (F.col(c) < F.lit(b))
    return found


# ---- sources


def from_table(df: DataFrame, coordinates: Sequence[str | Column], value: str | Column, trange: TiledRange | Sequence[int], inner: Sequence[str | Column] = (), policy: str = SPARSE) -> Tensor:
    """A tensor of a table's rows; coordinates must be unique in it (group before)."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    named = [as_column(c).cast("bigint").alias(f"i{k}") for k, c in enumerate(coordinates)] + [as_column(c).cast("bigint").alias(f"n{k}") for k, c in enumerate(inner)]
    trange = trange if isinstance(trange, TiledRange) else TiledRange.whole(trange)
    return Tensor(df.select(*named, as_column(value).cast("double").alias("v")), trange, policy, len(inner))


def coordinates_frame(spark: SparkSession, trange: TiledRange) -> DataFrame:
    """A row for each element of the range, made on the executors."""
    box = trange.elements
    df = spark.range(box.volume)
    columns = [(F.floor(F.col("id") / s) % e + a).cast("bigint").alias(f"i{k}") for k, (a, e, s) in enumerate(zip(box.lower, box.extents, box.strides))]
    return df.select(*columns)


def fill(spark: SparkSession, trange: TiledRange, value: float | complex, policy: str = DENSE) -> Tensor:
    """A constant. A sparse tensor filled with 0 stores nothing."""
    df = coordinates_frame(spark, trange)
    if isinstance(value, complex):
        df = df.select("*", F.lit(value.real).alias("re"), F.lit(value.imag).alias("im"))
    else:
        df = df.withColumn("v", F.lit(float(value)))
    return Tensor(df.where(F.lit(False)) if policy == SPARSE and value == 0 else df, trange, policy)


def init_elements(spark: SparkSession, trange: TiledRange, op: Callable[..., Column], policy: str = DENSE) -> Tensor:
    """Elements by an expression over the coordinate columns."""
    df = coordinates_frame(spark, trange)
    return Tensor(df.withColumn("v", op(*[F.col(f"i{k}") for k in range(trange.rank)]).cast("double")), trange, policy)


def fill_random(spark: SparkSession, trange: TiledRange, seed: int = 0, policy: str = DENSE, high: int = 101) -> Tensor:
    """Whole numbers below high, by a hash of the coordinates: the same in every run and partitioning."""
    return init_elements(spark, trange, lambda *i: F.pmod(F.xxhash64(F.lit(seed), *i), F.lit(high)), policy)


def init_tiles(spark: SparkSession, trange: TiledRange, op: Callable[[tuple[tuple[int, int], ...]], np.ndarray | None], policy: str = SPARSE) -> Tensor:
    """Tiles by a Python function of their bounds, run on the executors; None leaves a tile out."""
    modes = trange.modes
    tiles = spark.range(trange.tiles.volume)
    box = trange.tiles

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for k in pdf["id"]:
                bounds = tuple(m.tile(t) for m, t in zip(modes, box.index(int(k))))
                block = op(bounds)
                if block is not None:
                    block = np.broadcast_to(np.asarray(block, float), tuple(b - a for a, b in bounds))
                    at = np.indices(block.shape).reshape(len(bounds), -1)
                    yield pd.DataFrame({f"i{d}": at[d] + bounds[d][0] for d in range(len(bounds))} | {"v": block.ravel()})

    schema = ", ".join(f"i{d} bigint" for d in range(trange.rank)) + ", v double"
    return Tensor(tiles.mapInPandas(run, schema), trange, policy)


def from_numpy(spark: SparkSession, values: np.ndarray | Sequence, trange: TiledRange | None = None, policy: str = DENSE, order: str = "C") -> Tensor:
    """A local array (or nested lists, or a column-major buffer with order F). Sparse tensors drop tiles of zeros."""
    array = np.asarray(values)
    if array.size > LOCAL_ELEMENTS:
        raise ValueError(f"{array.size} elements are too many for the driver")
    trange = trange or TiledRange.whole(array.shape)
    if order == "F":
        array = array.reshape(-1).reshape(trange.elements.extents, order="F")
    if array.shape != trange.elements.extents:
        raise ValueError(f"shape {array.shape} is not that of the range {trange.elements.extents}")
    at = np.indices(array.shape).reshape(array.ndim, -1)
    columns = {f"i{k}": at[k] + a for k, a in enumerate(trange.elements.lower)}
    keep = np.ones(array.size, bool)
    if policy == SPARSE:
        keep[:] = False
        for tile in grid(*(range(m.tiles) for m in trange.modes)):
            box = trange.tile_range(tile).shift([-a for a in trange.elements.lower])
            cut = tuple(slice(a, b) for a, b in zip(box.lower, box.upper))
            if np.abs(array[cut]).any():
                mask = np.zeros(array.shape, bool)
                mask[cut] = True
                keep |= mask.ravel()
    flat = array.ravel()
    values_ = {"re": flat.real.astype(float), "im": flat.imag.astype(float)} if np.iscomplexobj(array) else {"v": flat.astype(float)}
    import pandas as pd

    schema = ", ".join([*(f"{c} bigint" for c in columns), *(f"{c} double" for c in values_)])
    return Tensor(spark.createDataFrame(pd.DataFrame(columns | values_)[keep], schema), trange, policy)


def diagonal(spark: SparkSession, trange: TiledRange, values: float | Sequence[float], policy: str = SPARSE) -> Tensor:
    """The hyper-diagonal: one constant, or the values given, from the greatest lower bound on."""
    low, high = max(m.lower for m in trange.modes), min(m.upper for m in trange.modes)
    if isinstance(values, (int, float)):
        df = spark.range(low, max(low, high)).select(F.col("id"), F.lit(float(values)).alias("v"))
    else:
        df = spark.createDataFrame([(low + k, float(v)) for k, v in enumerate(values) if low + k < high], "id bigint, v double")
    return Tensor(df.select(*[F.col("id").alias(f"i{k}") for k in range(trange.rank)], "v"), trange, policy)


def nested(spark: SparkSession, trange: TiledRange, inner_extents: Callable[..., list[Column]], op: Callable[..., Column], policy: str = SPARSE) -> Tensor:
    """A tensor of tensors: inner extents and elements by expressions over the coordinates; an inner extent of 0 leaves a cell empty."""
    df = coordinates_frame(spark, trange)
    outer = [F.col(f"i{k}") for k in range(trange.rank)]
    extents = inner_extents(*outer)
    for k, e in enumerate(extents):
        df = df.where(e > 0).withColumn(f"n{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), e.cast("bigint") - 1)))
    inner = [F.col(f"n{k}") for k in range(len(extents))]
    return Tensor(df.withColumn("v", op(*outer, *inner).cast("double")), trange, policy, len(extents))
