"""Shapes of sparse tensors: a row t0.., norm for each tile that is not zero, and their arithmetic.

A norm is the tile's Frobenius norm divided by its number of elements, as a float. Results of the
arithmetic are upper bounds of what the operation would give; below the threshold a tile is zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.values import Value
from lattica.labels import Labels
from lattica.tensor import EPSILON, Tensor, coordinates_frame, inside
from lattica.tiling import TiledRange


#: Tiles of a block of ``gemm``, about.
GEMM_TILES = 1 << 16
#: Tiles of a run that ``add_constant`` fills at once, and runs that a task has, about.
RUN_TILES, TASK_RUNS = 1 << 18, 4


def _keys(n: int) -> list[str]:
    return [f"t{k}" for k in range(n)]


def _volume(trange: TiledRange, modes: Sequence[int] | None = None, keys: Sequence[str] | None = None) -> Column:
    size = F.lit(1.0)
    modes = range(trange.rank) if modes is None else modes
    for k, m in enumerate(modes):
        size = size * trange.modes[m].size_column(F.col(keys[k] if keys else f"t{m}"))
    return size


def screened(shape: DataFrame, threshold: float = EPSILON) -> DataFrame:
    return shape.where(F.col("norm") >= F.lit(threshold))


def norms(t: Tensor, threshold: float = EPSILON, scaled: bool = True) -> DataFrame:
    """The shape of what is stored."""
    keys = _keys(t.rank)
    tiles = t.df.select(*t.tile_columns(), Value.of(t.values).squared().alias("q")).groupBy(*keys).agg(F.sqrt(F.sum("q")).alias("norm"))
    found = screened(tiles.withColumn("norm", F.col("norm") / _volume(t.trange)), threshold)
    return found if scaled else found.withColumn("norm", F.col("norm") * _volume(t.trange))


def sparsity(shape: DataFrame, trange: TiledRange) -> float:
    """The share of tiles that are zero."""
    total = trange.tiles.volume
    return 1.0 - shape.count() / total if total else 0.0


def transform(shape: DataFrame, op: Callable[[Column], Column], threshold: float = EPSILON) -> DataFrame:
    return screened(shape.withColumn("norm", op(F.col("norm"))), threshold)


def scale(shape: DataFrame, factor: complex, threshold: float = EPSILON) -> DataFrame:
    return transform(shape, lambda n: n * abs(factor), threshold)


def mask(shape: DataFrame, other: DataFrame) -> DataFrame:
    """Tiles that both have, with the first's norms."""
    keys = [c for c in shape.columns if c != "norm"]
    return shape.join(other.select(*keys), keys, "left_semi")


def permute(shape: DataFrame, order: Sequence[int]) -> DataFrame:
    return shape.select(*[F.col(f"t{k}").alias(f"t{m}") for m, k in enumerate(order)], "norm")


def add(a: DataFrame, b: DataFrame, threshold: float = EPSILON) -> DataFrame:
    """Of a sum or a difference: the triangle inequality."""
    keys = [c for c in a.columns if c != "norm"]
    return screened(a.unionByName(b).groupBy(*keys).agg(F.sum("norm").alias("norm")), threshold)


def add_constant(a: DataFrame, trange: TiledRange, value: complex, threshold: float = EPSILON) -> DataFrame:
    """Of adding a number to every element: every tile of the range may be there.

    Only stored tiles are dealt out, by runs of the range's tiles; the others are made where their run is filled.
    """
    box, keys = trange.tiles, _keys(trange.rank)
    sizes = [np.array(m.sizes(), float) for m in trange.modes]
    ordinal = F.lit(0).cast("bigint")
    for k, s in zip(keys, box.strides):
        ordinal = ordinal + F.col(k).cast("bigint") * F.lit(s)
    stored = a.where(inside(keys, box.lower, box.upper)).select(F.floor(ordinal / RUN_TILES).alias("run"), (ordinal % RUN_TILES).cast("int").alias("place"), F.col("norm").cast("double").alias("norm"))
    runs = -(-box.volume // RUN_TILES)
    rows = a.sparkSession.range(runs).selectExpr("id AS run", "CAST(NULL AS INT) AS place", "CAST(NULL AS DOUBLE) AS norm").unionByName(stored)

    def filled(key: tuple[pa.Scalar, ...], tiles: pa.Table) -> pa.Table:
        first = key[0].as_py() * RUN_TILES
        norms_ = np.zeros(min(RUN_TILES, box.volume - first))
        tiles = tiles.filter(tiles["place"].is_valid())
        norms_[tiles["place"].to_numpy()] = tiles["norm"].to_numpy()
        at = [(first + np.arange(len(norms_))) // s % e for s, e in zip(box.strides, box.extents)]
        norms_ += abs(value) / np.sqrt(math.prod((size[t] for size, t in zip(sizes, at)), start=1.0))
        keep = ~(norms_ < threshold)
        return pa.table({k: pa.array(t[keep], pa.int32()) for k, t in zip(keys, at)} | {"norm": norms_[keep]})

    dealt = rows.repartition(min(max(1, -(-runs // TASK_RUNS)), 1 << 16), "run")
    return dealt.groupBy("run").applyInArrow(filled, ", ".join([*(f"{k} int" for k in keys), "norm double"]))


def mult(a: DataFrame, b: DataFrame, trange: TiledRange, threshold: float = EPSILON) -> DataFrame:
    """Of an elementwise product."""
    keys = [c for c in a.columns if c != "norm"]
    joined = a.join(b.withColumnRenamed("norm", "other"), keys)
    return screened(joined.select(*keys, (F.col("norm") * F.col("other") * _volume(trange)).alias("norm")), threshold)


def gemm(a: DataFrame, a_labels: Labels, a_range: TiledRange, b: DataFrame, b_labels: Labels, target: Labels, factor: complex = 1, threshold: float = EPSILON, b_range: TiledRange | None = None) -> DataFrame:
    """Of a contraction or general product: the sum over contracted tiles of (a times the contracted volume) times (b times it).

    A shape is a tensor of its own, whose elements are tiles: its product is one by blocks of them, so
    that what is dealt out is blocks and their sums, not a row for each pair of tiles. Without b_range,
    labels that only b has are as long as its tiles say, which are then looked at first.
    """
    from lattica.plans.blocks import tile_product

    gone = (a_labels & b_labels) - target
    extents = {x: m.tiles for x, m in zip(a_labels, a_range.modes)}
    if b_range is not None:
        extents = {x: m.tiles for x, m in zip(b_labels, b_range.modes)} | extents
    lacking = [x for x in b_labels if x not in extents]
    if lacking:  # of what only b has, as many tiles as are there
        found = b.agg(*[F.max(f"t{b_labels.position(x)}") for x in lacking]).collect()[0]
        extents |= {x: 0 if m is None else m + 1 for x, m in zip(lacking, found)}

    def factor_of(shape: DataFrame, labels: Labels) -> Tensor:
        size = F.lit(1.0)
        for x in gone:
            size = size * a_range.modes[a_labels.position(x)].size_column(F.col(f"t{labels.position(x)}"))
        named = [F.col(f"t{k}").cast("bigint").alias(f"i{k}") for k in range(len(labels))]
        return Tensor(shape.select(*named, (F.col("norm") * size).alias("v")), TiledRange.whole([extents[x] for x in labels]))

    side = max(2, round(GEMM_TILES ** (1 / max(len(a_labels), len(b_labels), len(target), 1))))
    left = factor_of(a, a_labels)
    same = a is b and all((x in gone, extents[x]) == (y in gone, extents[y]) and (x not in gone or x == y) for x, y in zip(a_labels, b_labels))
    made = tile_product(left, ",".join(a_labels), left if same else factor_of(b, b_labels), ",".join(b_labels), ",".join(target), side)
    summed = made.df.where("v > 0")  # tiles that none of the pairs gives come out of a block as 0
    keys = [F.col(f"i{k}").cast("int").alias(f"t{k}") for k in range(len(target))]
    return screened(summed.select(*keys, (F.col("v") * abs(factor)).alias("norm")), threshold)


def block(shape: DataFrame, lower: Sequence[int], upper: Sequence[int], factor: complex = 1, order: Sequence[int] | None = None, threshold: float = EPSILON) -> DataFrame:
    """Tiles lower to upper - 1, from 0 on; scaled by a factor and with modes in another order, if given."""
    keys = [c for c in shape.columns if c != "norm"]
    cut = shape.where(inside(keys, lower, upper))
    moved = cut.select(*[(F.col(c) - F.lit(a)).cast("int").alias(c) for c, a in zip(keys, lower)], "norm")
    moved = moved if factor == 1 else scale(moved, factor, threshold)
    return moved if order is None else permute(moved, order)


def update_block(shape: DataFrame, lower: Sequence[int], upper: Sequence[int], other: DataFrame) -> DataFrame:
    keys = [c for c in shape.columns if c != "norm"]
    moved = other.select(*[(F.col(c) + F.lit(a)).cast("int").alias(c) for c, a in zip(keys, lower)], "norm")
    return shape.where(~inside(keys, lower, upper)).unionByName(moved)


def constant(spark, trange: TiledRange, norm: float, threshold: float = EPSILON) -> DataFrame:
    """The same norm per element for every tile."""
    return from_op(spark, trange, lambda *_: F.lit(float(norm)), threshold)


def from_op(spark, trange: TiledRange, op: Callable[..., Column], threshold: float = EPSILON) -> DataFrame:
    """Norms per element by an expression over the tiles' indices, made on the executors."""
    tiles = coordinates_frame(spark, TiledRange.whole(trange.tiles.extents))
    keys = [F.col(f"i{k}").cast("int").alias(f"t{k}") for k in range(trange.rank)]
    return screened(tiles.select(*keys, op(*[F.col(f"i{k}") for k in range(trange.rank)]).cast("double").alias("norm")), threshold)


def from_norms(spark, norms_: dict[tuple[int, ...], float], trange: TiledRange, scaled: bool = False, threshold: float = EPSILON) -> DataFrame:
    """A shape of one's own."""
    rows = [(*map(int, t), float(n) if scaled else float(n) / math.prod(trange.tile_range(t).extents)) for t, n in norms_.items()]
    schema = ", ".join(f"{k} int" for k in _keys(trange.rank)) + ", norm double"
    return screened(spark.createDataFrame(rows, schema), threshold)
