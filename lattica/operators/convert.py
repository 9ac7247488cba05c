"""Tensors to other tilings, policies and ranges: retile, concat, stack, split, to_sparse, to_dense, truncate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from lattica.labels import AnnotationError
from lattica.operators.shape import norms
from lattica.tensor import DENSE, EPSILON, SPARSE, Tensor, coordinates_frame, inside
from lattica.tiling import TiledRange, Tiling


def retile(t: Tensor, trange: TiledRange, value: float = 0.0) -> Tensor:
    """New tiles. Elements outside the new range go; what a tensor grows by has the value.

    Zeros are stored in dense tensors only; any other value is, whatever the policy.
    """
    box = trange.elements
    df = t.df.where(inside(t.outer_columns, box.lower, box.upper))
    out = Tensor(df, trange, t.policy, t.inner)
    if value:
        if t.inner:
            raise AnnotationError("tensors of tensors grow by empty cells only")
        old = t.trange.elements
        new = coordinates_frame(t.spark, trange).where(~inside(t.outer_columns, old.lower, old.upper))
        parts = [F.lit(float(value) if c != "im" else 0.0).alias(c) for c in t.values]
        out = Tensor(out.df.unionByName(new.select(*t.outer_columns, *parts)), trange, t.policy)
    return to_dense(out) if t.is_dense and box != t.trange.elements else out


def truncate(t: Tensor, threshold: float = EPSILON) -> Tensor:
    """Drop tiles whose norm per element is below the threshold; dense tensors stay as they are."""
    if t.is_dense:
        return t.clone()
    keys = [f"t{k}" for k in range(t.rank)]
    tiled = t.df.select("*", *t.tile_columns())
    return Tensor(tiled.join(norms(t, threshold).select(*keys), keys, "left_semi"), t.trange, SPARSE, t.inner)


def to_sparse(t: Tensor, threshold: float = EPSILON) -> Tensor:
    return truncate(Tensor(t.df, t.trange, SPARSE, t.inner), threshold)


def to_dense(t: Tensor) -> Tensor:
    """Every element of the range becomes a row."""
    if t.inner:
        raise AnnotationError("cells that are missing have no inner range to fill")
    grid = coordinates_frame(t.spark, t.trange)
    filled = grid.join(t.df, t.outer_columns, "left").select(*t.outer_columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in t.values])
    return Tensor(filled, t.trange, DENSE)


def concat(tensors: Sequence[Tensor], modes: Sequence[int]) -> Tensor:
    """One after the other along a mode; along several modes at once they form a block diagonal (all else is zero)."""
    first = tensors[0]
    start = list(first.trange.elements.lower)
    tilings = list(first.trange.modes)
    df = None
    for nr, t in enumerate(tensors):
        for k in range(first.rank):
            if k not in modes and not t.trange.modes[k].congruent(first.trange.modes[k]):
                raise AnnotationError(f"mode {k} is tiled in two ways")
        moved = [(F.col(c) + F.lit(start[k] - t.trange.elements.lower[k] if k in modes else 0)).alias(c) for k, c in enumerate(t.outer_columns)]
        part = t.df.select(*moved, *t.inner_columns, *t.values)
        df = part if df is None else df.unionByName(part)
        for k in modes:
            start[k] += t.trange.modes[k].extent
            if nr:
                tilings[k] = tilings[k].concat(t.trange.modes[k])
    out = Tensor(df, TiledRange(tuple(tilings)), first.policy, first.inner)
    return to_dense(out) if first.is_dense and len(modes) > 1 else out


def stack(tensors: Sequence[Tensor], tile: int = 1) -> Tensor:
    """Along a new leading mode."""
    df = None
    for k, t in enumerate(tensors):
        moved = [F.lit(k).cast("bigint").alias("i0")] + [F.col(c).alias(f"i{m + 1}") for m, c in enumerate(t.outer_columns)]
        part = t.df.select(*moved, *t.inner_columns, *t.values)
        df = part if df is None else df.unionByName(part)
    trange = TiledRange((Tiling.uniform(len(tensors), tile), *tensors[0].trange.modes))
    return Tensor(df, trange, tensors[0].policy, tensors[0].inner)


def split(t: Tensor, k: int) -> Tensor:
    """The k-th of the stacked tensors."""
    rest = [F.col(f"i{m + 1}").alias(f"i{m}") for m in range(t.rank - 1)]
    return Tensor(t.df.where(F.col("i0") == k).select(*rest, *t.inner_columns, *t.values), TiledRange(t.trange.modes[1:]), t.policy, t.inner)


def replicate(t: Tensor, extents: Sequence[int]) -> Tensor:
    """New leading modes along which the tensor repeats."""
    n = len(extents)
    grid = coordinates_frame(t.spark, TiledRange.whole(extents))
    moved = t.df.select(*[F.col(c).alias(f"i{k + n}") for k, c in enumerate(t.outer_columns)], *t.inner_columns, *t.values)
    return Tensor(grid.crossJoin(moved), TiledRange((*(Tiling.whole(e) for e in extents), *t.trange.modes)), t.policy, t.inner)


def shift(t: Tensor, by: Sequence[int]) -> Tensor:
    moved = [(F.col(c) + F.lit(d)).alias(c) for c, d in zip(t.outer_columns, by)]
    return Tensor(t.df.select(*moved, *t.inner_columns, *t.values), t.trange.shift(by), t.policy, t.inner)


def delta_select(t: Tensor, mode: int, index: int) -> Tensor:
    """Contraction with a Kronecker delta: the slice at an index, as a filter."""
    rest = [k for k in range(t.rank) if k != mode]
    df = t.df.where(F.col(f"i{mode}") == index).select(*[F.col(f"i{k}").alias(f"i{m}") for m, k in enumerate(rest)], *t.inner_columns, *t.values)
    return Tensor(df, t.trange.permute(rest), t.policy, t.inner)
