"""Functions of one's own over elements and tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.operators.convert import truncate
from lattica.tensor import Tensor

INTERSECT, UNION = "intersect", "union"


def map_elements(t: Tensor, op: Callable[[Column], Column]) -> Tensor:
    """op over stored elements, as a column expression."""
    return Tensor(t.df.select(*t.coordinates, op(F.col("v")).cast("double").alias("v")), t.trange, t.policy, t.inner)


def zip_elements(a: Tensor, b: Tensor, op: Callable[[Column, Column], Column], how: str = INTERSECT) -> Tensor:
    """op over pairs of elements that both store, or (union) that either stores, the other's being 0."""
    right = b.df.select(*b.coordinates, F.col("v").alias("w"))
    joined = a.df.join(right, a.coordinates, "inner" if how == INTERSECT else "full_outer")
    v, w = (F.coalesce(c, F.lit(0.0)) for c in ("v", "w"))
    return Tensor(joined.select(*a.coordinates, op(v, w).cast("double").alias("v")), a.trange, a.policy, a.inner)


def update_elements(t: Tensor, op: Callable[[Column], Column]) -> None:
    """map_elements, to which the handle is bound."""
    t.swap(map_elements(t, op))


def update_pairs(a: Tensor, b: Tensor, op: Callable[[Column, Column], Column], how: str = INTERSECT) -> None:
    """zip_elements, to which the first handle is bound."""
    a.swap(zip_elements(a, b, op, how))


def map_tiles(t: Tensor, op: Callable[[np.ndarray, tuple[tuple[int, int], ...]], np.ndarray | None]) -> Tensor:
    """op over whole tiles as arrays, with their bounds; None, or only zeros, leaves the tile of a sparse tensor out."""
    modes, names, sparse = t.trange.modes, t.outer_columns, not t.is_dense
    keys = [f"t{k}" for k in range(t.rank)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bounds = tuple(m.tile(int(pdf[k].iloc[0])) for m, k in zip(modes, keys))
        array = np.zeros(tuple(b - a for a, b in bounds))
        array[tuple(pdf[c].to_numpy(int) - a for c, (a, _) in zip(names, bounds))] = pdf["v"]
        out = op(array, bounds)
        if out is None or (sparse and not np.any(out)):
            return pd.DataFrame({c: [] for c in [*names, "v"]})
        at = np.indices(out.shape).reshape(len(bounds), -1)
        return pd.DataFrame({c: at[k] + bounds[k][0] for k, c in enumerate(names)} | {"v": np.asarray(out, float).ravel()})

    tiled = t.df.select(*names, "v", *t.tile_columns())
    schema = ", ".join(f"{c} bigint" for c in names) + ", v double"
    return Tensor(tiled.groupBy(*keys).applyInPandas(run, schema), t.trange, t.policy)


def map_and_screen(t: Tensor, op: Callable[[Column], Column], threshold: float) -> Tensor:
    """map_elements, then tiles whose new norm is too small go."""
    return truncate(map_elements(t, op), threshold)


__all__ = ["INTERSECT", "UNION", "map_and_screen", "map_elements", "map_tiles", "update_elements", "update_pairs", "zip_elements"]
