"""Reductions of expressions to numbers (or one-row DataFrames) and over modes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.values import COMPLEX, Value
from lattica.labels import AnnotationError, Labels
from lattica.plans.nodes import Node, Product
from lattica.plans.planner import Planned, plan
from lattica.tensor import Tensor


PRODUCTS = ("product", "log_product")


def _flat(node: Node) -> Planned:
    return plan(node).settled()


def _implicit(p: Planned) -> DataFrame:
    """One row: count of rows, and the volume of the tiles they are in (of the whole range if dense)."""
    if p.dense:
        volume = 1
        for x in p.outer:
            volume *= p.tilings[x].extent
        return p.df.agg(F.count("*").alias("__n")).withColumn("__volume", F.lit(volume).cast("bigint"))
    tiles = [p.tilings[x].tile_column(F.col(f"`{x}`")).alias(f"__t{k}") for k, x in enumerate(p.outer)]
    counted = p.df.groupBy(*tiles).agg(F.count("*").alias("__n"))
    size = F.lit(1).cast("bigint")
    for k, x in enumerate(p.outer):
        size = size * p.tilings[x].size_column(F.col(f"__t{k}"))
    return counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"), F.coalesce(F.sum(size), F.lit(0)).alias("__volume"))


def reduction(name: str, node: Node) -> DataFrame:
    """A one-row DataFrame with column ``value`` (``re`` and ``im`` for complex sums).

    Zeros that a stored tile has but no row shows count for min, max, abs_min and products; tiles that
    are not stored do not. max of nothing, and min of nothing, are null. log_product is the natural
    logarithm of the product's absolute value, minus infinity for 0: it stays finite where the product
    of many elements leaves the range of a double.
    """
    p = _flat(node)
    value = Value.of(p.values)
    if name in ("min", "max") and p.values == COMPLEX:
        raise AnnotationError("complex values have no order")
    if name == "trace":
        same = F.lit(True)
        for x in list(p.outer)[1:]:
            same = same & (F.col(f"`{x}`") == F.col(f"`{p.outer.names[0]}`"))
        return _sums(p.df.where(same), p)
    if name == "sum":
        return _sums(p.df, p)
    if name in ("squared_norm", "norm"):
        total = F.coalesce(F.sum(value.squared()), F.lit(0.0))
        return p.df.agg((F.sqrt(total) if name == "norm" else total).alias("value"))
    if name == "abs_max":
        return p.df.agg(F.coalesce(F.max(value.abs()), F.lit(0.0)).alias("value"))
    if name == "volume":
        return p.df.agg(F.count("*").alias("value"))
    if len(p.inner):
        holes = F.lit(False)
        found = p.df
    else:
        facts = _implicit(p)
        holes, found = F.col("__n") < F.col("__volume"), None
    agg = {"min": F.min("v") if p.values != COMPLEX else None, "max": F.max("v") if p.values != COMPLEX else None, "abs_min": F.min(value.abs()), "product": F.product("v") if p.values != COMPLEX else None, "log_product": F.sum(F.when(value.abs() == 0, F.lit(-math.inf)).otherwise(F.log(value.abs())))}[name]
    one, zero = (F.lit(0.0), F.lit(-math.inf)) if name == "log_product" else (F.lit(1.0), F.lit(0.0))
    folded = p.df.agg(agg.alias("value"))
    if found is not None:
        return folded.select(F.coalesce("value", one).alias("value")) if name in PRODUCTS else folded
    both = folded.crossJoin(facts)  # one row each
    if name in PRODUCTS:
        return both.select(F.when(holes, zero).otherwise(F.coalesce("value", one)).alias("value"))
    fold = {"min": F.least, "max": F.greatest, "abs_min": F.least}[name]
    return both.select(F.when(holes, fold("value", zero)).otherwise(F.col("value")).alias("value"))


def _sums(df: DataFrame, p: Planned) -> DataFrame:
    if p.values == COMPLEX:
        return df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in COMPLEX])
    return df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))


def _number(df: DataFrame) -> float | complex:
    row = df.collect()[0]
    return complex(row.re, row.im) if "re" in df.columns else row["value"]


def dot_frame(left: Node, right: Node, conjugate: bool = False) -> DataFrame:
    """The sum of products of elements with equal labels, as one row."""
    (a, m), (b, n) = left.labels(), right.labels()
    if not a.same_set(b) or not m.same_set(n):
        raise AnnotationError(f"{a};{m} and {b};{n} differ")
    p = plan(Product(left.conj() if conjugate else left, right), Labels(), Labels()).settled()
    return _sums(p.df, p)


def ternary_dot(annotation: str, a: Tensor, b: Tensor, c: Tensor) -> DataFrame:
    """``"hik,hkj,hji"``: the sum over all labels of three factors, as one row."""
    from lattica.labels import parse_einsum

    x, y, z = (t[s] for t, s in zip((a, b, c), parse_einsum(annotation)[0]))
    p = plan(Product(Product(x, y), z), Labels(), Labels()).settled()
    return _sums(p.df, p)


def custom(node: Node, zero: Column, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda x: x, other: Node | None = None, element: Callable[..., Column] | None = None) -> DataFrame:
    """A reduction of one's own: elements (or pairs of elements with equal labels) are folded by ``merge`` in every partition, then across.

    merge must be associative and commutative. Runs of 256 neighbours are folded in the JVM, then runs of
    the results, and so on: no row ever holds more than a few thousand values, however large the tensor.
    """
    p = _flat(node)
    df, value = p.df.select(*p.columns, F.col("v").alias("a")), F.col("a")
    if other is not None:
        q = _flat(other)
        df = df.join(q.df.select(*q.columns, F.col("v").alias("b")), p.columns)
        value = element(F.col("a"), F.col("b")) if element else F.col("a") * F.col("b")
    elif element:
        value = element(F.col("a"))
    df = df.select(value.alias("x"))
    folded = F.aggregate(F.collect_list("x"), zero, merge)
    left = math.prod(t.extent for t in p.tilings.values())
    while left > 4096:
        df = df.groupBy(F.shiftright(F.monotonically_increasing_id(), 8).alias("__g")).agg(folded.alias("x")).select("x")
        left = left // 256 + 1
    df = df.agg(folded.alias("x"))
    return df.select(finish(F.col("x")).alias("value"))


def reduce_modes(node: Node, last: int) -> Tensor:
    """Sums over the last modes of the expression's own order."""
    p = _flat(node)
    keep = Labels(p.outer.names[: len(p.outer) - last])
    df = p.df.groupBy(*keep).agg(*[F.sum(c).alias(c) for c in p.values])
    from lattica.tensor import DENSE, SPARSE
    from lattica.tiling import TiledRange

    named = df.select(*[F.col(f"`{x}`").alias(f"i{k}") for k, x in enumerate(keep)], *p.values)
    return Tensor(named, TiledRange(tuple(p.tilings[x] for x in keep)), DENSE if p.dense else SPARSE)


REDUCTIONS: dict[str, Callable] = {n: (lambda node, n=n: _number(reduction(n, node))) for n in ("sum", "product", "log_product", "trace", "squared_norm", "norm", "min", "max", "abs_min", "abs_max", "volume")}
REDUCTIONS |= {
    "dot": lambda node, other: _number(dot_frame(node, other)),
    "inner_product": lambda node, other: _number(dot_frame(node, other, True)),
    "reduce": lambda node, *args, **kw: _number(custom(node, *args, **kw)),
}
