"""From expression trees to one DataFrame.

Labels that are wanted above go down the tree: a product sums out a label as soon as neither its
target nor its other factor's subtree needs it, which Catalyst would not do by itself. Scalar factors
come up and are applied once, after all sums. Blocks become filters at the leaves, where they reach
the scan. Products whose labels all survive are plain joins without an aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.values import COMPLEX, REAL, Value
from lattica.labels import AnnotationError, Labels
from lattica.plans.nodes import Block, Conj, Leaf, Mapped, Node, Product, Scaled, Sum
from lattica.tensor import DENSE, SPARSE, Tensor, inside
from lattica.tiling import TiledRange, Tiling


@dataclass
class Planned:
    """A DataFrame with a column for each label, its values, and a factor still to be applied."""

    df: DataFrame
    outer: Labels
    inner: Labels
    values: tuple[str, ...]
    tilings: dict[str, Tiling]
    dense: bool
    factor: complex = 1

    @property
    def columns(self) -> list[str]:
        return [*self.outer, *self.inner]

    def settled(self) -> Planned:
        """With the factor applied."""
        if self.factor == 1:
            return self
        value = Value.of(self.values) * self.factor
        df = self.df.select(*self.columns, *value.named())
        return replace(self, df=df, values=REAL if value.im is None else COMPLEX, factor=1)


def plan(node: Node, want: Labels | None = None, want_inner: Labels | None = None) -> Planned:
    """want: the labels that are needed above; None keeps all that the node offers."""
    outer, inner = node.labels()
    want, want_inner = outer if want is None else want, inner if want_inner is None else want_inner
    found = _PLANS[type(node)](node, want, want_inner)
    if node.mask is not None and not isinstance(node, Product):
        found = replace(found, df=_masked(found.df, node.mask, found.outer, found.tilings), dense=False)
    return found


def _masked(df: DataFrame, shape: DataFrame, outer: Labels, tilings: dict[str, Tiling]) -> DataFrame:
    """Rows in tiles that the shape has; shapes are small beside elements, and Spark decides by size whether to broadcast."""
    named = shape.select(*[F.col(f"t{k}").alias(f"__t{k}") for k in range(len(outer))]).distinct()
    tiled = df.select("*", *[tilings[x].tile_column(F.col(f"`{x}`")).alias(f"__t{k}") for k, x in enumerate(outer)])
    keys = [f"__t{k}" for k in range(len(outer))]
    return tiled.join(named, keys, "left_semi").drop(*keys)


def _within(df: DataFrame, shape: DataFrame, target: Labels, have: Labels, tilings: dict[str, Tiling]) -> DataFrame:
    """Rows of a factor that a wanted tile can need: its tiles in the modes that the factor has."""
    own = [(k, x) for k, x in enumerate(target) if x in have]
    if not own:
        return df
    return _masked(df, shape.select(*[F.col(f"t{k}").alias(f"t{n}") for n, (k, _) in enumerate(own)]), Labels([x for _, x in own]), tilings)


def _no_orphans(labels: Labels, want: Labels) -> None:
    lost = labels - want
    if len(lost):
        raise AnnotationError(f"nothing needs {','.join(lost)}; use reduce_modes to sum over it")


def _leaf(node: Leaf, want: Labels, want_inner: Labels) -> Planned:
    t = node.tensor
    if not t.is_initialised:
        raise AnnotationError("the tensor has no elements yet")
    _no_orphans(node.outer, want)
    _no_orphans(node.inner, want_inner)
    named = [F.col(c).alias(x) for c, x in zip(t.coordinates, (*node.outer, *node.inner))]
    return Planned(t.df.select(*named, *t.values), node.outer, node.inner, t.values, dict(zip(node.outer, t.trange.modes)), t.is_dense)


def _block(node: Block, want: Labels, want_inner: Labels) -> Planned:
    base, tilings, shifts = _leaf(node.leaf, want, want_inner), node.tilings(), node.shifts()
    df = base.df.where(inside([f"`{x}`" for x in base.outer], [t.lower for t in tilings], [t.upper for t in tilings]))
    moved = [(F.col(f"`{x}`") + F.lit(s)).alias(x) if s else F.col(f"`{x}`") for x, s in zip(base.outer, shifts)]
    df = df.select(*moved, *base.inner, *base.values)
    return replace(base, df=df, tilings={x: t.shift(s) for x, t, s in zip(base.outer, tilings, shifts)})


def _scaled(node: Scaled, want: Labels, want_inner: Labels) -> Planned:
    base = plan(node.child, want, want_inner)
    return replace(base, factor=base.factor * node.factor)


def _conj(node: Conj, want: Labels, want_inner: Labels) -> Planned:
    base = plan(node.child, want, want_inner)
    factor = base.factor.conjugate() if isinstance(base.factor, complex) else base.factor
    if base.values == REAL:
        return replace(base, factor=factor)
    return replace(base, df=base.df.select(*base.columns, *Value.of(base.values).conj().named()), factor=factor)


def _mapped(node: Mapped, want: Labels, want_inner: Labels) -> Planned:
    base = plan(node.child, want, want_inner).settled()
    return replace(base, df=base.df.select(*base.columns, node.op(F.col("v")).alias("v")))


def _flat(node: Node, factor: complex) -> list[tuple[complex, Node]]:
    """The terms of nested sums, with their factors: n terms cost one shuffle."""
    if node.mask is None:
        if isinstance(node, Sum):
            return [x for f, t in node.terms for x in _flat(t, factor * f)]
        if isinstance(node, Scaled):
            return _flat(node.child, factor * node.factor)
    return [(factor, node)]


def _sum(node: Sum, want: Labels, want_inner: Labels) -> Planned:
    node.labels()
    terms = []
    for f, t in _flat(node, 1):
        p = plan(t, want, want_inner)
        terms.append(replace(p, factor=p.factor * f).settled())
    first = terms[0]
    for t in terms[1:]:
        _same_extents(first.tilings, t.tilings)
        if t.dense != first.dense:
            raise AnnotationError("a dense and a sparse term; convert one (to_sparse, to_dense)")
    values = COMPLEX if any(t.values == COMPLEX for t in terms) else REAL
    df = None
    for t in terms:
        part = t.df.select(*[f"`{x}`" for x in first.columns], *(t.values if values == t.values else [F.col("v").alias("re"), F.lit(0.0).alias("im")]))
        df = part if df is None else df.unionByName(part)
    df = df.groupBy(*first.columns).agg(*[F.sum(c).alias(c) for c in values])
    return replace(first, df=df, values=values)


def _same_extents(a: dict[str, Tiling], b: dict[str, Tiling]) -> None:
    for x in a.keys() & b.keys():
        if a[x].extent != b[x].extent:
            raise AnnotationError(f"{x} has extents {a[x].extent} and {b[x].extent}")


def _factors(node: Node) -> list[Node] | None:
    """The factors of a product whose order may be chosen."""
    if isinstance(node, Product) and node.free and node.mask is None:
        return (_factors(node.left) or [node.left]) + (_factors(node.right) or [node.right])
    return None


def _product(node: Product, want: Labels, want_inner: Labels) -> Planned:
    if node.free and (factors := _factors(node)) and len(factors) > 2:
        from lattica.plans.order import chosen

        node = _keep_mask(chosen(factors, want), node)
    (a, m), (b, n) = node.left.labels(), node.right.labels()
    if node.denest:
        want_inner = Labels()
    for x in want - (a | b):
        raise AnnotationError(f"no factor has {x}")
    left = plan(node.left, a & (want | b), m & (want_inner | n))
    right = plan(node.right, b & (want | a), n & (want_inner | m))
    _same_extents(left.tilings, right.tilings)
    tilings = left.tilings | right.tilings
    shared = [x for x in left.columns if x in right.columns]
    keep, keep_inner = (left.outer | right.outer) & want, (left.inner | right.inner) & want_inner
    if node.mask is not None:  # before the join, whose rows are many more
        left, right = (replace(p, df=_within(p.df, node.mask, keep, p.outer, p.tilings)) for p in (left, right))
    l_df = left.df.select(*[F.col(f"`{x}`") for x in left.columns], *[F.col(c).alias(f"__l_{c}") for c in left.values])
    r_df = right.df.select(*[F.col(f"`{x}`") for x in right.columns], *[F.col(c).alias(f"__r_{c}") for c in right.values])
    df = l_df.join(r_df, shared) if shared else l_df.crossJoin(r_df)
    value = Value.of(left.values, "__l_") * Value.of(right.values, "__r_")
    values = REAL if value.im is None else COMPLEX
    names = [*keep, *keep_inner]
    df = df.select(*[f"`{x}`" for x in names], *value.named()) if names else df.select(*value.named())
    if node.mask is not None:
        df = _masked(df, node.mask, keep, tilings)
    if set(left.columns) | set(right.columns) != set(names):
        df = df.groupBy(*names).agg(*[F.sum(c).alias(c) for c in values])
    return Planned(df, keep, keep_inner, values, {x: tilings[x] for x in keep}, left.dense and right.dense and node.mask is None, left.factor * right.factor)


def _keep_mask(chosen: Product, node: Product) -> Product:
    chosen.mask = node.mask
    return chosen


_PLANS = {Leaf: _leaf, Block: _block, Scaled: _scaled, Conj: _conj, Sum: _sum, Product: _product, Mapped: _mapped}


def evaluate(node: Node, outer: Labels, inner: Labels = Labels(), policy: str | None = None) -> Tensor:  # noqa: B008
    """The expression as a tensor whose modes are the target's labels, in their order. Lazy, as all DataFrames are."""
    have, have_inner = node.labels()
    if any(x not in have for x in outer) or any(x not in have_inner for x in inner):
        raise AnnotationError(f"the expression has no {outer - have} {inner - have_inner}")
    p = plan(node, outer, inner).settled()
    if not p.outer.same_set(outer) or not p.inner.same_set(inner):
        raise AnnotationError(f"{p.outer};{p.inner} cannot be assigned to {outer};{inner}")
    if policy == DENSE and not p.dense:
        raise AnnotationError("a dense tensor cannot take a sparse expression; convert it (to_dense)")
    columns = [F.col(f"`{x}`").alias(f"i{k}") for k, x in enumerate(outer)] + [F.col(f"`{x}`").alias(f"n{k}") for k, x in enumerate(inner)]
    trange = TiledRange(tuple(p.tilings[x] for x in outer))
    return Tensor(p.df.select(*columns, *p.values), trange, DENSE if p.dense else SPARSE, len(inner))


def assign_block(block: Block, node: Node) -> None:
    """Rows outside the block stay; rows inside are those of the expression, moved to the block."""
    target = block.leaf.tensor
    outer, inner = block.labels()
    found = evaluate(node, outer, inner, target.policy)
    tilings = block.tilings()
    if found.extents != tuple(t.extent for t in tilings):
        raise AnnotationError(f"extents {found.extents} do not fit the block's {tuple(t.extent for t in tilings)}")
    moved = [(F.col(c) + F.lit(t.lower - a)).alias(c) for c, t, a in zip(target.outer_columns, tilings, found.trange.elements.lower)]
    inserted = found.df.select(*moved, *target.inner_columns, *found.values)
    rest = target.df.where(~inside(target.outer_columns, [t.lower for t in tilings], [t.upper for t in tilings]))
    target.df = rest.unionByName(inserted)
