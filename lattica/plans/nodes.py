"""Expression trees over annotated tensors. Building one plans nothing."""

from __future__ import annotations

import numbers
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame

from lattica.labels import AnnotationError, Labels
from lattica.tiling import Tiling

if TYPE_CHECKING:
    from lattica.tensor import Tensor


class Node:
    """Operators and reductions that all expressions have."""

    mask: DataFrame | None = None

    def __add__(self, other: Node) -> Node:
        return Sum(((1, self), (1, _node(other))))

    def __sub__(self, other: Node) -> Node:
        return Sum(((1, self), (-1, _node(other))))

    def __mul__(self, other: Node | complex) -> Node:
        if isinstance(other, numbers.Number):
            return Scaled(self, other)
        return Product(self, _node(other), free=True)

    def __rmul__(self, other: complex) -> Node:
        return Scaled(self, other)

    def __truediv__(self, other: complex) -> Node:
        return Scaled(self, 1 / other)

    def __neg__(self) -> Node:
        return Scaled(self, -1)

    def conj(self) -> Node:
        return self.child if isinstance(self, Conj) else Conj(self)

    def dot_inner(self, other: Node) -> Node:
        """Cells of tensors of tensors to numbers: inner modes are contracted."""
        return Product(self, other, denest=True)

    def set_shape(self, shape: DataFrame) -> Node:
        """Keep only result tiles that the shape (t0.., norm) has. The mask is applied before anything is summed."""
        out = replace(self)
        out.mask = shape
        return out

    def no_alias(self) -> Node:
        """DataFrames never alias; accepted for its own sake."""
        return self

    def labels(self) -> tuple[Labels, Labels]:
        """Outer and inner labels that the node has to offer."""
        raise NotImplementedError

    def tree(self, depth: int = 0) -> str:
        """The expression as text, a line for each node, its factors or terms below it."""
        outer, inner = self.labels()
        label = ",".join(outer) + (";" + ",".join(inner) if len(inner) else "")
        facts, children = _told(self)
        line = f"{'  ' * depth}{type(self).__name__.lower()} {label}{' ' + facts if facts else ''}{' masked' if self.mask is not None else ''}"
        return "\n".join([line, *(c.tree(depth + 1) for c in children)])

    # reductions, in lattica.operators.reduce
    def __getattr__(self, name: str):
        from lattica.operators import reduce as R

        if name in R.REDUCTIONS:
            return lambda *args, **kw: R.REDUCTIONS[name](self, *args, **kw)
        raise AttributeError(name)


def _node(x: object) -> Node:
    if not isinstance(x, Node):
        raise AnnotationError(f"{x!r} is no expression")
    return x


@dataclass
class Leaf(Node):
    tensor: Tensor
    outer: Labels
    inner: Labels

    def labels(self) -> tuple[Labels, Labels]:
        return self.outer, self.inner

    def block(self, lower: Sequence[int], upper: Sequence[int], preserve: bool = False) -> Block:
        """Tiles lower to upper - 1 of each mode; shifted to start at 0 unless bounds are preserved."""
        return Block(self, tuple(lower), tuple(upper), preserve)


@dataclass
class Block(Node):
    leaf: Leaf
    lower: tuple[int, ...]
    upper: tuple[int, ...]
    preserve: bool = False
    start: tuple[int, ...] | None = None

    def labels(self) -> tuple[Labels, Labels]:
        return self.leaf.labels()

    def at(self, *start: int) -> Block:
        """With lower bounds of one's own."""
        return replace(self, start=start)

    def tilings(self) -> tuple[Tiling, ...]:
        return tuple(m.block(a, b) for m, a, b in zip(self.leaf.tensor.trange.modes, self.lower, self.upper))

    def shifts(self) -> tuple[int, ...]:
        lows = [t.lower for t in self.tilings()]
        if self.start is not None:
            return tuple(s - a for s, a in zip(self.start, lows))
        return tuple(0 if self.preserve else -a for a in lows)

    def assign(self, expression: Node) -> None:
        """Put an expression, whose ranges start anywhere, in the block's place; the rest of the tensor stays."""
        from lattica.plans.planner import assign_block

        assign_block(self, expression)

    def __iadd__(self, other: Node) -> Block:
        self.assign(Block(self.leaf, self.lower, self.upper) + other)
        return self

    def __isub__(self, other: Node) -> Block:
        self.assign(Block(self.leaf, self.lower, self.upper) - other)
        return self

    def __imul__(self, other: Node | complex) -> Block:
        self.assign(Block(self.leaf, self.lower, self.upper) * other)
        return self


@dataclass
class Scaled(Node):
    child: Node
    factor: complex

    def labels(self) -> tuple[Labels, Labels]:
        return self.child.labels()


@dataclass
class Conj(Node):
    child: Node

    def labels(self) -> tuple[Labels, Labels]:
        return self.child.labels()


@dataclass
class Sum(Node):
    terms: tuple[tuple[complex, Node], ...]

    def labels(self) -> tuple[Labels, Labels]:
        first = self.terms[0][1].labels()
        for _, t in self.terms[1:]:
            if not all(a.same_set(b) for a, b in zip(first, t.labels())):
                raise AnnotationError(f"terms differ in labels: {first} and {t.labels()}")
        return first


@dataclass
class Product(Node):
    left: Node
    right: Node
    denest: bool = False
    #: For n-ary products whose order may be chosen.
    free: bool = False

    def labels(self) -> tuple[Labels, Labels]:
        (a, m), (b, n) = self.left.labels(), self.right.labels()
        return a | b, Labels() if self.denest else m | n


@dataclass
class Mapped(Node):
    """Values changed by an expression of the value column."""

    child: Node
    op: Callable[[Column], Column]
    extra: dict = field(default_factory=dict)

    def labels(self) -> tuple[Labels, Labels]:
        return self.child.labels()


def _told(node: Node) -> tuple[str, tuple[Node, ...]]:
    """What a line of the tree says beside the labels, and the nodes below."""
    match node:
        case Leaf():
            return repr(node.tensor), ()
        case Block():
            return f"tiles {node.lower} to {node.upper}", (node.leaf,)
        case Scaled():
            return f"by {node.factor}", (node.child,)
        case Sum():
            return "with " + ", ".join(str(f) for f, _ in node.terms), tuple(t for _, t in node.terms)
        case Product():
            return "of cells" if node.denest else "", (node.left, node.right)
        case _:
            return "", (node.child,)
