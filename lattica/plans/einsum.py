"""einsum over annotated tensors and over strings."""

from __future__ import annotations

from functools import reduce

from lattica import labels as L
from lattica.plans.nodes import Node, Product
from lattica.plans.planner import evaluate
from lattica.tensor import Tensor


def einsum(first: str | Node, *rest: Tensor | Node | str, denest: bool = False) -> Tensor:
    """``einsum("ij,jk->ik", A, B)``, of any number of operands, or ``einsum(A["i,j"], B["j,k"])`` and optionally a target ``"i,k"``.

    Without a target, a product keeps the labels that only one factor has (for three factors and more: the
    labels that one factor alone has). The order of three or more factors is chosen by their extents.
    """
    if isinstance(first, str):
        annotations, target = L.parse_einsum(first)
        if len(annotations) != len(rest):
            raise L.AnnotationError(f"{len(annotations)} operands in {first!r}, {len(rest)} given")
        nodes = [t[a] for a, t in zip(annotations, rest)]
    else:
        target = rest[-1] if rest and isinstance(rest[-1], str) else None
        nodes = [first, *(x for x in rest if not isinstance(x, str))]
    if target is None:
        outer = L.Labels(x for n in nodes for x in n.labels()[0] if sum(x in m.labels()[0] for m in nodes) == 1)
        inner = L.Labels() if denest else L.Labels(x for n in nodes for x in n.labels()[1] if sum(x in m.labels()[1] for m in nodes) == 1)
    else:
        outer, inner = L.parse(target)
    tree = nodes[0] if len(nodes) == 1 else reduce(lambda a, b: Product(a, b, denest=denest and len(nodes) == 2, free=len(nodes) > 2), nodes)
    return evaluate(tree, outer, inner)
