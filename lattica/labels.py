"""Annotations of tensor modes, einsum strings and the classes of products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class AnnotationError(ValueError):
    """A malformed annotation, or one that does not fit its tensor."""


class Labels:
    """An ordered list of mode labels with set algebra that keeps the order."""

    def __init__(self, names: Iterable[str] = ()):
        self.names = tuple(names)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def __contains__(self, name: object) -> bool:
        return name in self.names

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Labels) and self.names == other.names

    def __hash__(self) -> int:
        return hash(self.names)

    def __repr__(self) -> str:
        return f"Labels({','.join(self.names)!r})"

    def __and__(self, other: Labels) -> Labels:
        return Labels(x for x in self if x in other)

    def __or__(self, other: Labels) -> Labels:
        return Labels((*self, *(x for x in other if x not in self)))

    def __sub__(self, other: Labels) -> Labels:
        return Labels(x for x in self if x not in other)

    def __xor__(self, other: Labels) -> Labels:
        return (self - other) | (other - self)

    def __add__(self, other: Labels) -> Labels:
        return Labels((*self, *other))

    def sorted(self) -> Labels:
        return Labels(sorted(self.names))

    def unique(self) -> bool:
        return len(set(self.names)) == len(self.names)

    def same_set(self, other: Labels) -> bool:
        return len(self) == len(other) and set(self.names) == set(other.names)

    def position(self, name: str) -> int:
        return self.names.index(name)

    def permutation_to(self, other: Labels) -> tuple[int, ...]:
        """Where each of other's labels stands in this list."""
        if not self.same_set(other):
            raise AnnotationError(f"{self} is no permutation of {other}")
        return tuple(self.position(x) for x in other)


def parse(annotation: str) -> tuple[Labels, Labels]:
    """``"i,j;m,n"`` to outer and inner labels. Only spaces are stripped; an empty label is an error."""
    halves = annotation.replace(" ", "").split(";")
    if len(halves) > 2:
        raise AnnotationError(f"more than one ';' in {annotation!r}")
    found = []
    for half in halves:
        names = half.split(",") if half else []
        if any(not n for n in names) or (not half and len(halves) == 2):
            raise AnnotationError(f"empty label in {annotation!r}")
        found.append(Labels(names))
        if not found[-1].unique():
            raise AnnotationError(f"repeated label in {annotation!r}")
    outer, inner = found[0], found[1] if len(found) == 2 else Labels()
    if outer & inner:
        raise AnnotationError(f"a label is both outer and inner in {annotation!r}")
    return outer, inner


def write(outer: Labels, inner: Labels = Labels()) -> str:  # noqa: B008
    return ",".join(outer) + (";" + ",".join(inner) if len(inner) else "")


def dummy(outer: int, inner: int = 0) -> str:
    """An annotation for a tensor whose labels do not matter."""
    return write(Labels(f"i{k}" for k in range(outer)), Labels(f"n{k}" for k in range(inner)))


def parse_einsum(text: str) -> tuple[list[str], str | None]:
    """``"ij;m,jk;m->ik"``, a character for each label, to the operands' annotations and the result's (None if implicit)."""
    left, arrow, right = text.replace(" ", "").partition("->")

    def spread(part: str) -> str:
        outer, semicolon, inner = part.partition(";")
        return ",".join(outer) + (";" + ",".join(inner) if semicolon else "")

    operands = left.split(",")
    if not all(operands):
        raise AnnotationError(f"an operand without labels in {text!r}")
    return [spread(p) for p in operands], spread(right) if arrow else None


def implicit_target(a: Labels, b: Labels) -> Labels:
    """What a product keeps if nothing is said: the labels that only one factor has."""
    return a ^ b


HADAMARD, CONTRACTION, GENERAL, SCALE, INVALID = "hadamard", "contraction", "general", "scale", "invalid"


def product_class(a: Labels, b: Labels, target: Labels | None = None) -> str:
    """The class of a product, of which the target decides between contraction and general."""
    if not len(a) or not len(b):
        return SCALE
    target = target if target is not None else (a if a.same_set(b) else implicit_target(a, b))
    if any(x not in a and x not in b for x in target):
        return INVALID
    if a.same_set(b) and a.same_set(target):
        return HADAMARD
    if any(x not in target for x in a ^ b):
        return INVALID
    return GENERAL if len(a & b & target) else CONTRACTION
