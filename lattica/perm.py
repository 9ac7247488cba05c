"""Permutations in image form, their groups, and canonical coordinates under symmetry."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from math import factorial
from typing import TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class Permutation:
    """images[k] is where k goes."""

    images: tuple[int, ...]

    def __post_init__(self) -> None:
        if sorted(self.images) != list(range(len(self.images))):
            raise ValueError(f"no permutation: {self.images}")

    @classmethod
    def identity(cls, n: int) -> Permutation:
        return cls(tuple(range(n)))

    @classmethod
    def from_cycles(cls, n: int, *cycles: Sequence[int]) -> Permutation:
        images = list(range(n))
        for c in cycles:
            for a, b in zip(c, (*c[1:], c[0])):
                images[a] = b
        return cls(tuple(images))

    def __len__(self) -> int:
        return len(self.images)

    def __getitem__(self, k: int) -> int:
        return self.images[k]

    def __mul__(self, other: Permutation) -> Permutation:
        """First this, then the other."""
        return Permutation(tuple(other.images[k] for k in self.images))

    def inverse(self) -> Permutation:
        out = [0] * len(self.images)
        for k, image in enumerate(self.images):
            out[image] = k
        return Permutation(tuple(out))

    def __pow__(self, n: int) -> Permutation:
        base, out = (self if n >= 0 else self.inverse()), Permutation.identity(len(self))
        for _ in range(abs(n)):
            out = out * base
        return out

    def is_identity(self) -> bool:
        return self.images == tuple(range(len(self.images)))

    def cycles(self) -> list[tuple[int, ...]]:
        """Of two elements or more, each from its smallest on."""
        seen, out = set(), []
        for k in range(len(self.images)):
            if k not in seen:
                cycle, x = [], k
                while x not in seen:
                    seen.add(x)
                    cycle.append(x)
                    x = self.images[x]
                if len(cycle) > 1:
                    out.append(tuple(cycle))
        return out

    def parity(self) -> int:
        return (-1) ** sum(len(c) - 1 for c in self.cycles())

    def apply(self, items: Sequence[T]) -> tuple[T, ...]:
        """The item at k goes to images[k]."""
        if len(items) != len(self.images):
            raise ValueError("lengths differ")
        out = list(items)
        for k, x in enumerate(items):
            out[self.images[k]] = x
        return tuple(out)


@dataclass(frozen=True)
class NestedPermutation:
    """Of outer and inner modes."""

    outer: Permutation
    inner: Permutation

    def inverse(self) -> NestedPermutation:
        return NestedPermutation(self.outer.inverse(), self.inner.inverse())

    def __mul__(self, other: NestedPermutation) -> NestedPermutation:
        return NestedPermutation(self.outer * other.outer, self.inner * other.inner)


class Group:
    """The group that some permutations generate."""

    def __init__(self, generators: Iterable[Permutation], degree: int | None = None):
        self.generators = tuple(generators)
        degree = degree if degree is not None else max((len(g) for g in self.generators), default=0)
        found = {Permutation.identity(degree)}
        new = list(found)
        while new:
            new = [p for p in {a * g for a in new for g in self.generators} if p not in found]
            found.update(new)
        self.elements = tuple(sorted(found, key=lambda p: p.images))

    @classmethod
    def symmetric(cls, n: int) -> Group:
        return cls([Permutation.from_cycles(n, (k, k + 1)) for k in range(n - 1)], n)

    @property
    def order(self) -> int:
        return len(self.elements)

    def domain(self) -> set[int]:
        """What some element moves."""
        return {k for p in self.elements for k in range(len(p)) if p[k] != k}

    def __contains__(self, p: Permutation) -> bool:
        return p in set(self.elements)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Group) and self.elements == other.elements

    def __hash__(self) -> int:
        return hash(self.elements)

    def conjugate(self, by: Permutation) -> Group:
        return Group([by.inverse() * g * by for g in self.elements], len(by))

    def intersect(self, other: Group) -> Group:
        return Group([p for p in self.elements if p in other], len(self.elements[0]))

    def stabilizer(self, points: Iterable[int]) -> Group:
        fixed = set(points)
        return Group([p for p in self.elements if all(p[k] == k for k in fixed)], len(self.elements[0]))

    def smallest(self, index: Sequence[int]) -> tuple[int, ...]:
        """The lexicographically smallest rearrangement of an index under the group."""
        return min(p.apply(index) for p in self.elements)

    def is_symmetric(self) -> bool:
        return self.order == factorial(len(self.domain()) or 1)


class Representation:
    """A factor for each element of a group, from factors of generators; they must agree where products meet."""

    def __init__(self, factors: dict[Permutation, float]):
        degree = max(map(len, factors), default=0)
        found: dict[Permutation, float] = {Permutation.identity(degree): 1}
        new = dict(found)
        while new:
            made: dict[Permutation, float] = {}
            for a, x in new.items():
                for g, y in factors.items():
                    p, z = a * g, x * y
                    if found.get(p, made.get(p, z)) != z:
                        raise ValueError(f"two factors for {p.images}")
                    if p not in found:
                        made[p] = z
            found |= made
            new = made
        self.factors = found

    @classmethod
    def antisymmetric(cls, n: int) -> Representation:
        return cls({Permutation.from_cycles(n, (k, k + 1)): -1 for k in range(n - 1)})


class Irrep:
    """A partition of n, which names an irreducible representation of the symmetric group."""

    def __init__(self, parts: Sequence[int]):
        self.parts = tuple(parts)
        if any(p <= 0 for p in parts) or any(a < b for a, b in zip(parts, parts[1:])):
            raise ValueError(f"no partition: {parts}")

    @property
    def degree(self) -> int:
        return sum(self.parts)

    def dimension(self) -> int:
        """By hook lengths."""
        columns = [sum(p > c for p in self.parts) for c in range(self.parts[0] if self.parts else 0)]
        hooks = 1
        for r, p in enumerate(self.parts):
            for c in range(p):
                hooks *= (p - c) + (columns[c] - r) - 1
        return factorial(self.degree) // hooks
