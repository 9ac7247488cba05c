"""Ranges of coordinates and how they are cut into tiles."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """A box of integer coordinates, lower bounds in, upper bounds out, numbered row by row."""

    lower: tuple[int, ...]
    upper: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.lower) != len(self.upper) or any(b < a for a, b in zip(self.lower, self.upper)):
            raise ValueError(f"no range: {self.lower} to {self.upper}")

    @classmethod
    def of(cls, *extents: int) -> Range:
        return cls((0,) * len(extents), tuple(extents))

    @property
    def rank(self) -> int:
        return len(self.lower)

    @property
    def extents(self) -> tuple[int, ...]:
        return tuple(b - a for a, b in zip(self.lower, self.upper))

    @property
    def volume(self) -> int:
        return math.prod(self.extents)

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(math.prod(self.extents[k + 1 :]) for k in range(self.rank))

    def includes(self, index: Sequence[int]) -> bool:
        return len(index) == self.rank and all(a <= i < b for a, i, b in zip(self.lower, index, self.upper))

    def ordinal(self, index: Sequence[int]) -> int:
        if not self.includes(index):
            raise IndexError(f"{tuple(index)} is outside {self}")
        return sum((i - a) * s for i, a, s in zip(index, self.lower, self.strides))

    def index(self, ordinal: int) -> tuple[int, ...]:
        if not 0 <= ordinal < self.volume:
            raise IndexError(f"{ordinal} is outside {self}")
        out = []
        for a, s in zip(self.lower, self.strides):
            out.append(a + ordinal // s)
            ordinal %= s
        return tuple(out)

    def __iter__(self) -> Iterator[tuple[int, ...]]:
        return (self.index(k) for k in range(self.volume))

    def shift(self, by: Sequence[int]) -> Range:
        return Range(tuple(a + d for a, d in zip(self.lower, by)), tuple(b + d for b, d in zip(self.upper, by)))

    def permute(self, order: Sequence[int]) -> Range:
        """Mode k of the result is mode order[k]."""
        return Range(tuple(self.lower[k] for k in order), tuple(self.upper[k] for k in order))

    def congruent(self, other: Range) -> bool:
        return self.extents == other.extents

    def overlap(self, other: Range) -> Range | None:
        low, high = tuple(map(max, self.lower, other.lower)), tuple(map(min, self.upper, other.upper))
        return Range(low, high) if all(a < b for a, b in zip(low, high)) else None


@dataclass(frozen=True)
class Tiling:
    """One mode cut at n + 1 marks into n tiles; no marks at all is an empty mode."""

    marks: tuple[int, ...]

    def __post_init__(self) -> None:
        if any(b <= a for a, b in zip(self.marks, self.marks[1:])):
            raise ValueError(f"marks do not ascend: {self.marks}")

    @classmethod
    def uniform(cls, extent: int | tuple[int, int], target: int) -> Tiling:
        """ceil(extent / target) tiles, of which the first (extent mod tiles) have one element more."""
        low, high = (0, extent) if isinstance(extent, int) else extent
        size = high - low
        if size == 0:
            return cls(())
        tiles = -(-size // target)
        base, more = divmod(size, tiles)
        marks = [low]
        for k in range(tiles):
            marks.append(marks[-1] + base + (k < more))
        return cls(tuple(marks))

    @classmethod
    def every(cls, extent: int, size: int) -> Tiling:
        """Tiles of one size, of which the last may be shorter: element i is in tile i // size."""
        return cls((*range(0, extent, size), extent) if extent else ())

    @classmethod
    def whole(cls, extent: int) -> Tiling:
        return cls((0, extent) if extent else ())

    @property
    def lower(self) -> int:
        return self.marks[0] if self.marks else 0

    @property
    def upper(self) -> int:
        return self.marks[-1] if self.marks else 0

    @property
    def extent(self) -> int:
        return self.upper - self.lower

    @property
    def tiles(self) -> int:
        return max(0, len(self.marks) - 1)

    def tile(self, k: int) -> tuple[int, int]:
        if not 0 <= k < self.tiles:
            raise IndexError(f"no tile {k} of {self.tiles}")
        return self.marks[k], self.marks[k + 1]

    def tile_of(self, i: int) -> int:
        if not self.lower <= i < self.upper:
            raise IndexError(f"{i} is outside {self.lower} to {self.upper}")
        return bisect.bisect_right(self.marks, i) - 1

    def sizes(self) -> tuple[int, ...]:
        return tuple(b - a for a, b in zip(self.marks, self.marks[1:]))

    def shift(self, by: int) -> Tiling:
        return Tiling(tuple(m + by for m in self.marks))

    def concat(self, other: Tiling) -> Tiling:
        """The other's tile sizes after these."""
        marks = list(self.marks or other.marks[:1])
        for size in other.sizes():
            marks.append(marks[-1] + size)
        return Tiling(tuple(marks))

    def congruent(self, other: Tiling) -> bool:
        return self.sizes() == other.sizes()

    def block(self, first: int, last: int) -> Tiling:
        """Tiles first to last - 1."""
        if not 0 <= first < last <= self.tiles:
            raise IndexError(f"no tiles {first} to {last} of {self.tiles}")
        return Tiling(self.marks[first : last + 1])

    def tile_column(self, i: Column) -> Column:
        """The tile of a coordinate, as an expression: closed form for uniform tilings, a search of the marks else.

        No lambdas: they stay out of generated code, and filters that Spark infers from them across self-joins are wrong.
        """
        n = self.tiles
        if n <= 1:
            return F.lit(0)
        sizes = self.sizes()
        if all(s == sizes[0] for s in sizes[:-1]) and sizes[-1] <= sizes[0]:
            return F.floor((i - F.lit(self.lower)) / F.lit(sizes[0])).cast("int")
        big = sum(s == sizes[0] for s in sizes)
        if sizes[:big] == (sizes[0],) * big and all(s == sizes[0] - 1 for s in sizes[big:]):
            x = i - F.lit(self.lower)
            head = big * sizes[0]
            first = F.floor(x / F.lit(sizes[0]))
            return first.cast("int") if big == n else F.when(x < head, first).otherwise(F.floor((x - head) / F.lit(sizes[0] - 1)) + big).cast("int")
        return _searched(i, self.marks[1:-1], 0) if n <= SEARCHED_TILES else _ranked(i, self.marks[1:-1])

    def size_column(self, tile: Column) -> Column:
        """The number of elements of a tile, as an expression."""
        sizes = self.sizes()
        if len(set(sizes)) == 1:
            return F.lit(sizes[0])
        return F.element_at(F.array(*[F.lit(s) for s in sizes]), tile + 1)


#: Up to this many tiles a coordinate's tile is found by nested comparisons, beyond it among sorted marks.
SEARCHED_TILES = 128


def _searched(i: Column, marks: Sequence[int], before: int) -> Column:
    """How many marks are at most i, and before: halves of the marks, compared in turn."""
    if not marks:
        return F.lit(before)
    middle = len(marks) // 2
    return F.when(i < F.lit(marks[middle]), _searched(i, marks[:middle], before)).otherwise(_searched(i, marks[middle + 1 :], before + middle + 1))


def _ranked(i: Column, marks: Sequence[int]) -> Column:
    """The same by the place that i takes among the marks; doubled, with i in the gaps, none are equal."""
    place = (2 * i + 1).cast("bigint")
    doubled = F.array(*[F.lit(2 * m).cast("bigint") for m in marks])
    return (F.array_position(F.sort_array(F.array_append(doubled, place)), place) - 1).cast("int")


@dataclass(frozen=True)
class TiledRange:
    modes: tuple[Tiling, ...]

    @classmethod
    def uniform(cls, extents: Sequence[int], target: int | Sequence[int]) -> TiledRange:
        sizes = [target] * len(extents) if isinstance(target, int) else target
        return cls(tuple(Tiling.uniform(e, t) for e, t in zip(extents, sizes)))

    @classmethod
    def whole(cls, extents: Sequence[int]) -> TiledRange:
        return cls(tuple(Tiling.whole(e) for e in extents))

    @property
    def rank(self) -> int:
        return len(self.modes)

    @property
    def elements(self) -> Range:
        return Range(tuple(m.lower for m in self.modes), tuple(m.upper for m in self.modes))

    @property
    def tiles(self) -> Range:
        return Range.of(*(m.tiles for m in self.modes))

    def tile_range(self, tile: Sequence[int]) -> Range:
        spans = [m.tile(k) for m, k in zip(self.modes, tile)]
        return Range(tuple(a for a, _ in spans), tuple(b for _, b in spans))

    def tile_of(self, index: Sequence[int]) -> tuple[int, ...]:
        return tuple(m.tile_of(i) for m, i in zip(self.modes, index))

    def permute(self, order: Sequence[int]) -> TiledRange:
        return TiledRange(tuple(self.modes[k] for k in order))

    def shift(self, by: Sequence[int]) -> TiledRange:
        return TiledRange(tuple(m.shift(d) for m, d in zip(self.modes, by)))

    def congruent(self, other: TiledRange) -> bool:
        return len(self.modes) == len(other.modes) and all(a.congruent(b) for a, b in zip(self.modes, other.modes))
