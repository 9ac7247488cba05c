"""Real and complex values as columns: v, or re and im."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REAL, COMPLEX = ("v",), ("re", "im")


class Value:
    """A real (im is None) or complex column value."""

    def __init__(self, re: Column, im: Column | None = None):
        self.re, self.im = re, im

    @classmethod
    def of(cls, columns: tuple[str, ...], prefix: str = "") -> Value:
        return cls(*(F.col(prefix + c) for c in columns))

    def _pair(self) -> tuple[Column, Column]:
        return self.re, self.im if self.im is not None else F.lit(0.0)

    def __mul__(self, other: Value | complex) -> Value:
        if not isinstance(other, Value):
            if isinstance(other, complex):
                other = Value(F.lit(other.real), F.lit(other.imag))
            else:
                return Value(self.re * other, self.im * other if self.im is not None else None)
        if self.im is None and other.im is None:
            return Value(self.re * other.re)
        (a, b), (c, d) = self._pair(), other._pair()
        return Value(a * c - b * d, a * d + b * c)

    def conj(self) -> Value:
        return self if self.im is None else Value(self.re, -self.im)

    def abs(self) -> Column:
        return F.abs(self.re) if self.im is None else F.sqrt(self.squared())

    def squared(self) -> Column:
        return self.re * self.re if self.im is None else self.re * self.re + self.im * self.im

    def named(self) -> list[Column]:
        return [self.re.alias("v")] if self.im is None else [self.re.alias("re"), self.im.alias("im")]
