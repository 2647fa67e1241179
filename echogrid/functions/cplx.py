"""Complex arithmetic on columns: a complex value is a pair of double columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Complex(NamedTuple):
    re: Column
    im: Column

    def times(self, other: Complex) -> Complex:
        return Complex(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)

    def plus(self, other: Complex) -> Complex:
        return Complex(self.re + other.re, self.im + other.im)

    def scaled(self, factor: Column | float) -> Complex:
        return Complex(self.re * factor, self.im * factor)

    def conj(self) -> Complex:
        return Complex(self.re, -self.im)

    def abs(self) -> Column:
        return F.hypot(self.re, self.im)

    def power(self) -> Column:
        return self.re * self.re + self.im * self.im

    def arg(self) -> Column:
        return F.atan2(self.im, self.re)


def polar(radius: Column, angle: Column) -> Complex:
    return Complex(radius * F.cos(angle), radius * F.sin(angle))


def mag_phase(magnitude: Column, code: Column) -> Complex:
    """A 16-bit magnitude with a 16-bit phase code, a full turn being 65536."""
    return polar(magnitude.cast("double"), code.cast("double") * F.lit(2.0 / 65536) * F.pi())
