"""Wavelet lifting on array columns.

A line is an array, a plane an array of lines: lifting along x works inside each line and lifting along
y works on whole lines, so neither direction moves a row. Neighbours past an end mirror (whole-sample
symmetry): an index is clamped into the band, which is the same thing for one step of lifting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.let import let

#: Lifting steps and scale of the 9/7 filter.
A1, A2, A3, A4 = 1.586134342, 0.05298011854, -0.8829110762, -0.4435068522
K = 1.230174104914


class Line:
    """Elements are numbers."""

    @staticmethod
    def step(own: Column, left: Column, right: Column, f: Callable) -> Column:
        return f(own, left, right)

    @staticmethod
    def scaled(own: Column, factor: float) -> Column:
        return own * factor


class Rows:
    """Elements are lines, handled sample by sample."""

    @staticmethod
    def step(own: Column, left: Column, right: Column, f: Callable) -> Column:
        pair = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.zip_with(own, pair, lambda x, p: f(x, p["a"], p["b"]))

    @staticmethod
    def scaled(own: Column, factor: float) -> Column:
        return F.transform(own, lambda x: x * factor)


def _even(kind, low: Column, high: Column, f: Callable) -> Column:
    """Each low element with the high ones on both sides."""
    last = F.size(high) - 1
    new = F.transform(low, lambda x, i: kind.step(x, high[F.greatest(F.least(i - 1, last), F.lit(0))], high[F.least(i, last)], f))
    return F.when(F.size(high) == 0, low).otherwise(new)


def _odd(kind, low: Column, high: Column, f: Callable) -> Column:
    last = F.size(low) - 1
    return F.transform(high, lambda x, i: kind.step(x, low[i], low[F.least(i + 1, last)], f))


def _interleave(low: Column, high: Column) -> Column:
    pairs = F.flatten(F.transform(high, lambda x, i: F.array(low[i], x)))
    return F.when(F.size(low) > F.size(high), F.concat(pairs, F.slice(low, -1, 1))).otherwise(pairs)


def _split(line: Column) -> tuple[Column, Column]:
    """The low band (ceil n/2 elements) and the high band of a line of quadrant order."""
    half = F.floor((F.size(line) + 1) / 2).cast("int")
    return F.slice(line, F.lit(1), half), F.slice(line, half + 1, F.size(line) - half)


def inverse53(line: Column, kind=Line) -> Column:
    """Samples of a line whose first half is the low band: integers, exact."""

    def low_up(a, l, r):  # noqa: E741
        return a - F.shiftright(l + r + 2, 2)

    def high_up(a, l, r):  # noqa: E741
        return a + F.shiftright(l + r, 1)

    def both(x: Column) -> Column:
        low, high = _split(x)
        return let(high, lambda h: let(_even(kind, low, h, low_up), lambda e: let(_odd(kind, e, h, high_up), lambda o: _interleave(e, o))))

    return let(line, both)


def forward53(line: Column, kind=Line) -> Column:
    """The reverse: the low band, then the high band."""

    def both(x: Column) -> Column:
        evens = F.filter(x, lambda _, i: i % 2 == 0)
        odds = F.filter(x, lambda _, i: i % 2 == 1)
        return let(evens, lambda e: let(_odd(kind, e, odds, lambda a, l, r: a - F.shiftright(l + r, 1)), lambda o: F.concat(_even(kind, e, o, lambda a, l, r: a + F.shiftright(l + r + 2, 2)), o)))

    return let(line, both)


def inverse97(line: Column, kind=Line) -> Column:
    """Samples of a line of doubles whose first half is the low band."""

    def both(x: Column) -> Column:
        low, high = _split(x)
        single = F.size(x) == 1
        low = F.transform(low, lambda v: kind.scaled(v, K))
        high = F.transform(high, lambda v: kind.scaled(v, 1 / K))

        def lift(a: float):
            return lambda v, l, r: v + a * (l + r)

        def steps(e: Column, o: Column) -> Column:
            return let(_even(kind, e, o, lift(A4)), lambda e1: let(_odd(kind, e1, o, lift(A3)), lambda o1: let(_even(kind, e1, o1, lift(A2)), lambda e2: let(_odd(kind, e2, o1, lift(A1)), lambda o2: _interleave(e2, o2)))))

        return F.when(single, x).otherwise(let(low, lambda e: let(high, lambda o: steps(e, o))))

    return let(line, both)


def inverse_plane(plane: Column, line_filter: Callable = inverse53) -> Column:
    """One level of a plane in quadrant order: columns first, then rows."""
    return F.transform(line_filter(plane, Rows), lambda row: line_filter(row))


def forward_plane(plane: Column) -> Column:
    return forward53(F.transform(plane, lambda row: forward53(row)), Rows)


def inverse_levels(planes: DataFrame, column: str, levels: int, line_filter: Callable = inverse53) -> DataFrame:
    """All levels of a plane column, the smallest first; sizes halve upwards (ceil), odd ones too.

    Each level is a projection of its own: nested in one expression, the lambdas would exhaust the analyzer.
    """
    for level in reversed(range(levels)):
        planes = planes.withColumn(column, _one_level(F.col(column), 1 << level, line_filter))
    return planes


def _one_level(plane: Column, scale: int, line_filter: Callable) -> Column:
    """The corner of ceil(size / scale) inverted, the rest of the plane as it is."""

    def one(p: Column) -> Column:
        height = F.floor((F.size(p) + scale - 1) / scale).cast("int")
        width = F.floor((F.size(p[0]) + scale - 1) / scale).cast("int")
        corner = F.transform(F.slice(p, F.lit(1), height), lambda r: F.slice(r, F.lit(1), width))

        def merged(done: Column) -> Column:
            return F.transform(p, lambda r, y: F.when(y < height, F.concat(done[F.least(y, height - 1)], F.slice(r, width + 1, F.size(r) - width))).otherwise(r))

        return let(inverse_plane(corner, line_filter), merged)

    return let(plane, one)
