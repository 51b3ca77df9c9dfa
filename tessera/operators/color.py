"""Level shifts, colour transforms and packed pixels, as projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.let import let

#: Weights of red and blue in luma, and the range of the chroma planes.
WEIGHT_R, WEIGHT_B = 0.299, 0.114
WEIGHT_G = 1 - WEIGHT_R - WEIGHT_B


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def shift_down(v: Column, bits: int = 8) -> Column:
    """Unsigned samples centred on zero."""
    return v - (1 << (bits - 1))


def shift_up(v: Column, bits: int = 8, signed: bool = False) -> Column:
    """The reverse, clamped to the samples' range; signed samples are only clamped."""
    if signed:
        return clamp(v, -(1 << (bits - 1)), (1 << (bits - 1)) - 1)
    return clamp(v + (1 << (bits - 1)), 0, (1 << bits) - 1)


def reversible(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Integer luma and chroma (y, u, v)."""
    return F.shiftright(r + 2 * g + b, 2), b - g, r - g


def inverse_reversible(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    g = y - F.shiftright(u + v, 2)
    return v + g, g, u + g


def irreversible(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luma and chroma with the weights above; chroma spans the same range as luma."""
    y = WEIGHT_R * r + WEIGHT_G * g + WEIGHT_B * b
    return y, (b - y) * (0.5 / (1 - WEIGHT_B)), (r - y) * (0.5 / (1 - WEIGHT_R))


def inverse_irreversible(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb


def whole(v: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(v + 0.5).cast("int")


def pack(b: Column, g: Column, r: Column, a: Column | int = 0) -> Column:
    """One 32-bit pixel as an unsigned LONG: blue lowest."""
    a = F.lit(a) if isinstance(a, int) else a
    out = b.cast("long")
    for k, part in enumerate((g, r, a), 1):
        out = out.bitwiseOR(F.shiftleft(part.cast("long"), 8 * k))
    return out


def part(pixel: Column, k: int) -> Column:
    """Byte k of a packed pixel, the lowest first."""
    return F.shiftright(pixel, 8 * k).bitwiseAND(255)


def packed_extreme(a: Column, b: Column, greatest: bool) -> Column:
    """Byte by byte maximum or minimum of two packed pixels."""
    pick = F.greatest if greatest else F.least
    return pack(*[pick(part(a, k), part(b, k)) for k in range(4)])


def pack_scaled(r: Column, g: Column, b: Column, a: Column, scale: float = 255.0) -> Column:
    """Float RGBA scaled, cut at 0 and 255 and packed."""
    return pack(*[F.least(F.greatest(F.floor(v * scale), F.lit(0)), F.lit(255)) for v in (b, g, r, a)])


def median3x3(plane: Column) -> Column:
    """Median of each sample's 3 by 3 neighbourhood in a plane (array of lines); edges repeat the edge sample."""

    def filtered(p: Column) -> Column:
        bottom = F.size(p) - 1

        def line(row: Column, y: Column) -> Column:
            rows = [p[F.greatest(y - 1, F.lit(0))], row, p[F.least(y + 1, bottom)]]
            right = F.size(row) - 1

            def sample(_: Column, x: Column) -> Column:
                xs = [F.greatest(x - 1, F.lit(0)), x, F.least(x + 1, right)]
                return F.array_sort(F.array(*[r[i] for r in rows for i in xs]))[4]

            return F.transform(row, sample)

        return F.transform(p, line)

    return let(plane, filtered)
