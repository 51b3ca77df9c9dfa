"""Step sizes, bit-plane counts and dequantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest magnitude and the sign bit of a decoded coefficient: sign and magnitude, not two's complement.
MAGNITUDE, SIGN = 0x7FFFFFFF, -0x80000000


def subband_gain(orient: Column) -> Column:
    """0 for LL, 1 for HL and LH, 2 for HH."""
    return F.bit_count(orient)


def step_size(expn: Column, mant: Column) -> Column:
    """(1 + mant / 2**11) / 2**expn of a quantised subband."""
    return (1 + mant / 2048.0) / F.pow(F.lit(2.0), expn)


def derived_exponent(first: Column, levels: Column, dec_lvl: Column) -> Column:
    """Exponent of a subband when only LL's is given."""
    return first - levels + dec_lvl


def mag_bits(reversible: Column, expn: Column, first: Column, levels: Column, dec_lvl: Column, guard: Column) -> Column:
    """Magnitude bit-planes of a subband: by its own exponent (5/3) or by the derived one (9/7)."""
    return F.when(reversible, expn + guard - 1).otherwise(derived_exponent(first, levels, dec_lvl) + guard - 1)


def significant_bits(planes: Column, zero_planes: Column) -> Column:
    return planes - zero_planes


def magnitude(v: Column) -> Column:
    return v.bitwiseAND(MAGNITUDE)


def lossless(v: Column, shift: Column) -> Column:
    """Magnitude shifted down with its sign: the coefficient of a reversibly coded subband."""
    m = F.call_function("shiftright", magnitude(v), shift)
    return F.when(v >= 0, m).otherwise(-m)


def lossy(v: Column, factor: Column) -> Column:
    """Signed magnitude times the subband's factor; no mid-point is added."""
    m = magnitude(v).cast("double")
    return F.when(v >= 0, m).otherwise(-m) * factor


def lossless_shift(planes: Column) -> Column:
    return 31 - planes


def lossy_factor(step: Column, bits: Column, orient: Column, planes: Column) -> Column:
    """Step scaled by the sample depth and the subband's gain, over the position of a coefficient's unit."""
    return step * F.pow(F.lit(2.0), bits + subband_gain(orient)) / F.pow(F.lit(2.0), 31 - planes)


#: The weight of a subband's distortion by decomposition level (1, 2, 3, 4 and more), for
#: LL, HL, LH, HH in turn.
REVERSIBLE_WEIGHTS = [[1.0, 0.1, 0.1, 0.05], [1.0, 0.2, 0.2, 0.1], [1.0, 0.4, 0.4, 0.2], [1.0, 0.8, 0.8, 0.4]]
IRREVERSIBLE_WEIGHTS = [[1.0, 0.01, 0.01, 0.005], [1.0, 0.2, 0.2, 0.1], [1.0, 0.4, 0.4, 0.2], [1.0, 0.8, 0.8, 0.4]]


def distortion_weight(reversible: Column, dec_lvl: Column, orient: Column, step: Column, width: Column, height: Column) -> Column:
    """What a unit of squared error in a code-block counts: its subband's weight, its step squared, over its samples."""
    tables = [F.array(*[F.array(*map(F.lit, row)) for row in table]) for table in (REVERSIBLE_WEIGHTS, IRREVERSIBLE_WEIGHTS)]
    table = F.when(reversible, tables[0]).otherwise(tables[1])
    return table[F.least(dec_lvl, F.lit(4)) - 1][orient] * step * step / (width * height).cast("double")


def coded_distortion(quantised: Column) -> Column:
    """By how much the passes over a sample lower a block's distortion: 4**p for each plane p in which it is significant.

    A block's is the sum over its samples, below zero as a running sum counts it.
    """
    planes = F.when(quantised == 0, 0).otherwise(F.length(F.bin(F.abs(quantised).cast("long"))))
    return -((F.pow(F.lit(4.0), planes) - 1) / 3)
