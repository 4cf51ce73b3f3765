"""Wrapping 32-bit and fixed-point arithmetic as column expressions.

Spark raises on overflow under ANSI rules, so 32-bit words live in 64-bit
columns and are masked; the one multiplier whose products leave 63 bits is
applied in two halves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
FRACTION = 16
ONE = 1 << FRACTION

# Multipliers of the 32-bit mixer and the step of its counter.
MIX_A = 0x7FEB352D
MIX_B = 0x846CA68B
GOLDEN = 0x9E3779B9


def long(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32))


def i32(x: Column) -> Column:
    """The low 32 bits as a signed number."""
    low = u32(x)
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def mul32(x: Column, m: int) -> Column:
    """x * m mod 2**32 for 0 <= x < 2**32."""
    high = u32(x * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF))
    return u32(F.shiftleft(high, 16) + x * F.lit(m & 0xFFFF))


def _xor_down(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, bits))


def mix32(x: Column) -> Column:
    """A 32-bit integer hash."""
    x = u32(long(x))
    x = mul32(_xor_down(x, 16), MIX_A)
    x = mul32(_xor_down(x, 15), MIX_B)
    return _xor_down(x, 16)


def splitmix32(seed: Column | int, i: Column) -> Column:
    """The i-th draw (from 1) of a counter generator."""
    return mix32(u32(long(seed) + mul32(u32(long(i)), GOLDEN)))


def rand_between(seed: Column | int, i: Column, low: int, high: int) -> Column:
    return splitmix32(seed, i) % (high - low + 1) + low


def fp_mul(a: Column, b: Column) -> Column:
    """Q16.16 product, rounded down."""
    return F.shiftright(a * b, FRACTION)


def isqrt(x: int) -> int:
    return math.isqrt(x)


def inv_sqrt_q16(d: int) -> int:
    """1 / floor(sqrt(d)) in Q16.16."""
    return ONE // max(1, math.isqrt(d)) if d > 0 else ONE


def exp_q16(x: Column) -> Column:
    """Four-term series of exp over [-8, 0] in Q16.16, floored at zero. It is far from exp below -1."""
    x = F.greatest(F.least(x, F.lit(0).cast("long")), F.lit(-8 * ONE).cast("long"))
    x2 = fp_mul(x, x)
    x3 = fp_mul(x2, x)
    x4 = fp_mul(x3, x)
    y = F.lit(ONE) + x + fp_mul(F.lit(ONE // 2), x2) + fp_mul(F.lit(ONE // 6), x3) + fp_mul(F.lit(ONE // 24), x4)
    return F.greatest(y, F.lit(0).cast("long"))


def i32_array(x):
    """``i32`` of a numpy array."""
    return ((x + (1 << 31)) & MASK32) - (1 << 31)


def exp_q16_array(x):
    """``exp_q16`` of a numpy array."""
    x = x.clip(-8 * ONE, 0)
    x2 = (x * x) >> FRACTION
    x3 = (x2 * x) >> FRACTION
    x4 = (x3 * x) >> FRACTION
    y = ONE + x + ((ONE // 2 * x2) >> FRACTION) + ((ONE // 6 * x3) >> FRACTION) + ((ONE // 24 * x4) >> FRACTION)
    return y.clip(0)


def xorshift_step(x: Column) -> Column:
    """One step of the 64-bit xorshift generator whose middle shift takes the complement."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(F.bitwise_not(x), 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))
