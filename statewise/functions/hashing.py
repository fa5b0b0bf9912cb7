"""Counter-based draws: a draw depends on its labels only, so any partitioning
and any retry of a lost task gives the same numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15  # 60 bits, the most that fits a signed 64-bit integer
UNIT = float(16**HEX_DIGITS)


def _label(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[_label(p) for p in parts]))


def _bits(hexa: Column, digits: int = HEX_DIGITS) -> Column:
    return F.conv(F.substring(hexa, 1, digits), 16, 10).cast("bigint")


def draw(modulus, *parts) -> Column:
    """Uniform integer in [0, modulus)."""
    return _bits(digest(*parts)) % modulus


def uniform(*parts) -> Column:
    """Uniform double in (0, 1)."""
    return (_bits(digest(*parts)) + 0.5) / UNIT


def normal(*parts) -> Column:
    """Standard normal draw by Box-Muller from two labelled uniforms."""
    radius = F.sqrt(-2 * F.log(uniform(*parts, "a")))
    return radius * F.cos(2 * math.pi * uniform(*parts, "b"))


def sign_draw(*parts) -> Column:
    """+1 or -1 with equal chance."""
    return 1 - 2 * draw(2, *parts)


def replicates(count: int, start: int = 0) -> Column:
    """Array of replicate numbers, for ``explode``."""
    return F.sequence(F.lit(start), F.lit(start + count - 1)).cast("array<bigint>")
