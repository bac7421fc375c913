"""Arithmetic on numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles from here on have no digits left to round.
WHOLE = 2.0**52


def rounded_to(value: Column, digits: int) -> Column:
    """``value`` at ``digits`` decimals, halves away from zero, as SQL engines round a double.

    Spark's own ``round`` writes every double out as decimal text and reads it back, which
    costs more than all other algebra of a wide row. NaN, infinities and values that no
    longer have such digits are kept.
    """
    scale = 10.0**digits
    large = value.cast("double") * scale
    whole = F.when(large < 0, F.ceil(large - 0.5)).otherwise(F.floor(large + 0.5))
    return F.when(F.abs(large) < WHOLE, whole.cast("double") / scale).otherwise(value.cast("double"))
