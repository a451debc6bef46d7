"""Names for values within one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once per row, not once per mention: a lambda's body would compute it anew for each element.

    The value is the state of a fold over nothing, as that isn't copied; what a transform makes is copied whole, with all that is nested in it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda state, _: state, use)


def once(value: Column) -> Column:
    """value for a select, behind a generator: neither projections nor filters above it are merged with its expression, so it's computed once per row."""
    return F.explode(F.array(value))
