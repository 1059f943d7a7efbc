"""The truncated moving average, in two forms that agree bit for bit on values that are not NULL.

Over the last n values, oldest first, the weight is 2 / (n + 1); the
accumulator starts at the oldest value and then folds every value, the oldest
one included. Both forms keep the same order of operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _step(weight: Column, value: Column, acc: Column) -> Column:
    return weight * value + (F.lit(1.0) - weight) * acc


def ema_of_columns(newest_first: Sequence[Column], count: Column, weight: Column) -> Column:
    """EMA of values held in columns; missing (older) ones are NULL.

    ``count`` is how many are present and ``weight`` is ``weight_of(count)``;
    with none the result is NULL. A missing value gets weight 0, which leaves
    the accumulator exactly as it is. So the fold needs no nested conditions:
    those would make the search for common subexpressions double with every
    further value.
    """
    oldest_first = list(reversed(newest_first))
    acc = F.coalesce(*oldest_first).cast("double") if len(oldest_first) > 1 else oldest_first[0]
    for age in range(len(newest_first), 0, -1):
        present = (count >= F.lit(age)).cast("double")
        value = F.coalesce(newest_first[age - 1], F.lit(0))
        acc = _step(weight * present, value, acc)
    return acc


def weight_of(count: Column) -> Column:
    return F.lit(2.0) / (count + F.lit(1))


def ema_of_array(values: Column) -> Column:
    """EMA of an array of values, oldest first; NULL for an empty array."""
    weight = weight_of(F.size(values))
    folded = F.aggregate(
        values,
        F.try_element_at(values, F.lit(1)).cast("double"),
        lambda acc, value: _step(weight, value, acc),
    )
    return F.when(F.size(values) > 0, folded)


def last_of_array(values: Column, n: int) -> Column:
    """The last n elements, or all of a shorter array."""
    return F.slice(values, F.greatest(F.size(values) - F.lit(n - 1), F.lit(1)), F.lit(n))
