"""Per-key ordered columns: carry-forward, neighbours, lowest value.

A key is one window group, which streams or spills; after copies are removed a
key has at most one row per order value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its last non-NULL value at or before the row."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def neighbours(
    df: DataFrame,
    key: str,
    order: str,
    previous: Mapping[str, str],
    following: Mapping[str, str],
) -> DataFrame:
    """Add ``{new name: column}`` of the preceding and of the following row."""
    in_order = Window.partitionBy(key).orderBy(order)
    columns = {new: F.lag(c).over(in_order) for new, c in previous.items()}
    columns |= {new: F.lead(c).over(in_order) for new, c in following.items()}
    return df.withColumns(columns)


def second_copy(key: str, order: str) -> Column:
    """Whether a row is the second with its key and order value; further ones are not."""
    in_order = Window.partitionBy(key).orderBy(order)
    same = [F.coalesce(F.lag(order, n).over(in_order) == F.col(order), F.lit(False)) for n in (1, 2)]
    return same[0] & ~same[1]


def lowest(df: DataFrame, key: str, order: str, values: Mapping[str, Column]) -> DataFrame:
    """Add ``{new name: value}``, the key's lowest, to each of its rows."""
    whole_key = (
        Window.partitionBy(key)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return df.withColumns({name: F.min(v).over(whole_key) for name, v in values.items()})


# Ranks of infinity and above, in the order of doubles, apart without the last bit too.
_INFINITY = 2047 << 52
_NAN, _MISSING = _INFINITY + 2, _INFINITY + 4


def double_rank(value: Column) -> Column:
    """A long that sorts like the double: -inf, numbers, inf, NaN, NULL; both zeros are 0.

    It counts the doubles between zero and the value, as its bits would. All steps are
    exact: powers of two are, and so are products and quotients with them.
    """
    size = F.abs(value)
    # The logarithm may miss the next power of two by rounding, then the quotient tells.
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022))
    scaled = size / F.pow(F.lit(2.0), F.least(guess, F.lit(1023)))
    step = F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    exponent = F.least(guess, F.lit(1023)) + step
    part = F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled) - 1
    ordinary = (exponent + 1023) * (1 << 52) + (part * float(1 << 52)).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    rank = F.when(size == float("inf"), _INFINITY).when(size < 2.0**-1022, tiny).otherwise(ordinary)
    signed = F.when(value < 0, -rank).otherwise(rank)
    return F.when(value.isNull(), _MISSING).when(F.isnan(value), _NAN).otherwise(signed).cast("long")


def packed_report(order: Column, balance: Column) -> Column:
    """(order, balance) as one decimal that sorts like them: NULL order first, NULL balance last.

    A minimum of decimals is kept in a hash table, one of structs needs sorted rows. Any
    long keeps its place; balances keep theirs but for the last bit: the 38 digits of a
    decimal hold 64 bits of the order and 63 of the balance, so two balances that are
    neighbours among doubles can tie.
    """
    rank = F.shiftright(double_rank(balance), 1).cast("decimal(19,0)")
    place = order.cast("decimal(19,0)") * F.lit(Decimal(2**63))
    return F.coalesce(place, F.lit(Decimal(-9 * 10**37))) + rank
