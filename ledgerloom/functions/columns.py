"""Column expressions: banding, calendar labels, ratios and text formats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.spec import STATUS_LABELS, UNKNOWN, PanelSpec


def labelled(pairs: Iterable[tuple[Column, str]], default: Column) -> Column:
    """First label whose condition holds, else ``default``."""
    result = None
    for condition, label in pairs:
        result = F.when(condition, label) if result is None else result.when(condition, label)
    return default if result is None else result.otherwise(default)


def banded(value: Column, bands: Iterable[tuple[int, int, str]]) -> Column:
    """Named band of an integer value; gaps, overflow and NULL are unknown."""
    return labelled(
        ((value.between(low, high), label) for low, high, label in bands), F.lit(UNKNOWN)
    )


def whole(value: Column) -> Column:
    """Nearest whole number, ties to even. A plain cast would truncate."""
    return F.rint(value.cast("double")).cast("long")


def status_bucket(code: Column) -> Column:
    return labelled(
        ((code == value, label) for value, label in STATUS_LABELS.items()), F.lit(UNKNOWN)
    )


def _quarter_number(period: Column, spec: PanelSpec) -> Column:
    year, quarter = spec.calendar_anchor
    return F.lit(year * 4 + quarter - 2).cast("long") + period


def calendar_year(period: Column, spec: PanelSpec) -> Column:
    if spec.calendar_anchor is None:
        return F.lit(None).cast("int")
    return F.floor(_quarter_number(period, spec) / 4).cast("int")


def calendar_quarter(period: Column, spec: PanelSpec) -> Column:
    if spec.calendar_anchor is None:
        return F.lit(None).cast("int")
    return (F.pmod(_quarter_number(period, spec), F.lit(4)) + 1).cast("int")


def calendar_label(period: Column, spec: PanelSpec) -> Column:
    """``2006Q4`` with an anchor, ``P27`` without one."""
    if spec.calendar_anchor is None:
        return F.concat(F.lit("P"), period.cast("string"))
    return F.concat(
        calendar_year(period, spec).cast("string"),
        F.lit("Q"),
        calendar_quarter(period, spec).cast("string"),
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in double; NULL, not an error, when the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return (F.lit(100.0) * numerator.cast("double")) / F.nullif(
        denominator.cast("double"), F.lit(0.0)
    )


def growth_percent(current: Column, prior: Column) -> Column:
    return F.lit(100.0) * (ratio(current, prior) - F.lit(1.0))


def exact_sum(value: Column, decimal_type) -> Column:
    """Sum that does not depend on row order; the caller casts it to double."""
    return F.sum(value.cast(decimal_type))


def exact_mean(value: Column, decimal_type) -> Column:
    return ratio(exact_sum(value, decimal_type), F.count(value))


def rounded(value: Column, digits: int) -> Column:
    """Round the scaled double half away from zero, then scale back."""
    scale = float(10**digits)
    return F.round(value * F.lit(scale), 0) / F.lit(scale)


# --- text -------------------------------------------------------------------


def fixed_point(value: Column, digits: int) -> Column:
    """Digits after the point without thousands separators.

    ``format_number`` rounds the exact binary value, like C's printf;
    ``format_string`` would round the shortest decimal form instead.
    """
    return F.translate(F.format_number(value.cast("double"), digits), ",", "")


def grouped(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(value.cast("long"), 0)


def money_text(value: Column) -> Column:
    """``$1.25bn`` / ``$3.40m`` / ``$7.00k`` / ``$12``; NULL reads ``n/a``."""
    amount = value.cast("double")
    text = F.when(amount.isNull(), F.lit("n/a"))
    for unit, size in (("bn", 1e9), ("m", 1e6), ("k", 1e3)):
        text = text.when(
            F.abs(amount) >= size,
            F.concat(F.lit("$"), fixed_point(amount / F.lit(size), 2), F.lit(unit)),
        )
    return text.otherwise(F.concat(F.lit("$"), fixed_point(amount, 0)))


def moved(value: Column) -> Column:
    return F.when(value > 0, "rose").otherwise("fell")
