"""Portfolio summary, segment performance and status mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import calendar_label, growth_percent, percent, ratio
from ledgerloom.operators.segments import long_segments
from ledgerloom.spec import (
    ACTIVE,
    DEFAULT,
    PAYOFF,
    SEGMENT_DIMENSIONS,
    STATUS_DIMENSIONS,
    PanelSpec,
)


def with_exact_balance(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Balances as decimals: cast once a row, before rows are repeated per dimension."""
    return fact.withColumn("current_balance", F.col("current_balance").cast(spec.money_type))


def balance_where(code: int) -> Column:
    """Exact balance in one status; NULL when no row has it."""
    return F.sum(F.when(F.col("status_code") == code, F.col("current_balance")))


def loans_where(code: int) -> Column:
    return F.count_if(F.col("status_code") == code)


def _double(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def portfolio_summary(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Size, exits, growth and flow default rate, one row per period.

    The ordered window runs after aggregation, over one row per period.
    """
    by_period = with_exact_balance(fact, spec).groupBy("period").agg(
        balance_where(ACTIVE).cast("double").alias("active_balance"),
        loans_where(ACTIVE).alias("active_loans"),
        balance_where(DEFAULT).cast("double").alias("defaulted_balance"),
        loans_where(DEFAULT).alias("defaults"),
        balance_where(PAYOFF).cast("double").alias("paid_off_balance"),
        loans_where(PAYOFF).alias("payoffs"),
        F.count_if("is_forward_filled").alias("forward_filled_rows"),
        F.max("unemployment_rate").alias("unemployment_rate"),
        F.max("house_price_index").alias("house_price_index"),
    )
    in_order = Window.orderBy("period")
    active = F.col("active_balance")
    prior = F.lag("active_balance").over(in_order)
    return by_period.select(
        "period",
        calendar_label(F.col("period"), spec).alias("reporting_quarter"),
        "active_balance",
        "active_loans",
        ratio(active, F.col("active_loans")).alias("average_balance"),
        "defaults",
        "defaulted_balance",
        "payoffs",
        "paid_off_balance",
        "forward_filled_rows",
        "unemployment_rate",
        "house_price_index",
        prior.alias("prior_active_balance"),
        (active - prior).alias("balance_movement"),
        growth_percent(active, prior).alias("balance_growth_pct"),
        percent(F.col("defaults"), F.lag("active_loans").over(in_order)).alias(
            "quarterly_default_rate_pct"
        ),
    )


def segment_cells(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Exact totals per dimension value and period, money still decimal."""
    rows = long_segments(
        with_exact_balance(fact, spec),
        ["period", "status_code", "current_balance"],
        SEGMENT_DIMENSIONS,
    )
    return rows.groupBy("segment_type", "segment_value", "period").agg(
        balance_where(ACTIVE).alias("active_balance"),
        loans_where(ACTIVE).alias("active_loans"),
        loans_where(DEFAULT).alias("defaults"),
        balance_where(DEFAULT).alias("defaulted_balance"),
    )


def segment_performance(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Size, share, growth and default rate of every segment and period."""
    whole_dimension = Window.partitionBy("segment_type", "period")
    in_order = Window.partitionBy("segment_type", "segment_value").orderBy("period")
    active = F.col("active_balance")
    prior = F.lag("active_balance").over(in_order)
    return (
        segment_cells(fact, spec)
        .withColumn("dimension_balance", F.sum("active_balance").over(whole_dimension))
        .withColumns(
            {
                c: F.col(c).cast("double")
                for c in ("active_balance", "defaulted_balance", "dimension_balance")
            }
        )
        .select(
            "segment_type",
            "segment_value",
            "period",
            calendar_label(F.col("period"), spec).alias("reporting_quarter"),
            "active_balance",
            "active_loans",
            "defaults",
            "defaulted_balance",
            ratio(active, F.col("active_loans")).alias("average_balance"),
            percent(active, F.col("dimension_balance")).alias("pct_of_portfolio_balance"),
            prior.alias("prior_active_balance"),
            growth_percent(active, prior).alias("balance_growth_pct"),
            percent(F.col("defaults"), F.lag("active_loans").over(in_order)).alias(
                "quarterly_default_rate_pct"
            ),
        )
    )


def status_mix(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Loans and balance by status, with shares, per segment and period."""
    rows = long_segments(
        with_exact_balance(fact, spec),
        ["period", "status_bucket", "current_balance"],
        STATUS_DIMENSIONS,
        total=True,
    )
    cells = rows.groupBy("segment_type", "segment_value", "period", "status_bucket").agg(
        F.count("*").alias("loans"), F.sum("current_balance").alias("balance")
    )
    segment = Window.partitionBy("segment_type", "segment_value", "period")
    return cells.select(
        "segment_type",
        "segment_value",
        "period",
        calendar_label(F.col("period"), spec).alias("reporting_quarter"),
        "status_bucket",
        "loans",
        _double("balance"),
        percent(F.col("loans"), F.sum("loans").over(segment)).alias("pct_of_segment_loans"),
        percent(F.col("balance"), F.sum("balance").over(segment)).alias(
            "pct_of_segment_balance"
        ),
    )
