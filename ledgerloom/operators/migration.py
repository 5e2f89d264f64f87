"""Roll rates: where loans in one status stand in the next period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import calendar_label, exact_sum, percent, status_bucket
from ledgerloom.spec import PanelSpec


def roll_rates(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Reported transitions between consecutive periods, by count and balance.

    The following report is already on the row, so this is one scan and one
    small aggregation instead of a self-join of the fact.
    """
    moves = fact.where("moves_next").select(
        F.col("period").alias("from_period"),
        F.col("status_bucket").alias("from_status"),
        status_bucket(F.col("next_status")).alias("to_status"),
        "current_balance",
    )
    return _rates(moves, spec)


def roll_rates_selfjoin(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """The same report by joining reported rows to those one period later."""
    reported = fact.where(~F.col("is_forward_filled"))
    here = reported.select(
        "loan_id",
        F.col("period").alias("from_period"),
        F.col("status_bucket").alias("from_status"),
        "current_balance",
    )
    later = reported.select(
        "loan_id",
        (F.col("period") - 1).alias("from_period"),
        F.col("status_bucket").alias("to_status"),
    )
    return _rates(here.join(later, ["loan_id", "from_period"]), spec)


def _rates(moves: DataFrame, spec: PanelSpec) -> DataFrame:
    cells = moves.groupBy("from_period", "from_status", "to_status").agg(
        F.count("*").alias("loans_moved"),
        exact_sum(F.col("current_balance"), spec.money_type).alias("balance_moved"),
    )
    origin = Window.partitionBy("from_period", "from_status")
    return cells.select(
        "from_period",
        calendar_label(F.col("from_period"), spec).alias("from_quarter"),
        "from_status",
        "to_status",
        "loans_moved",
        F.col("balance_moved").cast("double").alias("balance_moved"),
        percent(F.col("loans_moved"), F.sum("loans_moved").over(origin)).alias(
            "roll_rate_pct_by_count"
        ),
        percent(F.col("balance_moved"), F.sum("balance_moved").over(origin)).alias(
            "roll_rate_pct_by_balance"
        ),
    )
