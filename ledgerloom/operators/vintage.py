"""Cohort curves indexed on age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import exact_sum, percent
from ledgerloom.spec import PanelSpec


def vintage_curves(
    dim: DataFrame, fact: DataFrame, event: DataFrame, spec: PanelSpec
) -> DataFrame:
    """Cumulative defaults of each origination cohort by quarters on book.

    Only cohorts observed from origination, and only ages from zero on. The
    three inputs are aggregated to cohort or cohort-age before they meet.
    """
    cohort = (
        dim.where("observed_from_origination")
        .groupBy("origination_vintage")
        .agg(
            F.count("*").alias("cohort_loans"),
            exact_sum(F.col("original_balance"), spec.money_type).alias("cohort_original_balance"),
        )
    )
    # The fact is unique on entity and period, and age is the period less a
    # constant of the entity, so counting rows counts distinct entities.
    observed = (
        fact.where(F.col("observed_from_origination") & (F.col("quarters_on_book") >= 0))
        .groupBy("origination_vintage", "quarters_on_book")
        .agg(F.count("*").alias("loans_observed"))
    )
    defaulted = (
        event.where(
            F.col("observed_from_origination") & (F.col("quarters_on_book_at_default") >= 0)
        )
        .groupBy(
            "origination_vintage",
            F.col("quarters_on_book_at_default").alias("quarters_on_book"),
        )
        .agg(
            F.count("*").alias("defaults_in_quarter"),
            exact_sum(F.col("original_balance"), spec.money_type).alias("defaulted_balance"),
        )
    )
    to_age = (
        Window.partitionBy("origination_vintage")
        .orderBy("quarters_on_book")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    in_quarter = F.coalesce(F.col("defaults_in_quarter"), F.lit(0))
    cumulative = F.sum(in_quarter).over(to_age)
    cumulative_balance = F.coalesce(F.sum("defaulted_balance").over(to_age), F.lit(0))
    return (
        observed.join(cohort, "origination_vintage")
        .join(defaulted, ["origination_vintage", "quarters_on_book"], "left")
        .select(
            "origination_vintage",
            "quarters_on_book",
            "cohort_loans",
            F.col("cohort_original_balance").cast("double").alias("cohort_original_balance"),
            "loans_observed",
            percent(F.col("loans_observed"), F.col("cohort_loans")).alias(
                "pct_cohort_still_observed"
            ),
            in_quarter.alias("defaults_in_quarter"),
            cumulative.alias("cumulative_defaults"),
            percent(cumulative, F.col("cohort_loans")).alias("cumulative_default_rate_pct"),
            percent(cumulative_balance, F.col("cohort_original_balance")).alias(
                "cumulative_default_rate_by_balance_pct"
            ),
        )
    )
