"""Cohort comparisons and dashboard datasets, all over the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import (
    calendar_year,
    exact_mean,
    exact_sum,
    labelled,
    money_text,
    percent,
    ratio,
    rounded,
)
from ledgerloom.operators.quality import balance_rise, with_prior
from ledgerloom.spec import ACTIVE, STATUS_LABELS, UNKNOWN, PanelSpec

SCORE_DIMENSION = "Credit score band"
LTV_DIMENSION = "LTV band (at origination)"


# --- preparation reports ----------------------------------------------------


def band_distribution(dim: DataFrame, fact: DataFrame) -> DataFrame:
    """Entities per origination band and fact rows per current band."""
    entities = dim.unpivot(
        [], ["credit_score_band", "ltv_band"], "band_type", "band"
    )
    rows = fact.select(F.lit("current_ltv_band").alias("band_type"), F.col("current_ltv_band"))
    return (
        entities.groupBy("band_type", "band")
        .agg(F.count("*").alias("rows"))
        .unionAll(rows.groupBy("band_type", "current_ltv_band").agg(F.count("*")))
    )


def period_continuity(periods: DataFrame) -> DataFrame:
    return periods.agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count("*").alias("present"),
        (F.max("period") - F.min("period") + 1).alias("expected"),
        F.min_by("reporting_quarter", "period").alias("first_quarter"),
        F.max_by("reporting_quarter", "period").alias("last_quarter"),
    )


def focus_cohort_summary(dim: DataFrame, event: DataFrame, spec: PanelSpec) -> DataFrame:
    """Size, mean score and loan-to-value, and lifetime default of focus cohorts."""
    keys = ["focus_cohort", "origination_vintage"]
    cohorts = (
        dim.where(F.col("focus_cohort").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("loans"),
            rounded(ratio(F.sum("credit_score"), F.count("credit_score")), 0).alias("avg_score"),
            rounded(exact_mean(F.col("original_ltv"), spec.measure_type), 1).alias("avg_ltv"),
        )
    )
    return _lifetime_default(cohorts, event, keys)


def _lifetime_default(cohorts: DataFrame, event: DataFrame, keys: list[str]) -> DataFrame:
    # An entity has at most one event, and events carry the entity's labels, so
    # counting both sides first equals joining entities to events.
    events = (
        event.where(F.col("focus_cohort").isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("defaulted"))
    )
    defaulted = F.coalesce(F.col("defaulted"), F.lit(0))
    return (
        cohorts.join(events, keys, "left")
        .withColumn("lifetime_default_pct", rounded(percent(defaulted, F.col("loans")), 1))
        .drop("defaulted")
    )


def focus_exposure(event: DataFrame, spec: PanelSpec) -> DataFrame:
    """Exposure at default of the focus vintages, in millions."""
    age = F.col("quarters_on_book_at_default")
    exposure = exact_sum(F.col("exposure_at_default"), spec.money_type).cast("double")
    return (
        event.where(F.col("focus_cohort").isNotNull())
        .groupBy("origination_vintage")
        .agg(
            F.count("*").alias("defaults"),
            rounded(exposure / F.lit(1e6), 1).alias("exposure_at_default_m"),
            rounded(exact_mean(F.col("ltv_at_default"), spec.measure_type), 1).alias(
                "avg_ltv_at_default"
            ),
            rounded(ratio(F.sum(age), F.count(age)), 1).alias("avg_qob_at_default"),
        )
    )


# --- insights ---------------------------------------------------------------


def band_by_cohort(dim: DataFrame, event: DataFrame) -> DataFrame:
    """Lifetime default share by score band within each focus cohort."""
    keys = ["credit_score_band", "focus_cohort"]
    cohorts = (
        dim.where(F.col("focus_cohort").isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("loans"))
    )
    return _lifetime_default(cohorts, event, keys)


def collateral_by_ltv(loss: DataFrame) -> DataFrame:
    return loss.where(F.col("segment_type") == LTV_DIMENSION).select(
        F.col("segment_value").alias("orig_ltv_band"),
        "defaults",
        rounded(F.col("avg_ltv_at_default"), 1).alias("avg_ltv_at_default"),
        rounded(F.col("pct_underwater_at_default"), 1).alias("pct_underwater"),
    )


def equal_age(curves: DataFrame, benign: str, stressed: str, max_age: int = 32) -> DataFrame:
    """Two cohorts side by side at the same age, and how many times worse."""
    rate = F.col("cumulative_default_rate_by_balance_pct")

    def of(vintage: str):
        return F.max(F.when(F.col("origination_vintage") == vintage, rate))

    return (
        curves.where(
            F.col("origination_vintage").isin(benign, stressed)
            & (F.col("quarters_on_book") <= max_age)
        )
        .groupBy("quarters_on_book")
        .agg(of(benign).alias("benign"), of(stressed).alias("stressed"))
        .select(
            "quarters_on_book",
            rounded(F.col("benign"), 1).alias("benign_pct"),
            rounded(F.col("stressed"), 1).alias("stressed_pct"),
            rounded(ratio(F.col("stressed"), F.col("benign")), 1).alias("ratio"),
        )
    )


def time_to_default(
    event: DataFrame, curves: DataFrame, early_age: int = 8
) -> DataFrame:
    """Median and mean age at default, and how much of the loss came early."""
    age = F.col("quarters_on_book_at_default")
    ages = (
        event.where(F.col("focus_cohort").isNotNull())
        .groupBy("origination_vintage")
        .agg(
            F.count("*").alias("defaults"),
            rounded(F.median(age), 1).alias("median_age"),
            rounded(ratio(F.sum(age), F.count(age)), 1).alias("mean_age"),
        )
    )
    book_age = F.col("quarters_on_book")
    rate = "cumulative_default_rate_by_balance_pct"
    loss = curves.groupBy("origination_vintage").agg(
        F.max_by(rate, F.when(book_age <= early_age, book_age)).alias("early_rate"),
        F.max_by(rate, book_age).alias("final_rate"),
    )
    return ages.join(loss, "origination_vintage", "left").select(
        "origination_vintage",
        "defaults",
        "median_age",
        "mean_age",
        rounded(F.col("early_rate"), 1).alias("early_loss_pct"),
        rounded(percent(F.col("early_rate"), F.col("final_rate")), 0).alias(
            "early_share_of_loss_pct"
        ),
    )


def balance_rise_by_vintage(
    fact: DataFrame, spec: PanelSpec, groups: Sequence[tuple[int, int]]
) -> DataFrame:
    """Share of active rows whose balance rose, by group of origination years."""
    year = calendar_year(F.col("period") - F.col("quarters_on_book"), spec)
    group = labelled(
        ((year.between(low, high), f"{low}-{high}") for low, high in groups), F.lit("other")
    )
    rises = F.count_if(balance_rise(spec))
    return (
        with_prior(fact)
        .where(F.col("status_code") == ACTIVE)
        .groupBy(group.alias("vintage_group"))
        .agg(
            F.count("*").alias("active_rows"),
            rises.alias("rise_rows"),
            rounded(percent(rises, F.count("*")), 1).alias("pct_rows_with_rise"),
        )
    )


# --- dashboard datasets -----------------------------------------------------


def slicer_values(dim: DataFrame) -> DataFrame:
    """Distinct vintages and score bands, for pickers."""
    return dim.unpivot(
        [], ["origination_vintage", "credit_score_band"], "slicer", "value"
    ).distinct()


def headline(portfolio: DataFrame, movement: DataFrame, period: int | None = None) -> DataFrame:
    """Headline figures of one period, the latest by default."""
    chosen = F.lit(period) if period is not None else portfolio.agg(F.max("period")).scalar()
    coverage = movement.select("period", "coverage_ratio_pct")
    return (
        portfolio.where(F.col("period") == chosen)
        .join(coverage, "period", "left")
        .select(
            "period",
            "reporting_quarter",
            "active_balance",
            money_text(F.col("active_balance")).alias("active_balance_text"),
            "balance_growth_pct",
            "active_loans",
            F.coalesce("quarterly_default_rate_pct", F.lit(0.0)).alias(
                "quarterly_default_rate_pct"
            ),
            "defaults",
            "coverage_ratio_pct",
        )
    )


def segment_mix(
    segments: DataFrame, period: int | None = None, score_bands: Sequence[str] = ()
) -> DataFrame:
    """Segment figures of one period or all; bands narrow only their dimension."""
    rows = segments if period is None else segments.where(F.col("period") == period)
    if score_bands:
        rows = rows.where(
            (F.col("segment_type") != SCORE_DIMENSION)
            | F.col("segment_value").isin(*score_bands)
        )
    return rows.select(
        "period",
        "segment_type",
        "segment_value",
        "active_balance",
        "active_loans",
        "pct_of_portfolio_balance",
        "quarterly_default_rate_pct",
    )


def _column_name(prefix: str, label: str) -> str:
    return prefix + "".join(ch for ch in label.lower() if ch.isalpha())


def status_pivot(mix: DataFrame) -> DataFrame:
    """Portfolio balance by status, a column per status."""
    labels = [*STATUS_LABELS.values(), UNKNOWN]
    wide = (
        mix.where(F.col("segment_type") == "Portfolio")
        .groupBy("period", "reporting_quarter")
        .pivot("status_bucket", labels)
        .agg(F.max("balance"))
    )
    return wide.toDF("period", "reporting_quarter", *[_column_name("balance_", x) for x in labels])


def roll_matrix(rates: DataFrame, period: int | None = None) -> DataFrame:
    """Transition matrix by count, a column per destination status."""
    labels = [*STATUS_LABELS.values(), UNKNOWN]
    rows = rates if period is None else rates.where(F.col("from_period") == period)
    wide = (
        rows.groupBy("from_period", "from_status")
        .pivot("to_status", labels)
        .agg(F.max("roll_rate_pct_by_count"))
    )
    return wide.toDF("from_period", "from_status", *[_column_name("to_", x) for x in labels])


def vintage_pivot(
    curves: DataFrame, vintages: Sequence[str], min_observed_pct: float = 0.0
) -> DataFrame:
    """Cumulative default rate by balance, a column per chosen vintage."""
    wide = (
        curves.where(
            F.col("origination_vintage").isin(*vintages)
            & (F.col("pct_cohort_still_observed") >= min_observed_pct)
        )
        .groupBy("quarters_on_book")
        .pivot("origination_vintage", list(vintages))
        .agg(F.max("cumulative_default_rate_by_balance_pct"))
    )
    return wide.toDF("quarters_on_book", *[f"vintage_{v.lower()}" for v in vintages])


def focus_vintages(spec: PanelSpec) -> list[str]:
    """Labels of the focus cohorts, as they appear in reports."""
    year, quarter = spec.calendar_anchor or (0, 0)
    labels = []
    for period, _ in spec.focus_cohorts:
        number = year * 4 + quarter - 2 + period
        labels.append(
            f"P{period}" if spec.calendar_anchor is None else f"{number // 4}Q{number % 4 + 1}"
        )
    return labels
