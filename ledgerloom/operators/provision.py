"""Stages, observed default probabilities, expected-loss provision, movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import calendar_label, exact_sum, percent, ratio
from ledgerloom.spec import ACTIVE, DEFAULT, STAGE_1, STAGE_2, STAGE_3, PanelSpec


def stage(spec: PanelSpec) -> Column:
    """Stage of a fact row. An unknown loan-to-value, or a payoff, is not risk."""
    return (
        F.when(F.col("status_code") == DEFAULT, STAGE_3)
        .when(F.col("current_ltv") > spec.stage2_ltv, STAGE_2)
        .otherwise(STAGE_1)
    )


def stage_cells(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Loans and exact exposure per period, stage and score band."""
    return fact.groupBy("period", stage(spec).alias("ifrs9_stage"), "credit_score_band").agg(
        F.count("*").alias("loans"),
        exact_sum(F.col("current_balance"), spec.money_type).alias("exposure"),
    )


def stage_distribution(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    cells = fact.groupBy("period", stage(spec).alias("ifrs9_stage")).agg(
        F.count("*").alias("loans"),
        exact_sum(F.col("current_balance"), spec.money_type).cast("double").alias("exposure"),
    )
    return cells.withColumn("reporting_quarter", calendar_label(F.col("period"), spec))


def pd_lifetime(dim: DataFrame, event: DataFrame) -> DataFrame:
    """Share of each score band's entities that ever defaulted.

    An entity has at most one event, so both sides are counted per band first
    and two small tables meet, not two entity-sized ones.
    """
    entities = dim.groupBy("credit_score_band").agg(F.count("*").alias("entities"))
    defaults = event.groupBy("credit_score_band").agg(F.count("*").alias("defaults"))
    share = ratio(F.coalesce(F.col("defaults"), F.lit(0)), F.col("entities"))
    return entities.join(defaults, "credit_score_band", "left").select(
        "credit_score_band", share.alias("pd_lifetime")
    )


def pd_horizon(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Share of active rows whose entity defaults within the horizon.

    Filled rows and rows whose horizon runs past the data are in the
    denominator, and the event period has no lower bound.
    """
    within = F.col("default_period") <= F.col("period") + spec.pd_horizon
    return (
        fact.where(F.col("status_code") == ACTIVE)
        .groupBy("credit_score_band")
        .agg(ratio(F.count_if(within), F.count("*")).alias("pd_12m"))
    )


def provision(dim: DataFrame, fact: DataFrame, event: DataFrame, spec: PanelSpec) -> DataFrame:
    """Exposure times default probability times loss, per period, stage and band."""
    # One row per score band: as many as the spec has bands, plus unknown.
    rates = F.broadcast(
        pd_lifetime(dim, event).join(pd_horizon(fact, spec), "credit_score_band", "left")
    )
    probability = (
        F.when(F.col("ifrs9_stage") == STAGE_1, F.col("pd_12m"))
        .when(F.col("ifrs9_stage") == STAGE_2, F.col("pd_lifetime"))
        .otherwise(F.lit(1.0))
    )
    loss = F.lit(float(spec.loss_given_default))
    exposure, provided = F.col("exposure"), F.col("provision")
    return (
        stage_cells(fact, spec)
        .join(rates, "credit_score_band", "left")
        .withColumn("exposure", exposure.cast("double"))
        .withColumn("probability_of_default", probability)
        .withColumn("provision", exposure * F.col("probability_of_default") * loss)
        .select(
            "period",
            calendar_label(F.col("period"), spec).alias("reporting_quarter"),
            "ifrs9_stage",
            "credit_score_band",
            "loans",
            "exposure",
            "probability_of_default",
            loss.alias("loss_given_default_assumed"),
            "provision",
            percent(provided, exposure).alias("coverage_ratio_pct"),
        )
    )


def provision_movement(provisions: DataFrame, spec: PanelSpec) -> DataFrame:
    """Opening, charge, release and closing provision per period.

    Reads the provision report. A period has at most stages x bands cells; they
    are added in a fixed order, so the sum of doubles is the same on every run.
    """
    in_cell_order = F.array_sort(
        F.collect_list(
            F.when(
                F.col("provision").isNotNull(),
                F.struct("ifrs9_stage", "credit_score_band", "provision"),
            )
        )
    )
    added = F.aggregate(
        in_cell_order, F.lit(0.0), lambda total, cell: total + cell["provision"]
    )
    by_period = provisions.groupBy("period").agg(
        F.when(F.count("provision") > 0, added).alias("closing_provision"),
        exact_sum(F.col("exposure"), spec.money_type).cast("double").alias("exposure"),
    )
    opening = F.coalesce(F.lag("closing_provision").over(Window.orderBy("period")), F.lit(0.0))
    closing, start = F.col("closing_provision"), F.col("opening_provision")
    increase = F.greatest(closing - start, F.lit(0.0))
    decrease = F.greatest(start - closing, F.lit(0.0))
    return by_period.withColumn("opening_provision", opening).select(
        "period",
        calendar_label(F.col("period"), spec).alias("reporting_quarter"),
        "opening_provision",
        increase.alias("increase"),
        decrease.alias("decrease"),
        "closing_provision",
        (closing - start).alias("net_movement"),
        "exposure",
        percent(closing, F.col("exposure")).alias("coverage_ratio_pct"),
        F.round(start + increase - decrease - closing, 6).alias("reconciliation_error"),
    )


def stage2_share(provisions: DataFrame, spec: PanelSpec) -> DataFrame:
    """Share of each period's exposure in Stage 2; NULL without any."""
    exposure = F.col("exposure")
    in_stage_2 = F.when(F.col("ifrs9_stage") == STAGE_2, exposure)
    return provisions.groupBy("period").agg(
        percent(
            exact_sum(in_stage_2, spec.money_type), exact_sum(exposure, spec.money_type)
        ).alias("stage2_share_pct")
    )
