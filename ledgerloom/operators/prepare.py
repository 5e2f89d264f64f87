"""Panel preparation: one entity table, one gap-filled fact, one event table.

Attribute rows are cut to their distinct variants on the map side, and so are
copies of an entity-period unless every entity is known to be small; after that
an entity holds at most one row per period. All per-entity work on the fact
(carry-forward, neighbours, first default) shares one hash layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ordered
from ledgerloom.functions.columns import (
    banded,
    calendar_label,
    calendar_quarter,
    calendar_year,
    labelled,
    status_bucket,
    whole,
)
from ledgerloom.spec import (
    CONDOMINIUM,
    DEFAULT,
    INVESTOR,
    OTHER_PROPERTY,
    OWNER_OCCUPIED,
    PLANNED_URBAN,
    SINGLE_FAMILY,
    PanelSpec,
)

MEASURES = (
    "balance_time",
    "LTV_time",
    "interest_rate_time",
    "status_time",
    "default_time",
    "payoff_time",
)

ATTRIBUTES = (
    "orig_time",
    "first_time",
    "mat_time",
    "FICO_orig_time",
    "LTV_orig_time",
    "balance_orig_time",
    "Interest_Rate_orig_time",
    "investor_orig_time",
    "REtype_CO_orig_time",
    "REtype_PU_orig_time",
    "REtype_SF_orig_time",
)
# An entity is inconsistent when one of these takes more than one value.
CHECKED_ATTRIBUTES = ("orig_time", "FICO_orig_time", "LTV_orig_time", "balance_orig_time")

# Published columns. The working tables carry a few more.
DIM_COLUMNS = (
    "loan_id",
    "orig_time",
    "first_time",
    "mat_time",
    "original_term_quarters",
    "origination_vintage",
    "credit_score",
    "original_ltv",
    "original_balance",
    "original_interest_rate",
    "property_type",
    "occupancy",
    "credit_score_band",
    "ltv_band",
    "observed_from_origination",
    "focus_cohort",
)
FACT_COLUMNS = (
    "loan_id",
    "period",
    "reporting_quarter",
    "quarters_on_book",
    "current_balance",
    "current_ltv",
    "current_ltv_band",
    "current_interest_rate",
    "status_code",
    "status_bucket",
    "default_time",
    "payoff_time",
    "is_forward_filled",
    "house_price_index",
    "gdp_growth",
    "unemployment_rate",
    "origination_vintage",
    "credit_score_band",
    "ltv_band",
    "property_type",
    "occupancy",
    "focus_cohort",
    "observed_from_origination",
)
# Computed in the same pass as the fact and kept beside it, so that reports on
# neighbouring rows need no further shuffle by entity.
LINK_COLUMNS = (
    "prior_balance",
    "prior_status",
    "repeats_period",
    "opens_gap",
    "gap_periods",
    "moves_next",
    "next_status",
    "default_period",
    "credit_score",
    "original_balance",
)
EVENT_COLUMNS = (
    "loan_id",
    "default_period",
    "default_quarter",
    "quarters_on_book_at_default",
    "exposure_at_default",
    "ltv_at_default",
    "ltv_band_at_default",
    "original_balance",
    "credit_score",
    "credit_score_band",
    "ltv_band",
    "origination_vintage",
    "property_type",
    "occupancy",
    "focus_cohort",
    "house_price_index",
    "unemployment_rate",
)


def published(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Public columns of a working table."""
    return df.select(*columns)


def dedupe(panel: DataFrame) -> DataFrame:
    """One row per entity-period: the lowest balance, NULL balances last.

    Ties are broken by the remaining measures, so rows that still tie are equal.
    Spark cuts each group to one row per task before the shuffle
    (``WindowGroupLimit``), so a heavily copied key does not pile up.
    Rows without an entity or a period have no place in the panel and drop out first,
    so they form no group.
    """
    rows = panel.where("id IS NOT NULL AND time IS NOT NULL").select(
        F.col("id").alias("loan_id"), F.col("time").alias("period"), *MEASURES
    )
    copies = Window.partitionBy("loan_id", "period").orderBy(
        *[F.col(c).asc_nulls_last() for c in MEASURES]
    )
    return (
        rows.withColumn("copy", F.row_number().over(copies))
        .where(F.col("copy") == 1)
        .drop("copy")
    )


def entity_attributes(panel: DataFrame) -> DataFrame:
    """Earliest non-NULL value of each origination attribute, per entity.

    Attributes are nearly constant, so the first aggregation leaves about one
    row per entity in every task, in a hash table: its only minimum is a decimal.
    Earliest means lowest (period, balance), the same order that ``dedupe`` keeps; a
    tie goes to the smaller value.
    """
    variants = panel.groupBy("id", *ATTRIBUTES).agg(
        F.min(ordered.packed_report(F.col("time"), F.col("balance_time"))).alias("seen"),
        F.count("*").alias("rows"),
        F.count("time").alias("placed"),
    )

    def earliest(attribute: str) -> Column:
        candidate = F.struct("seen", attribute)
        return F.min(F.when(F.col(attribute).isNotNull(), candidate))[attribute].alias(attribute)

    differs = F.lit(False)
    for attribute in CHECKED_ATTRIBUTES:
        differs = differs | F.coalesce(F.min(attribute) != F.max(attribute), F.lit(False))
    return variants.groupBy("id").agg(
        *[earliest(a) for a in ATTRIBUTES],
        differs.alias("is_inconsistent"),
        F.sum("rows").alias("source_rows"),
        F.sum("placed").alias("placed_rows"),
    )


def dim_rows(attributes: DataFrame, spec: PanelSpec) -> DataFrame:
    """Decoded entity table (``DIM_COLUMNS`` and what is known of its source)."""
    origination = F.col("orig_time")
    return attributes.select(
        F.col("id").alias("loan_id"),
        "orig_time",
        "first_time",
        "mat_time",
        (F.col("mat_time") - origination).alias("original_term_quarters"),
        calendar_label(origination, spec).alias("origination_vintage"),
        F.col("FICO_orig_time").alias("credit_score"),
        F.col("LTV_orig_time").alias("original_ltv"),
        F.col("balance_orig_time").alias("original_balance"),
        F.col("Interest_Rate_orig_time").alias("original_interest_rate"),
        labelled(
            (
                (F.col("REtype_SF_orig_time") == 1, SINGLE_FAMILY),
                (F.col("REtype_PU_orig_time") == 1, PLANNED_URBAN),
                (F.col("REtype_CO_orig_time") == 1, CONDOMINIUM),
            ),
            F.lit(OTHER_PROPERTY),
        ).alias("property_type"),
        labelled(
            ((F.col("investor_orig_time") == 1, INVESTOR),), F.lit(OWNER_OCCUPIED)
        ).alias("occupancy"),
        banded(F.col("FICO_orig_time"), spec.score_bands).alias("credit_score_band"),
        banded(whole(F.col("LTV_orig_time")), spec.ltv_bands).alias("ltv_band"),
        (origination >= spec.first_observable_origination).alias("observed_from_origination"),
        labelled(
            ((origination == period, tag) for period, tag in spec.focus_cohorts),
            F.lit(None).cast("string"),
        ).alias("focus_cohort"),
        "is_inconsistent",
        "source_rows",
        "placed_rows",
    )


def macro_rows(panel: DataFrame) -> DataFrame:
    """Period-level covariates, one row per reported period."""
    return panel.groupBy(F.col("time").alias("period")).agg(
        F.max("hpi_time").alias("house_price_index"),
        F.max("gdp_time").alias("gdp_growth"),
        F.max("uer_time").alias("unemployment_rate"),
    )


def linked_rows(kept: DataFrame) -> DataFrame:
    """Carry measures forward and attach each row's neighbours.

    Every measure takes its last non-NULL value at or before the row. On top of
    that: ``next_period`` and ``next_status`` of the following report,
    ``prior_balance`` and ``prior_status`` of the preceding one, ``repeats_period`` if
    that has the same period, the entity's ``default_period``, and ``first_gap``, the report before its first gap.
    """
    carried = ordered.carry_forward(kept, "loan_id", "period", MEASURES)
    linked = ordered.neighbours(
        carried,
        "loan_id",
        "period",
        previous={"prior_balance": "balance_time", "prior_status": "status_time"},
        following={"next_period": "period", "next_status": "status_time"},
    )
    linked = linked.withColumn("repeats_period", ordered.second_copy("loan_id", "period"))
    first_default = F.when(F.col("status_time") == DEFAULT, F.col("period"))
    before_gap = F.when(F.col("next_period") > F.col("period") + 1, F.col("period"))
    return ordered.lowest(
        linked, "loan_id", "period", {"default_period": first_default, "first_gap": before_gap}
    )


# Periods that are held at once while a gap is filled.
STRETCH = 4096


def gap_filled(linked: DataFrame) -> DataFrame:
    """Repeat each report over the missing periods that follow it, flagged.

    Replaces a spine of all periods joined to the reports: each report knows
    the next one, so the rows in between need no join and no shuffle. A gap is filled
    stretch by stretch: a row holds the starts of its stretches, then the periods of
    one, so a gap of n periods takes n / ``STRETCH`` + ``STRETCH`` numbers of memory.
    ``gap_periods``, on reports, says how many periods were missing after them.
    """
    last = F.col("last_period")
    rows = linked.withColumns(
        {
            "reported_period": F.col("period"),
            "last_period": F.coalesce(F.col("next_period") - 1, F.col("period")),
        }
    )
    stretches = F.explode(F.sequence(F.col("period"), last, F.lit(STRETCH).cast("long")))
    # Near the largest long a full stretch would not fit.
    stop = F.when(last - F.col("first_period") < STRETCH, last).otherwise(F.col("first_period") + (STRETCH - 1))
    filled = rows.withColumn("first_period", stretches).withColumn(
        "period", F.explode(F.sequence(F.col("first_period"), stop))
    )
    is_filled = F.col("period") != F.col("reported_period")
    # The row before a filled row is its own copy, and a filled row is never
    # one end of a reported transition.
    return filled.withColumns(
        {
            "is_forward_filled": is_filled,
            "prior_balance": F.when(is_filled, F.col("balance_time")).otherwise(
                F.col("prior_balance")
            ),
            "prior_status": F.when(is_filled, F.col("status_time")).otherwise(
                F.col("prior_status")
            ),
            "repeats_period": ~is_filled & F.col("repeats_period"),
            "opens_gap": F.coalesce(
                is_filled & (F.col("period") == F.col("first_gap") + 1), F.lit(False)
            ),
            "gap_periods": F.when(~is_filled, last - F.col("reported_period")),
            "moves_next": ~is_filled
            & F.coalesce(F.col("next_period") == F.col("period") + 1, F.lit(False)),
        }
    ).drop("reported_period", "last_period", "first_period", "next_period", "first_gap")


def fact_rows(linked: DataFrame, dim: DataFrame, macro: DataFrame, spec: PanelSpec) -> DataFrame:
    """The panel fact: ``FACT_COLUMNS`` plus ``LINK_COLUMNS``.

    The entity join runs before gaps are filled, on the window's hash layout.
    The planner decides by size whether the period table is broadcast.
    """
    attributes = dim.select(
        "loan_id",
        "orig_time",
        "origination_vintage",
        "credit_score_band",
        "ltv_band",
        "property_type",
        "occupancy",
        "focus_cohort",
        "observed_from_origination",
        "credit_score",
        "original_balance",
    )
    rows = gap_filled(linked.join(attributes, "loan_id")).join(macro, "period", "left")
    period, ltv, status = F.col("period"), F.col("LTV_time"), F.col("status_time")
    return rows.withColumns(
        {
            "reporting_quarter": calendar_label(period, spec),
            "quarters_on_book": period - F.col("orig_time"),
            "current_ltv_band": banded(whole(ltv), spec.ltv_bands),
            "status_bucket": status_bucket(status),
        }
    ).withColumnsRenamed(
        {
            "balance_time": "current_balance",
            "LTV_time": "current_ltv",
            "interest_rate_time": "current_interest_rate",
            "status_time": "status_code",
        }
    ).select(*FACT_COLUMNS, *LINK_COLUMNS)


def event_rows(fact: DataFrame) -> DataFrame:
    """First default of each entity, with its state at that moment.

    The first default period is already on every fact row, so this is a filter.
    """
    return fact.where(F.col("period") == F.col("default_period")).withColumnsRenamed(
        {
            "reporting_quarter": "default_quarter",
            "quarters_on_book": "quarters_on_book_at_default",
            "current_balance": "exposure_at_default",
            "current_ltv": "ltv_at_default",
            "current_ltv_band": "ltv_band_at_default",
        }
    ).select(*EVENT_COLUMNS, "observed_from_origination")


def period_rows(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Period dimension. Year and quarter come from the period, not its label."""
    period = F.col("period")
    return fact.select("period").distinct().select(
        "period",
        calendar_label(period, spec).alias("reporting_quarter"),
        calendar_year(period, spec).alias("year"),
        calendar_quarter(period, spec).alias("quarter"),
    )
