"""Data-quality findings, score and register.

A finding is a rule name and a count of bad rows; zero passes. Rules over the
same table are one aggregation. Nothing here corrects anything.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import ordered
from ledgerloom.spec import (
    ACTIVE,
    DEFAULT,
    FAIL,
    INGEST_PHASE,
    INGEST_SEVERITY,
    OTHER_PROPERTY,
    PASS,
    PAYOFF,
    QUALITY_PHASE,
    RULE_SEVERITY,
    SEVERITY_WEIGHT,
    STATUS_LABELS,
    PanelSpec,
)

REGISTER_SCHEMA = T.StructType(
    [
        T.StructField("run_timestamp", T.TimestampNTZType()),
        T.StructField("phase", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("affected_rows", T.LongType()),
        T.StructField("detail", T.StringType()),
    ]
)

# Detail texts of the ingest findings.
DUPLICATE_DETAIL = "Duplicate loan-period rows in source; kept the lower balance of each pair"
INCONSISTENT_DETAIL = (
    "Loans whose origination attributes vary across their own rows; the value at the "
    "earliest period is used"
)
GAP_DETAIL = "Missing mid-panel periods forward-filled across %d loans; rows marked is_forward_filled"


def _severity(weights: dict[str, str], rule: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[rule]


def _outcome(affected: Column) -> Column:
    return F.when(affected == 0, PASS).otherwise(FAIL)


def _as_rows(one_row: DataFrame) -> DataFrame:
    """One-row table of counts to (rule_name, affected_rows)."""
    return one_row.unpivot([], one_row.columns, "rule_name", "affected_rows")


# --- ingest -----------------------------------------------------------------


def ingest_findings(panel: DataFrame, dim: DataFrame, fact: DataFrame) -> DataFrame:
    """What preparation found and corrected.

    Dropped copies are the source rows that name an entity and a period, less
    the reported fact rows, so no second grouping of the source is needed.
    """
    placed = panel.where(F.col("id").isNotNull() & F.col("time").isNotNull())
    before, after = GAP_DETAIL.split("%d")
    duplicate, gap = F.lit("duplicate_loan_period"), F.lit("panel_period_gap")
    gap_detail = F.concat(F.lit(before), F.col("filled_loans").cast("string"), F.lit(after))
    in_source = placed.agg(F.count("*").alias("affected_rows")).select(
        duplicate.alias("rule_name"), "affected_rows", F.lit(DUPLICATE_DETAIL).alias("detail")
    )
    # One scan of the fact, whose single row of counts becomes a row per rule. A loan
    # opens its first gap once, so marked rows count loans.
    in_fact = (
        fact.agg(
            F.count_if(~F.col("is_forward_filled")).alias("reported"),
            F.count_if("is_forward_filled").alias("filled"),
            F.count_if("opens_gap").alias("filled_loans"),
        )
        .select(
            F.inline(
                F.array(
                    F.struct(
                        duplicate.alias("rule_name"),
                        (-F.col("reported")).alias("affected_rows"),
                        F.lit(DUPLICATE_DETAIL).alias("detail"),
                    ),
                    F.struct(
                        gap.alias("rule_name"),
                        F.col("filled").alias("affected_rows"),
                        gap_detail.alias("detail"),
                    ),
                )
            )
        )
    )
    from_rows = in_source.unionByName(in_fact).groupBy("rule_name", "detail").agg(
        F.sum("affected_rows").alias("affected_rows")
    )
    inconsistent = dim.agg(F.count_if("is_inconsistent").alias("affected_rows")).select(
        F.lit("inconsistent_origination_attributes").alias("rule_name"),
        "affected_rows",
        F.lit(INCONSISTENT_DETAIL).alias("detail"),
    )
    return _ingest_rows(from_rows.unionByName(inconsistent))


def fact_measures(spec: PanelSpec) -> dict[str, Column]:
    """What is counted while the fact is written, for the findings of the ingest.

    A loan opens its first gap once, so marked rows count loans.
    """
    return {
        "reported": F.count_if(~F.col("is_forward_filled")),
        "filled": F.count_if("is_forward_filled"),
        "filled_loans": F.count_if("opens_gap"),
        "long_gaps": F.count_if(F.col("gap_periods") > spec.long_gap),
    }


def dim_measures() -> dict[str, Column]:
    """The same while the entities are written; placed rows name an entity and a period."""
    return {
        "inconsistent": F.count_if("is_inconsistent"),
        "placed": F.sum(F.when(F.col("loan_id").isNotNull(), F.col("placed_rows"))),
    }


def counted_findings(spark: SparkSession, dim: Mapping[str, int], fact: Mapping[str, int]) -> DataFrame:
    """``ingest_findings`` from the measures of a build, without reading a table."""
    rows = [
        ("duplicate_loan_period", dim["placed"] - fact["reported"], DUPLICATE_DETAIL),
        ("inconsistent_origination_attributes", dim["inconsistent"], INCONSISTENT_DETAIL),
        ("panel_period_gap", fact["filled"], GAP_DETAIL % fact["filled_loans"]),
    ]
    return _ingest_rows(spark.createDataFrame(rows, "rule_name string, affected_rows long, detail string"))


def long_gap_finding(fact: DataFrame, spec: PanelSpec) -> DataFrame:
    """Gaps so long that a wrong period is likelier than a loan that was not reported."""
    return _ingest_rows(
        fact.agg(fact_measures(spec)["long_gaps"].alias("affected_rows")).select(
            F.lit("implausible_panel_gap").alias("rule_name"),
            "affected_rows",
            F.lit(f"Gaps of more than {spec.long_gap} periods; filled like any other").alias("detail"),
        )
    )


def _ingest_rows(counts: DataFrame) -> DataFrame:
    return counts.select(
        "rule_name",
        _severity(INGEST_SEVERITY, F.col("rule_name")).alias("severity"),
        _outcome(F.col("affected_rows")).alias("status"),
        "affected_rows",
        "detail",
    )


def rejected_finding(spark: SparkSession, counts: Mapping[str, int], reasons: Sequence[str]) -> DataFrame:
    """The finding of a landed source, from what was counted while it was written."""
    listed = ", ".join(f"{counts[f'cells_{r.replace(" ", "_")}']} {r}" for r in reasons)
    row = ("rejected_source_row", counts["rows_rejected"], f"Source rows left out: {listed}")
    return _ingest_rows(spark.createDataFrame([row], "rule_name string, affected_rows long, detail string"))


# --- warehouse rules --------------------------------------------------------


def with_prior(fact: DataFrame) -> DataFrame:
    """Previous row's balance and status, and whether a row is the second of its period.

    Facts built here already carry them; others are read in order, which is a shuffle.
    """
    if {"prior_balance", "prior_status", "repeats_period"} <= set(fact.columns):
        return fact
    in_order = Window.partitionBy("loan_id").orderBy("period")
    return fact.withColumns(
        {
            "prior_balance": F.lag("current_balance").over(in_order),
            "prior_status": F.lag("status_code").over(in_order),
            "repeats_period": ordered.second_copy("loan_id", "period"),
        }
    )


def balance_rise(spec: PanelSpec) -> Column:
    """An active row whose balance rose by more than the tolerance."""
    rise = F.col("current_balance") - F.col("prior_balance")
    return (rise > spec.balance_rise_tolerance) & (F.col("status_code") == ACTIVE)


def reconciliation(segments: DataFrame, summary: DataFrame, spec: PanelSpec) -> DataFrame:
    """Segment total less portfolio total, per dimension and period.

    Compares the two reports. Money is added as a decimal, so that agreement
    is exactly zero.
    """
    active = F.col("active_balance").cast(spec.money_type)
    totals = segments.groupBy("segment_type", "period").agg(
        F.sum(active).alias("segment_total")
    )
    book = summary.select("period", active.alias("portfolio_total"))
    return totals.join(book, "period").select(
        "segment_type",
        "period",
        (F.col("segment_total") - F.col("portfolio_total")).cast("double").alias("difference"),
    )


def reconciliation_by_dimension(
    segments: DataFrame, summary: DataFrame, spec: PanelSpec
) -> DataFrame:
    return (
        reconciliation(segments, summary, spec)
        .groupBy("segment_type")
        .agg(F.max(F.abs("difference")).alias("max_abs_difference"))
    )


def duplicate_keys(fact: DataFrame) -> DataFrame:
    """How many loan-periods a fact has more than once, whoever wrote it."""
    keys = fact.groupBy("loan_id", "period").agg(F.count("*").alias("copies"))
    return keys.agg(F.count_if(F.col("copies") > 1).alias("duplicate_loan_period"))


def rule_counts(
    dim: DataFrame,
    fact: DataFrame,
    periods: DataFrame,
    segments: DataFrame,
    summary: DataFrame,
    spec: PanelSpec,
    published: DataFrame | None = None,
) -> DataFrame:
    """(rule_name, affected_rows) of the ten rules.

    One scan of the fact for all rules on rows, duplicate keys included: a key with
    copies has one second row. Given the ``published`` fact, keys are counted there
    instead, by a grouping of their own that does not rely on the build.
    """
    status = F.col("status_code")
    by_row = with_prior(fact).agg(
        F.count_if(F.col("current_balance") < 0).alias("negative_balance"),
        F.count_if(balance_rise(spec)).alias("balance_increased_on_amortising_loan"),
        F.count_if(F.col("quarters_on_book") < 0).alias("row_dated_before_origination"),
        F.count_if(
            F.col("prior_status").isin(DEFAULT, PAYOFF) & (status != F.col("prior_status"))
        ).alias("loan_left_terminal_status"),
        F.count_if(~status.isin(*STATUS_LABELS)).alias("invalid_status_code"),
        F.count_if("repeats_period").alias("duplicate_loan_period"),
    )
    by_loan = dim.agg(
        F.count_if(F.col("credit_score").isNull()).alias("missing_credit_score"),
        F.count_if(
            F.col("property_type").isNull() | (F.col("property_type") == OTHER_PROPERTY)
        ).alias("missing_property_type"),
    )
    unreconciled = reconciliation(segments, summary, spec).agg(
        F.count_if(F.abs("difference") > spec.reconciliation_tolerance).alias(
            "segment_balance_reconciliation"
        )
    )
    contiguous = F.count("*") == F.max("period") - F.min("period") + 1
    continuity = periods.agg(
        F.when(contiguous, 0).otherwise(1).cast("long").alias("reporting_period_continuity")
    )
    findings = _as_rows(by_row)
    if published is not None:
        findings = findings.where(F.col("rule_name") != "duplicate_loan_period").unionByName(
            _as_rows(duplicate_keys(published))
        )
    for other in (by_loan, unreconciled, continuity):
        findings = findings.unionByName(_as_rows(other))
    return findings


def rule_findings(
    dim: DataFrame,
    fact: DataFrame,
    periods: DataFrame,
    segments: DataFrame,
    summary: DataFrame,
    spec: PanelSpec,
    published: DataFrame | None = None,
) -> DataFrame:
    return rule_counts(dim, fact, periods, segments, summary, spec, published).select(
        "rule_name",
        _severity(RULE_SEVERITY, F.col("rule_name")).alias("severity"),
        _outcome(F.col("affected_rows")).alias("status"),
        "affected_rows",
    )


def quality_score(findings: DataFrame) -> DataFrame:
    """Share of severity weight that passed; 100 when there are no rules."""
    weight = F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHT.items() for x in pair])[
        F.col("severity")
    ]
    passed = F.sum(F.when(F.col("status") == PASS, weight).otherwise(0))
    return findings.agg(
        F.coalesce(
            F.lit(100.0) * passed.cast("double") / F.nullif(F.sum(weight).cast("double"), F.lit(0.0)),
            F.lit(100.0),
        ).alias("score"),
        F.count_if(F.col("status") == PASS).alias("rules_passed"),
        F.count("*").alias("rules"),
        F.coalesce(F.sum("affected_rows"), F.lit(0)).alias("affected_rows"),
    )


# --- register ---------------------------------------------------------------


def register_rows(findings: DataFrame, phase: str, run_at: datetime.datetime) -> DataFrame:
    """Findings of one run in register form. One timestamp for the whole run."""
    values = {
        "run_timestamp": F.lit(run_at.isoformat(sep=" ")).cast("timestamp_ntz"),
        "phase": F.lit(phase),
        "detail": F.col("detail") if "detail" in findings.columns else F.lit(""),
    }
    return findings.select(
        [values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in REGISTER_SCHEMA]
    )


def latest_run(register: DataFrame, phase: str | None = None) -> DataFrame:
    """Rows of the newest run, of one phase or of the whole register."""
    rows = register if phase is None else register.where(F.col("phase") == phase)
    newest = rows.agg(F.max("run_timestamp")).scalar()
    return rows.where(F.col("run_timestamp") == newest)


def latest_rules(register: DataFrame) -> DataFrame:
    """Outcome of every rule in the newest quality run."""
    return latest_run(register, QUALITY_PHASE).select(
        "rule_name", "severity", "status", "affected_rows"
    )


def failing_rules(register: DataFrame) -> DataFrame:
    return (
        latest_rules(register)
        .where(F.col("status") == FAIL)
        .select("rule_name", "severity", "affected_rows")
    )


def latest_ingest(register: DataFrame) -> DataFrame:
    """Ingest findings if they belong to the newest run of the register."""
    return (
        latest_run(register)
        .where(F.col("phase") == INGEST_PHASE)
        .select("rule_name", "severity", "status", "affected_rows", "detail")
    )


def register_history(register: DataFrame) -> DataFrame:
    return register.groupBy("phase", "status").agg(
        F.count("*").alias("rules"), F.sum("affected_rows").alias("affected_rows")
    )
