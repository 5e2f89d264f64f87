"""Reports with parameters as SQL table functions.

A view has no parameters; these functions have them where a report has an assumption or
a choice, with the spec's values as defaults: ``SELECT * FROM provision(lgd => 0.45)``.
They are temporary functions over the session's views of a report store, written in SQL,
so that they can be joined, filtered and called laterally like tables. The optimizer
puts constant arguments in place and pushes filters through to the scans, so asking for
one period reads that period of the fact.

Where a function and an operator give the same report, they share every expression that
rounds or adds, and results are equal to the last bit (tested).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ledgerloom.plans.reporting import ReportStore, create_views
from ledgerloom.sources import sinks
from ledgerloom.spec import ACTIVE, DEFAULT, STAGE_1, STAGE_2, STAGE_3, PanelSpec

# The fact with the columns that link a row to its neighbours and its default.
LINKED_FACT = "fact_loan_quarter_linked"


@dataclass(frozen=True)
class SqlFunction:
    """Name, parameters (name, type, default), result columns and body of a function."""

    name: str
    parameters: tuple[tuple[str, str, str], ...]
    columns: str
    body: str

    def statement(self) -> str:
        listed = ", ".join(f"{name} {kind} DEFAULT {default}" for name, kind, default in self.parameters)
        return (
            f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({listed})\n"
            f"RETURNS TABLE ({self.columns})\nRETURN {self.body}"
        )


def _label(period: str, spec: PanelSpec) -> str:
    if spec.calendar_anchor is None:
        return f"concat('P', CAST({period} AS STRING))"
    year, quarter = spec.calendar_anchor
    number = f"({year * 4 + quarter - 2}L + {period})"
    return (
        f"concat(CAST(CAST(floor({number} / 4) AS INT) AS STRING), 'Q', "
        f"CAST(CAST(pmod({number}, 4) + 1 AS INT) AS STRING))"
    )


def _percent(part: str, whole: str) -> str:
    return f"100D * CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0D)"


def functions(spec: PanelSpec) -> list[SqlFunction]:
    """All functions, each after those it calls."""
    money = f"DECIMAL(28, {spec.money_scale})"
    stage2_ltv = ("stage2_ltv", "DOUBLE", f"{spec.stage2_ltv!r}D")
    assumptions = (
        ("lgd", "DOUBLE", f"{spec.loss_given_default!r}D"),
        stage2_ltv,
        ("horizon", "INT", str(spec.pd_horizon)),
    )
    min_active = ("min_active", "BIGINT", f"{spec.mover_min_active}L")

    def staged(function: str) -> str:
        return f"""CASE WHEN status_code = {DEFAULT} THEN '{STAGE_3}'
          WHEN current_ltv > {function}.stage2_ltv THEN '{STAGE_2}' ELSE '{STAGE_1}' END"""

    # A function cannot hand its parameters to another one, so shared parts are text.
    def ahead(function: str) -> str:
        # The comparison stands alone: no aggregate may mix a parameter and a column.
        return f"""
    SELECT credit_score_band, CAST(count_if(fails) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0D) AS pd_12m
    FROM (SELECT credit_score_band, default_period <= period + {function}.horizon AS fails
          FROM {LINKED_FACT} WHERE status_code = {ACTIVE})
    GROUP BY credit_score_band"""

    def distribution(function: str) -> str:
        return f"""
    SELECT period, {_label("period", spec)} AS reporting_quarter, ifrs9_stage, count(*) AS loans,
           CAST(sum(CAST(current_balance AS {money})) AS DOUBLE) AS exposure
    FROM (SELECT period, current_balance, {staged(function)} AS ifrs9_stage FROM fact_loan_quarter)
    GROUP BY period, ifrs9_stage"""

    def expected(function: str) -> str:
        return f"""
    cells AS (
      SELECT period, ifrs9_stage, credit_score_band, count(*) AS loans,
             CAST(sum(CAST(current_balance AS {money})) AS DOUBLE) AS exposure
      FROM (SELECT period, credit_score_band, current_balance, {staged(function)} AS ifrs9_stage
            FROM fact_loan_quarter)
      GROUP BY period, ifrs9_stage, credit_score_band),
    lifetime AS (
      SELECT l.credit_score_band, CAST(coalesce(defaults, 0) AS DOUBLE) / nullif(CAST(loans AS DOUBLE), 0D) AS pd_lifetime
      FROM (SELECT credit_score_band, count(*) AS loans FROM dim_loan GROUP BY credit_score_band) AS l
      LEFT JOIN (SELECT credit_score_band, count(*) AS defaults FROM fact_credit_event GROUP BY credit_score_band) AS e
        ON l.credit_score_band = e.credit_score_band),
    ahead AS ({ahead(function)}),
    expected AS (
      SELECT period, ifrs9_stage, cells.credit_score_band, loans, exposure,
             CASE ifrs9_stage WHEN '{STAGE_1}' THEN pd_12m WHEN '{STAGE_2}' THEN pd_lifetime ELSE 1D END AS pd
      FROM cells LEFT JOIN lifetime ON cells.credit_score_band = lifetime.credit_score_band
        LEFT JOIN ahead ON cells.credit_score_band = ahead.credit_score_band)"""

    return [
        SqlFunction(
            "stage_distribution",
            (stage2_ltv,),
            "period BIGINT, reporting_quarter STRING, ifrs9_stage STRING, loans BIGINT, exposure DOUBLE",
            distribution("stage_distribution"),
        ),
        SqlFunction(
            "pd_horizon",
            (("horizon", "INT", str(spec.pd_horizon)),),
            "credit_score_band STRING, pd_12m DOUBLE",
            ahead("pd_horizon"),
        ),
        SqlFunction(
            "provision",
            assumptions,
            "period BIGINT, reporting_quarter STRING, ifrs9_stage STRING, credit_score_band STRING, loans BIGINT, "
            "exposure DOUBLE, probability_of_default DOUBLE, loss_given_default_assumed DOUBLE, provision DOUBLE, "
            "coverage_ratio_pct DOUBLE",
            f"""
    WITH {expected("provision")}
    SELECT period, {_label("period", spec)}, ifrs9_stage, credit_score_band, loans, exposure, pd, provision.lgd,
           exposure * pd * provision.lgd, {_percent("exposure * pd * provision.lgd", "exposure")}
    FROM expected""",
        ),
        SqlFunction(
            "provision_movement",
            assumptions,
            "period BIGINT, reporting_quarter STRING, opening_provision DOUBLE, increase DOUBLE, decrease DOUBLE, "
            "closing_provision DOUBLE, net_movement DOUBLE, exposure DOUBLE, coverage_ratio_pct DOUBLE, "
            "reconciliation_error DOUBLE",
            f"""
    WITH {expected("provision_movement")},
    provided AS (
      SELECT period, ifrs9_stage, credit_score_band, exposure, exposure * pd * provision_movement.lgd AS provision
      FROM expected),
    closings AS (
      SELECT period,
             CASE WHEN count(provision) > 0 THEN aggregate(
               array_sort(collect_list(CASE WHEN provision IS NOT NULL
                 THEN named_struct('s', ifrs9_stage, 'b', credit_score_band, 'p', provision) END)),
               0D, (total, cell) -> total + cell.p) END AS closing,
             CAST(sum(CAST(exposure AS {money})) AS DOUBLE) AS exposure
      FROM provided GROUP BY period),
    openings AS (
      SELECT *, coalesce(lag(closing) OVER (ORDER BY period), 0D) AS opening FROM closings)
    SELECT period, {_label("period", spec)}, opening, greatest(closing - opening, 0D),
           greatest(opening - closing, 0D), closing, closing - opening, exposure,
           {_percent("closing", "exposure")},
           round(opening + greatest(closing - opening, 0D) - greatest(opening - closing, 0D) - closing, 6)
    FROM openings""",
        ),
        SqlFunction(
            "stage2_share",
            (stage2_ltv,),
            "period BIGINT, stage2_share_pct DOUBLE",
            f"""
    SELECT period, {_percent(f"sum(CASE WHEN ifrs9_stage = '{STAGE_2}' THEN CAST(exposure AS {money}) END)",
                             f"sum(CAST(exposure AS {money}))")}
    FROM ({distribution("stage2_share")}) GROUP BY period""",
        ),
        SqlFunction(
            "top_mover_default",
            (min_active,),
            "period BIGINT, segment_type STRING, segment_value STRING, quarterly_default_rate_pct DOUBLE",
            """
    SELECT period, segment_type, segment_value, quarterly_default_rate_pct
    FROM (SELECT *, row_number() OVER (PARTITION BY period
                 ORDER BY quarterly_default_rate_pct DESC, segment_type, segment_value) AS place
          FROM vw_segment_performance
          WHERE quarterly_default_rate_pct IS NOT NULL AND active_loans > top_mover_default.min_active)
    WHERE place = 1""",
        ),
        SqlFunction(
            "segments_of",
            (("dimension", "STRING", "NULL"), ("members", "ARRAY<STRING>", "NULL")),
            "period BIGINT, segment_type STRING, segment_value STRING, active_balance DOUBLE, active_loans BIGINT, "
            "pct_of_portfolio_balance DOUBLE, quarterly_default_rate_pct DOUBLE",
            """
    SELECT period, segment_type, segment_value, active_balance, active_loans, pct_of_portfolio_balance,
           quarterly_default_rate_pct
    FROM vw_segment_performance
    WHERE (segments_of.dimension IS NULL OR segment_type = segments_of.dimension)
      AND (segments_of.members IS NULL OR array_contains(segments_of.members, segment_value))""",
        ),
        SqlFunction(
            "vintage_curve",
            (("vintages", "ARRAY<STRING>", "NULL"), ("min_observed_pct", "DOUBLE", "0D")),
            "origination_vintage STRING, quarters_on_book BIGINT, pct_cohort_still_observed DOUBLE, "
            "cumulative_default_rate_pct DOUBLE, cumulative_default_rate_by_balance_pct DOUBLE",
            """
    SELECT origination_vintage, quarters_on_book, pct_cohort_still_observed, cumulative_default_rate_pct,
           cumulative_default_rate_by_balance_pct
    FROM vw_vintage_performance
    WHERE (vintage_curve.vintages IS NULL OR array_contains(vintage_curve.vintages, origination_vintage))
      AND pct_cohort_still_observed >= vintage_curve.min_observed_pct""",
        ),
    ]


def create_functions(spark: SparkSession, spec: PanelSpec) -> list[str]:
    """Define the functions over the views that the session has now."""
    found = functions(spec)
    for function in found:
        spark.sql(function.statement())
    return [f.name for f in found]


def create_sql(store: ReportStore) -> list[str]:
    """Views and functions of a report store: everything that SQL can ask it."""
    names = create_views(store)
    fact = store.warehouse.fact
    names += sinks.create_views({LINKED_FACT: fact})
    return names + create_functions(fact.sparkSession, store.warehouse.spec)
