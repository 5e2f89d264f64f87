"""Every assumption that moves a number, in one frozen object.

Operators take a ``PanelSpec`` instead of reading module state, so two specs
(say, two loss-given-default assumptions) can be evaluated in one session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Input columns, labels, bands and thresholds that results depend on.
# ---------------------------------------------------------------------------

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("time", T.LongType()),
        T.StructField("orig_time", T.LongType()),
        T.StructField("first_time", T.LongType()),
        T.StructField("mat_time", T.LongType()),
        T.StructField("balance_time", T.DoubleType()),
        T.StructField("LTV_time", T.DoubleType()),
        T.StructField("interest_rate_time", T.DoubleType()),
        T.StructField("hpi_time", T.DoubleType()),
        T.StructField("gdp_time", T.DoubleType()),
        T.StructField("uer_time", T.DoubleType()),
        T.StructField("REtype_CO_orig_time", T.LongType()),
        T.StructField("REtype_PU_orig_time", T.LongType()),
        T.StructField("REtype_SF_orig_time", T.LongType()),
        T.StructField("investor_orig_time", T.LongType()),
        T.StructField("balance_orig_time", T.DoubleType()),
        T.StructField("FICO_orig_time", T.LongType()),
        T.StructField("LTV_orig_time", T.DoubleType()),
        T.StructField("Interest_Rate_orig_time", T.DoubleType()),
        T.StructField("hpi_orig_time", T.DoubleType()),
        T.StructField("default_time", T.LongType()),
        T.StructField("payoff_time", T.LongType()),
        T.StructField("status_time", T.LongType()),
    ]
)

ACTIVE, DEFAULT, PAYOFF = 0, 1, 2
STATUS_LABELS = {ACTIVE: "1. Active", DEFAULT: "2. Default", PAYOFF: "3. Payoff"}
UNKNOWN = "9. Unknown"

# (lowest, highest, label), both ends included.
SCORE_BANDS = (
    (0, 619, "1. <620"),
    (620, 659, "2. 620-659"),
    (660, 699, "3. 660-699"),
    (700, 739, "4. 700-739"),
    (740, 779, "5. 740-779"),
    (780, 900, "6. 780+"),
)
LTV_BANDS = (
    (0, 60, "1. <=60"),
    (61, 70, "2. 61-70"),
    (71, 80, "3. 71-80"),
    (81, 90, "4. 81-90"),
    (91, 100, "5. 91-100"),
    (101, 1000, "6. >100"),
)

VALID_SCORE = (300, 900)

SINGLE_FAMILY = "Single family"
PLANNED_URBAN = "Planned urban"
CONDOMINIUM = "Condominium"
OTHER_PROPERTY = "Other / not stated"
INVESTOR = "Investor"
OWNER_OCCUPIED = "Owner occupied"

STAGE_1, STAGE_2, STAGE_3 = "Stage 1", "Stage 2", "Stage 3"

SEGMENT_DIMENSIONS = {
    "Credit score band": "credit_score_band",
    "LTV band (at origination)": "ltv_band",
    "Property type": "property_type",
    "Occupancy": "occupancy",
    "Origination vintage": "origination_vintage",
}
STATUS_DIMENSIONS = {
    "Credit score band": "credit_score_band",
    "LTV band (at origination)": "ltv_band",
    "Origination vintage": "origination_vintage",
}
TOTAL_TYPE, TOTAL_VALUE = "Portfolio", "Total"

INGEST_PHASE, QUALITY_PHASE = "1-ingest", "4-quality"
PASS, FAIL = "PASS", "FAIL"

RULE_SEVERITY = {
    "duplicate_loan_period": "HIGH",
    "negative_balance": "HIGH",
    "balance_increased_on_amortising_loan": "MEDIUM",
    "row_dated_before_origination": "MEDIUM",
    "loan_left_terminal_status": "HIGH",
    "missing_credit_score": "MEDIUM",
    "missing_property_type": "LOW",
    "invalid_status_code": "HIGH",
    "segment_balance_reconciliation": "HIGH",
    "reporting_period_continuity": "MEDIUM",
}
INGEST_SEVERITY = {
    "duplicate_loan_period": "HIGH",
    "inconsistent_origination_attributes": "MEDIUM",
    "panel_period_gap": "MEDIUM",
    "rejected_source_row": "HIGH",
    "implausible_panel_gap": "MEDIUM",
}
SEVERITY_WEIGHT = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


@dataclass(frozen=True)
class PanelSpec:
    """Parameters of one panel and of the reports over it."""

    # (year, quarter) of period 1, or None to label periods without a calendar.
    calendar_anchor: tuple[int, int] | None = (2000, 2)
    # (origination period, tag) of the cohorts that are contrasted.
    focus_cohorts: tuple[tuple[int, str], ...] = (
        (14, "Benign cohort"),
        (27, "Stressed cohort"),
    )
    first_observable_origination: int = 1
    score_bands: tuple[tuple[int, int, str], ...] = SCORE_BANDS
    ltv_bands: tuple[tuple[int, int, str], ...] = LTV_BANDS
    stage2_ltv: float = 100.0
    loss_given_default: float = 0.30
    pd_horizon: int = 4
    growth_threshold_pct: float = 1.0
    default_rate_threshold_pp: float = 0.25
    mover_min_active: int = 50
    balance_rise_tolerance: float = 1.0
    reconciliation_tolerance: float = 0.01
    # More missing periods than this in one gap are filled, and reported as a finding.
    long_gap: int = 40
    # Rows keep the source's doubles. Only sums are decimal, so that totals do not
    # depend on row order; a value too large for the type is an error.
    money_scale: int = 8
    # The same for averaged measures (loan-to-value).
    measure_scale: int = 8

    @property
    def money_type(self) -> T.DecimalType:
        return T.DecimalType(28, self.money_scale)

    @property
    def measure_type(self) -> T.DecimalType:
        return T.DecimalType(28, self.measure_scale)
