from __future__ import annotations

import datetime

import pytest
from panel_rows import rows_of
from pyspark.sql import functions as F

from ledgerloom.operators import quality
from ledgerloom.plans.reporting import REPORTS
from ledgerloom.spec import INGEST_PHASE, QUALITY_PHASE, RULE_SEVERITY

FIRST = datetime.datetime(2024, 1, 1, 8, 0)
SECOND = datetime.datetime(2024, 4, 1, 8, 0)


@pytest.fixture(scope="module")
def clean(make_warehouse):
    return make_warehouse(
        {"id": 1, "time": 1, "balance_time": 100.0},
        {"id": 1, "time": 2, "balance_time": 90.0},
        {"id": 2, "time": 1, "balance_time": 100.0},
        {"id": 2, "time": 2, "balance_time": 100.5, "status_time": 0},
        {"id": 2, "time": 3, "balance_time": 0.0, "status_time": 2},
    )


def counts(w, dim=None, fact=None, periods=None, segments=None):
    # Published facts have no link columns, so neighbours come from the rows.
    fact = w.fact_loan_quarter if fact is None else fact
    segments = REPORTS["vw_segment_performance"](w) if segments is None else segments
    found = quality.rule_counts(
        w.dim if dim is None else dim,
        fact,
        w.periods if periods is None else periods,
        segments,
        REPORTS["vw_portfolio_summary"](w),
        w.spec,
    )
    return {r["rule_name"]: r["affected_rows"] for r in found.collect()}


def test_clean_warehouse_passes_every_rule(clean):
    assert counts(clean) == dict.fromkeys(RULE_SEVERITY, 0)


def test_link_columns_and_recomputed_neighbours_agree(small):
    w = small.warehouse
    assert counts(w) == counts(w, fact=w.fact)


def _changed(fact, column, value, where="loan_id = 1 and period = 2"):
    kind = fact.schema[column].dataType
    return fact.withColumn(
        column, F.when(F.expr(where), F.lit(value).cast(kind)).otherwise(F.col(column))
    )


@pytest.mark.parametrize(
    ("rule", "column", "value"),
    [
        ("negative_balance", "current_balance", -5.0),
        ("balance_increased_on_amortising_loan", "current_balance", 101.5),
        ("row_dated_before_origination", "quarters_on_book", -1),
        ("invalid_status_code", "status_code", 7),
    ],
)
def test_seeded_fact_defect_is_found(clean, rule, column, value):
    found = counts(clean, fact=_changed(clean.fact_loan_quarter, column, value))
    assert found.pop(rule) == 1
    assert set(found.values()) == {0}


def test_rise_at_the_tolerance_and_null_status_pass(clean):
    fact = _changed(clean.fact_loan_quarter, "current_balance", 101.0)
    assert counts(clean, fact=fact)["balance_increased_on_amortising_loan"] == 0
    fact = _changed(clean.fact_loan_quarter, "status_code", None)
    assert counts(clean, fact=fact)["invalid_status_code"] == 0


def test_leaving_a_terminal_status(clean):
    fact = _changed(clean.fact_loan_quarter, "status_code", 1, "loan_id = 1 and period = 1")
    assert counts(clean, fact=fact)["loan_left_terminal_status"] == 1


def test_duplicates_count_groups_not_rows(clean):
    fact = clean.fact_loan_quarter
    copies = fact.where("loan_id = 1 and period = 1")
    found = counts(clean, fact=fact.unionAll(copies).unionAll(copies))
    assert found["duplicate_loan_period"] == 1


def test_missing_attributes(clean):
    dim = clean.dim.withColumn("credit_score", F.lit(None).cast("long"))
    assert counts(clean, dim=dim)["missing_credit_score"] == 2
    dim = clean.dim.withColumn(
        "property_type", F.when(F.col("loan_id") == 1, "Other / not stated")
    )
    assert counts(clean, dim=dim)["missing_property_type"] == 2


def test_unreconciled_segment(clean):
    segments = REPORTS["vw_segment_performance"](clean).withColumn(
        "active_balance",
        F.when(
            (F.col("segment_type") == "Occupancy") & (F.col("period") == 1),
            F.col("active_balance") + 0.02,
        ).otherwise(F.col("active_balance")),
    )
    assert counts(clean, segments=segments)["segment_balance_reconciliation"] == 1


def test_period_continuity(clean):
    assert counts(clean, periods=clean.periods.where("period <> 2"))["reporting_period_continuity"] == 1
    assert counts(clean, periods=clean.periods.limit(0))["reporting_period_continuity"] == 1


def test_score_weighs_by_severity(spark):
    def score(rows):
        found = spark.createDataFrame(
            rows, "rule_name string, severity string, status string, affected_rows long"
        )
        return quality.quality_score(found).first()["score"]

    failing = {"balance_increased_on_amortising_loan", "missing_property_type"}
    rows = [(n, s, "FAIL" if n in failing else "PASS", 0) for n, s in RULE_SEVERITY.items()]
    assert score(rows) == 87.5
    assert score([]) == 100.0


def test_ingest_findings(make_warehouse):
    w = make_warehouse(
        {"id": 1, "time": 1},
        {"id": 1, "time": 1, "balance_time": 99.0},
        {"id": 1, "time": 4, "FICO_orig_time": 600},
        {"id": 2, "time": 1},
        {"id": 2, "time": 3},
    )
    found = rows_of(quality.ingest_findings(w.panel, w.dim, w.fact), "rule_name")
    got = [(r["rule_name"], r["status"], r["affected_rows"]) for r in found]
    assert got == [
        ("duplicate_loan_period", "FAIL", 1),
        ("inconsistent_origination_attributes", "FAIL", 1),
        ("panel_period_gap", "FAIL", 3),
    ]
    assert "across 2 loans" in found[2]["detail"]


@pytest.fixture(scope="module")
def register(clean):
    w = clean
    rules = quality.rule_findings(
        w.dim,
        w.fact,
        w.periods,
        REPORTS["vw_segment_performance"](w),
        REPORTS["vw_portfolio_summary"](w),
        w.spec,
    )
    worse = rules.withColumns(
        {
            "affected_rows": F.when(F.col("rule_name") == "negative_balance", 4).otherwise(0),
            "status": F.when(F.col("rule_name") == "negative_balance", "FAIL").otherwise("PASS"),
        }
    )
    ingest = quality.ingest_findings(w.panel, w.dim, w.fact)
    later = datetime.timedelta(minutes=5)
    return (
        quality.register_rows(ingest, INGEST_PHASE, FIRST)
        .unionAll(quality.register_rows(worse, QUALITY_PHASE, FIRST + later))
        .unionAll(quality.register_rows(ingest, INGEST_PHASE, SECOND))
        .unionAll(quality.register_rows(rules, QUALITY_PHASE, SECOND + later))
        .cache()
    )


def test_latest_run_replaces_earlier_failures(register):
    assert quality.failing_rules(register).count() == 0
    before = register.where(F.col("run_timestamp") < F.lit("2024-02-01").cast("timestamp_ntz"))
    assert [r["rule_name"] for r in quality.failing_rules(before).collect()] == ["negative_balance"]


def test_latest_ingest_looks_at_the_newest_run_of_any_phase(register):
    assert quality.latest_ingest(register).count() == 0
    after_ingest = register.where(F.col("run_timestamp") <= F.lit(str(SECOND)).cast("timestamp_ntz"))
    assert quality.latest_ingest(after_ingest).count() == 3


def test_history_counts_all_runs(register):
    got = [tuple(r) for r in quality.register_history(register).orderBy("phase", "status").collect()]
    assert got == [("1-ingest", "PASS", 6, 0), ("4-quality", "FAIL", 1, 4), ("4-quality", "PASS", 19, 0)]
