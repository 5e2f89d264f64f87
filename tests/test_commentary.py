from __future__ import annotations

import pytest
from panel_rows import rows_of
from pyspark.sql import functions as F

from ledgerloom.operators import commentary
from ledgerloom.plans.reporting import ReportStore
from ledgerloom.spec import PanelSpec


def lines(context, period, register=None, generated=None):
    rows = context.store.commentary_lines(
        context.register if register is None else register, generated, period
    )
    ordered = rows_of(rows, "line_no")
    assert [r["line_no"] for r in ordered] == list(range(1, len(ordered) + 1))
    return [r["text"] for r in ordered]


def test_first_period_has_no_comparisons(small):
    text = lines(small, 1)
    assert "Balance was broadly flat on the quarter." in text
    assert "The quarterly default rate was 0.00% of loans active at the prior quarter end." in text
    assert not any("percentage points" in line or "broadly stable" in line for line in text)
    assert not any("nan" in line.lower().split() for line in text)


def test_second_period_reads_stable_without_a_prior_rate(small):
    assert "The default rate was broadly stable on the quarter." in lines(small, 2)


def test_generated_line_is_optional(small):
    assert not any(line.startswith("Generated") for line in lines(small, 5))
    assert "Generated         : 2024-05-01 09:30" in lines(small, 5, generated="2024-05-01 09:30")


def test_quality_lines_list_failures_by_size(small):
    text = lines(small, 5)
    start = text.index("DATA QUALITY")
    listed = [line for line in text[start:] if line.startswith("  - ")]
    assert text[start + 2].startswith(f"{len(listed)} rule(s) failed")
    sizes = [int(line.split("): ")[1].split()[0].replace(",", "")) for line in listed]
    assert sizes == sorted(sizes, reverse=True) and sizes
    passed = small.register.where(F.col("status") == "PASS")
    assert "All data quality rules passed on the most recent run." in lines(small, 5, passed)


@pytest.fixture(scope="module")
def segments(spark):
    rows = [
        # period, type, value, active, prior, growth, default rate, loans
        (2, "Occupancy", "Investor", 90.0, 100.0, -10.0, 2.0, 51),
        (2, "Occupancy", "Owner occupied", 80.0, 100.0, -20.0, 3.0, 60),
        (2, "Property type", "Condominium", 10.0, 100.0, -90.0, 9.0, 50),
        (3, "Occupancy", "Investor", 99.0, 90.0, 10.0, None, 51),
        (3, "Occupancy", "Owner occupied", 88.0, 80.0, 10.0, 0.0, 60),
    ]
    return spark.createDataFrame(
        rows,
        "period long, segment_type string, segment_value string, active_balance double, "
        "prior_active_balance double, balance_growth_pct double, "
        "quarterly_default_rate_pct double, active_loans long",
    )


def test_movers_follow_the_portfolio_and_need_enough_loans(spark, segments):
    book = spark.createDataFrame(
        [(2, -15.0, 200.0), (3, 10.0, 170.0)],
        "period long, balance_growth_pct double, prior_active_balance double",
    )
    growth = rows_of(commentary.top_mover_growth(segments, book, PanelSpec()), "period")
    # Exactly 50 loans is not enough; equal growth falls back to the name.
    assert [(r["segment_value"], r["balance_growth_pct"]) for r in growth] == [
        ("Owner occupied", -20.0),
        ("Investor", 10.0),
    ]
    assert growth[0]["contribution_pp"] == -10.0
    worst = rows_of(commentary.top_mover_default(segments, PanelSpec()), "period")
    assert [(r["segment_value"], r["quarterly_default_rate_pct"]) for r in worst] == [
        ("Owner occupied", 3.0),
        ("Owner occupied", 0.0),
    ]


def test_prior_rate_needs_the_period_right_before(make_warehouse, tmp_path):
    w = make_warehouse(
        {"id": 1, "time": 1},
        {"id": 1, "time": 2},
        {"id": 2, "time": 4},
        {"id": 2, "time": 5},
    )
    facts = rows_of(ReportStore(w, str(tmp_path)).movement_facts(), "period")
    assert [(r["period"], r["has_prior_period"]) for r in facts] == [
        (1, False),
        (2, True),
        (4, False),
        (5, True),
    ]
