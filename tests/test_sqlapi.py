"""SQL table functions against the operators that give the same reports."""

from __future__ import annotations

from dataclasses import replace

import pytest
from panel_rows import rows_of

from ledgerloom.operators import commentary, provision
from ledgerloom.plans import sqlapi
from ledgerloom.plans.reporting import ReportStore, create_views
from ledgerloom.sources import sinks
from ledgerloom.spec import PanelSpec


@pytest.fixture
def sql(spark, small):
    sqlapi.create_sql(small.store)
    return spark.sql


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


KEYS = ("period", "ifrs9_stage", "credit_score_band")


def test_defaults_are_the_specs(sql, small):
    assert rows_of(sql("SELECT * FROM provision()"), *KEYS) == rows_of(small.report("vw_provision"), *KEYS)
    assert rows_of(sql("SELECT * FROM provision_movement()"), "period") == rows_of(
        small.store.provision_movement(), "period"
    )
    assert rows_of(sql("SELECT * FROM stage2_share()"), "period") == rows_of(small.store.stage2_share(), "period")
    assert rows_of(sql("SELECT * FROM stage_distribution()"), *KEYS[:2]) == rows_of(
        provision.stage_distribution(small.warehouse.fact, small.spec).select(
            "period", "reporting_quarter", "ifrs9_stage", "loans", "exposure"
        ),
        *KEYS[:2],
    )
    assert rows_of(sql("SELECT * FROM pd_horizon()"), "credit_score_band") == rows_of(
        provision.pd_horizon(small.warehouse.fact, small.spec), "credit_score_band"
    )
    assert rows_of(sql("SELECT * FROM top_mover_default()"), "period") == rows_of(
        commentary.top_mover_default(small.report("vw_segment_performance"), small.spec), "period"
    )


def test_two_assumptions_give_two_reports(sql, small):
    w = small.warehouse
    for lgd, ltv, horizon in ((0.3, 100.0, 4), (0.45, 80.0, 8)):
        other = replace(small.spec, loss_given_default=lgd, stage2_ltv=ltv, pd_horizon=horizon)
        expected = provision.provision(w.dim, w.fact, w.event, other)
        found = sql(f"SELECT * FROM provision({lgd}D, {ltv}D, {horizon})")
        assert found.columns == expected.columns
        assert rows_of(found, *KEYS) == rows_of(expected, *KEYS)
        moved = sql("SELECT * FROM provision_movement(lgd => :lgd, stage2_ltv => :ltv, horizon => :h)",
                    args={"lgd": lgd, "ltv": ltv, "h": horizon})
        assert rows_of(moved, "period") == rows_of(provision.provision_movement(expected, other), "period")


def test_a_period_is_read_alone(sql):
    text = plan(sql("SELECT * FROM provision(lgd => 0.5D) WHERE period = 9"))
    assert "EqualTo(period,9)" in text and "NestedLoopJoin" not in text
    text = plan(sql("SELECT exposure FROM stage_distribution() WHERE period = 9"))
    assert text.count("FileScan") == text.count("EqualTo(period,9)") == 1


def test_a_table_of_assumptions(sql, small):
    """Called laterally, once for each row."""
    found = sql(
        "SELECT lgd, sum(provision) AS total FROM VALUES (0.2D), (0.4D) AS t(lgd), LATERAL provision(lgd) GROUP BY lgd"
    )
    low, high = (r["total"] for r in rows_of(found, "lgd"))
    assert high == pytest.approx(2 * low)


def test_choices(sql, small):
    segments = small.report("vw_segment_performance")
    assert sql("SELECT * FROM segments_of()").count() == segments.count()
    some = sql("SELECT DISTINCT segment_value FROM segments_of('Occupancy', array('Investor', 'none'))")
    assert [r[0] for r in some.collect()] == ["Investor"]
    curve = sql("SELECT * FROM vintage_curve(array('1995Q2'), min_observed_pct => 50)")
    expected = small.report("vw_vintage_performance").where(
        "origination_vintage = '1995Q2' AND pct_cohort_still_observed >= 50"
    )
    assert curve.count() == expected.count() > 0
    assert sql("SELECT * FROM top_mover_default(1000000000)").count() == 0


def test_labels_without_a_calendar(spark, make_warehouse, tmp_path):
    spec = replace(PanelSpec(), calendar_anchor=None)
    warehouse = make_warehouse({"id": 1, "time": 7}, spec=spec)
    create_views(ReportStore(warehouse, str(tmp_path)))
    sinks.create_views({sqlapi.LINKED_FACT: warehouse.fact})
    sqlapi.create_functions(spark, spec)
    assert spark.sql("SELECT reporting_quarter FROM provision()").first()[0] == "P7"
