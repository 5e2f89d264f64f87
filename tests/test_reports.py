from __future__ import annotations

import pytest
from panel_rows import rows_of
from pyspark.sql import functions as F

from ledgerloom.operators import migration, portfolio, provision
from ledgerloom.plans.reporting import REPORTS
from ledgerloom.spec import PanelSpec


def report(warehouse, name, *order):
    return rows_of(REPORTS[name](warehouse), *order)


def test_summary_growth_and_flow_default_rate(make_warehouse):
    w = make_warehouse(
        {"id": 1, "time": 1, "balance_time": 100.0},
        {"id": 2, "time": 1, "balance_time": 100.0},
        {"id": 1, "time": 2, "balance_time": 150.0},
        {"id": 2, "time": 2, "balance_time": 80.0, "status_time": 1},
    )
    first, second = report(w, "vw_portfolio_summary", "period")
    assert first["prior_active_balance"] is None and first["balance_growth_pct"] is None
    assert first["defaulted_balance"] is None and first["defaults"] == 0
    assert second["balance_movement"] == -50.0
    assert second["balance_growth_pct"] == -25.0
    assert second["quarterly_default_rate_pct"] == 50.0
    assert second["average_balance"] == 150.0


def test_summary_without_active_loans_has_no_ratios(make_warehouse):
    w = make_warehouse({"time": 1, "status_time": 2}, {"time": 2, "status_time": 2})
    for row in report(w, "vw_portfolio_summary", "period"):
        assert row["active_balance"] is None
        assert row["average_balance"] is None
        assert row["quarterly_default_rate_pct"] is None


def test_prior_is_the_previous_existing_row(make_warehouse):
    """A period nobody has rows in is skipped, not treated as zero."""
    w = make_warehouse(
        {"id": 1, "time": 1, "balance_time": 100.0}, {"id": 2, "time": 4, "balance_time": 300.0}
    )
    _, last = report(w, "vw_portfolio_summary", "period")
    assert (last["period"], last["prior_active_balance"]) == (4, 100.0)


@pytest.mark.parametrize("name", [*REPORTS])
def test_reports_accept_an_empty_panel(make_warehouse, make_panel, name):
    from ledgerloom.plans.warehouse import lazy_warehouse

    empty = lazy_warehouse(make_panel({}).limit(0), PanelSpec())
    assert REPORTS[name](empty).count() in (0,)


def test_transitions_skip_filled_rows(make_warehouse):
    w = make_warehouse(
        {"id": 1, "time": 1, "balance_time": 10.0},
        {"id": 1, "time": 2, "balance_time": 20.0},
        {"id": 1, "time": 4, "balance_time": 40.0},
        {"id": 1, "time": 5, "balance_time": 50.0, "status_time": 1},
        {"id": 2, "time": 4, "balance_time": 60.0},
        {"id": 2, "time": 5, "balance_time": 0.0, "status_time": 2},
        {"id": 3, "time": 4, "balance_time": 0.0},
        {"id": 3, "time": 5, "balance_time": 0.0},
    )
    order = ["from_period", "from_status", "to_status"]
    rates = report(w, "vw_roll_rates", *order)
    got = [
        (r["from_period"], r["to_status"], r["loans_moved"], r["balance_moved"]) for r in rates
    ]
    assert got == [
        (1, "1. Active", 1, 10.0),
        (4, "1. Active", 1, 0.0),
        (4, "2. Default", 1, 40.0),
        (4, "3. Payoff", 1, 60.0),
    ]
    assert [r["roll_rate_pct_by_balance"] for r in rates] == [100.0, 0.0, 40.0, 60.0]
    assert rates == rows_of(migration.roll_rates_selfjoin(w.fact, w.spec), *order)


def test_vintage_curve_is_cumulative_and_drops_censored_and_negative_ages(make_warehouse):
    w = make_warehouse(
        {"id": 1, "time": 5, "orig_time": 5, "balance_orig_time": 100.0, "status_time": 1},
        {"id": 2, "time": 5, "orig_time": 5, "balance_orig_time": 300.0},
        {"id": 2, "time": 6, "orig_time": 5, "balance_orig_time": 300.0},
        {"id": 2, "time": 8, "orig_time": 5, "balance_orig_time": 300.0, "status_time": 1},
        {"id": 3, "time": 5, "orig_time": -3, "status_time": 1},
        {"id": 4, "time": 4, "orig_time": 5, "balance_orig_time": 400.0, "status_time": 1},
    )
    rows = report(w, "vw_vintage_performance", "quarters_on_book")
    got = [
        (
            r["quarters_on_book"],
            r["cohort_loans"],
            r["loans_observed"],
            r["defaults_in_quarter"],
            r["cumulative_defaults"],
            r["cumulative_default_rate_by_balance_pct"],
        )
        for r in rows
    ]
    assert got == [
        (0, 3, 2, 1, 1, 12.5),
        (1, 3, 1, 0, 1, 12.5),
        (2, 3, 1, 0, 1, 12.5),
        (3, 3, 1, 1, 2, 50.0),
    ]


def test_loss_exposure_totals(make_warehouse):
    w = make_warehouse(
        {"id": 1, "status_time": 1, "balance_time": 50.0, "LTV_time": 100.0},
        {"id": 2, "status_time": 1, "balance_time": 150.0, "LTV_time": 130.0},
        {"id": 3},
    )
    (total,) = [r for r in report(w, "vw_loss_recovery") if r["segment_type"] == "Portfolio"]
    assert total["segment_value"] == "Total"
    assert total["defaults"] == 2
    assert total["avg_exposure_at_default"] == 100.0
    assert total["pct_underwater_at_default"] == 50.0
    assert total["exposure_as_pct_of_original"] == 50.0
    assert total["loss_severity_pct"] is None


def test_stage_boundaries(make_warehouse):
    w = make_warehouse(
        {"id": 1, "status_time": 1, "LTV_time": 50.0},
        {"id": 2, "LTV_time": 100.0},
        {"id": 3, "LTV_time": 100.01},
        {"id": 4, "LTV_time": None},
        {"id": 5, "status_time": 2, "LTV_time": 130.0},
    )
    stages = w.fact.select("loan_id", provision.stage(w.spec).alias("s")).orderBy("loan_id")
    assert [r["s"] for r in stages.collect()] == [
        "Stage 3",
        "Stage 1",
        "Stage 2",
        "Stage 1",
        "Stage 2",
    ]


def test_default_probabilities(make_warehouse):
    rows = [{"id": 1, "time": t} for t in range(1, 8)]
    rows += [{"id": 1, "time": 8, "status_time": 1}]
    rows += [{"id": 2, "time": t} for t in range(1, 4)]
    w = make_warehouse(*rows)
    (lifetime,) = rows_of(provision.pd_lifetime(w.dim, w.event))
    (ahead,) = rows_of(provision.pd_horizon(w.fact, w.spec))
    assert lifetime["pd_lifetime"] == 0.5
    # Entity 1 is within four periods of default in 4 of its 7 active rows.
    assert ahead["pd_12m"] == 4 / 10


def test_provision_scales_with_loss_given_default(make_warehouse):
    rows = [
        {"id": 1, "time": 1},
        {"id": 1, "time": 2, "status_time": 1},
        {"id": 2, "time": 1, "LTV_time": 120.0},
        {"id": 2, "time": 2, "LTV_time": 120.0},
    ]
    keys = ["period", "ifrs9_stage"]
    low = report(make_warehouse(*rows), "vw_provision", *keys)
    high = report(make_warehouse(*rows, spec=PanelSpec(loss_given_default=0.60)), "vw_provision", *keys)
    for a, b in zip(low, high, strict=True):
        assert b["provision"] == pytest.approx(2 * a["provision"])
        assert {k: a[k] for k in ("loans", "exposure", "probability_of_default")} == {
            k: b[k] for k in ("loans", "exposure", "probability_of_default")
        }


def test_movement_splits_charge_and_release(spark):
    cells = [(1, 10.0), (2, 25.0), (3, 25.0), (4, 5.0)]
    provisions = spark.createDataFrame(cells, "period long, provision double").withColumns(
        {
            "ifrs9_stage": F.lit("Stage 1"),
            "credit_score_band": F.lit("1. <620"),
            "exposure": F.lit(100.0),
        }
    )
    rows = rows_of(provision.provision_movement(provisions, PanelSpec()), "period")
    got = [
        (r["opening_provision"], r["increase"], r["decrease"], r["closing_provision"])
        for r in rows
    ]
    assert got == [
        (0.0, 10.0, 0.0, 10.0),
        (10.0, 15.0, 0.0, 25.0),
        (25.0, 0.0, 0.0, 25.0),
        (25.0, 0.0, 20.0, 5.0),
    ]
    assert all(r["reconciliation_error"] == 0 for r in rows)


def test_band_without_active_rows_has_no_horizon_probability(make_warehouse):
    w = make_warehouse({"time": 1, "status_time": 2})
    (cell,) = report(w, "vw_provision")
    assert cell["ifrs9_stage"] == "Stage 1"
    assert cell["probability_of_default"] is None and cell["provision"] is None
    (row,) = report(w, "vw_provision_movement")
    assert row["closing_provision"] is None and row["opening_provision"] == 0.0
    assert (row["increase"], row["decrease"]) == (0.0, 0.0)


# --- invariants over the derived panel -------------------------------------


def test_shares_add_to_one_hundred(small):
    w = small.warehouse
    mix = portfolio.status_mix(w.fact, w.spec).groupBy("segment_type", "segment_value", "period")
    rolls = migration.roll_rates(w.fact, w.spec).groupBy("from_period", "from_status")
    for sums in (
        mix.agg(F.sum("pct_of_segment_loans").alias("s")),
        mix.agg(F.sum("pct_of_segment_balance").alias("s")),
        rolls.agg(F.sum("roll_rate_pct_by_count").alias("s")),
        rolls.agg(F.sum("roll_rate_pct_by_balance").alias("s")),
    ):
        assert sums.where(F.abs(F.col("s") - 100) > 1e-9).count() == 0


def test_segments_tie_to_the_portfolio(small):
    assert {r["max_abs_difference"] for r in small.store.reconciliation_by_dimension().collect()} == {0.0}


def test_movement_chain_closes(small):
    rows = rows_of(small.report("vw_provision_movement"), "period")
    for before, after in zip(rows, rows[1:]):
        assert after["opening_provision"] == before["closing_provision"]
    assert all(r["reconciliation_error"] == 0 for r in rows)


def test_last_cumulative_default_equals_events(small):
    w = small.warehouse
    last = small.report("vw_vintage_performance").groupBy("origination_vintage").agg(
        F.max("cumulative_defaults").alias("n")
    )
    events = w.event.where("observed_from_origination and quarters_on_book_at_default >= 0")
    assert last.agg(F.sum("n")).first()[0] == events.count()


def test_fact_is_unique_and_contiguous(small):
    fact = small.warehouse.fact
    spans = fact.groupBy("loan_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("period").alias("d"),
        (F.max("period") - F.min("period") + 1).alias("span"),
    )
    assert spans.where("n <> d or n <> span").count() == 0


def test_results_do_not_depend_on_partitions(spark, small):
    w = small.warehouse

    def digest(partitions: int) -> list:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            shuffled = w.fact.repartition(partitions, "period")
            movement = provision.provision_movement(
                provision.provision(w.dim, shuffled, w.event, w.spec), w.spec
            )
            segments = portfolio.segment_performance(shuffled, w.spec)
            return [
                df.agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()[0]
                for df in (movement, segments)
            ]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 2)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    assert digest(1) == digest(4) == digest(23)
