from __future__ import annotations

import datetime
import glob
import os

import pytest

from ledgerloom.operators import quality
from ledgerloom.plans import reporting
from ledgerloom.plans.cycle import run_cycle
from ledgerloom.sources import sinks
from ledgerloom.sources.panel import read_csv
from ledgerloom.spec import PanelSpec


def test_two_cycles_from_csv(spark, make_panel, tmp_path):
    """CSV in; tables, register, commentary and CSV out; the register grows."""
    source = make_panel(
        *[
            {"id": i, "time": t, "balance_time": 1000.0 * i - t, "status_time": int(i == t == 3)}
            for i in range(1, 6)
            for t in range(1, 5)
            if t <= 3 or i != 3
        ]
    )
    sinks.export_csv({"panel": source}, str(tmp_path))
    panel = read_csv(spark, f"{tmp_path}/panel")
    out = f"{tmp_path}/out"
    first = datetime.datetime(2024, 1, 31, 6, 0)
    run_cycle(panel, PanelSpec(), out, first)
    store = run_cycle(panel, PanelSpec(), out, first + datetime.timedelta(days=90), period=2)

    register = sinks.read_register(spark, f"{out}/dq_results")
    assert register.count() == 2 * 14
    assert quality.latest_run(register, "4-quality").count() == 10
    runs = sorted(os.listdir(out))
    assert runs == ["dq_results", "run=20240131T060000", "run=20240430T060000"]
    latest, chosen = (glob.glob(f"{out}/{run}/commentary/*/*.txt") for run in runs[1:])
    assert "reporting_quarter=2001Q1" in latest[0] and "reporting_quarter=2000Q3" in chosen[0]
    with open(latest[0]) as f:
        assert "Generated         : 2024-01-31 06:00" in f.read()
    exported = sorted(os.listdir(f"{out}/{runs[1]}/export"))
    assert exported == sorted(
        [
            *reporting.REPORTS,
            "dim_loan",
            "dim_date",
            "fact_credit_event",
            "dq_results",
            "source_profile",
            "manifest",
            "dq_score",
        ]
    )

    def lines(name):
        paths = sorted(glob.glob(f"{out}/{runs[1]}/export/{name}/*.csv"))
        return [line for path in paths for line in open(path) if not line.startswith("period,")]

    periods = [int(line.split(",")[0]) for line in lines("vw_portfolio_summary")]
    assert periods == [1, 2, 3, 4]
    counts = dict(line.strip().split(",") for line in lines("manifest"))
    assert counts["fact_loan_quarter"] == "19" and counts["dq_results"] == "14"

    reporting.create_views(store)
    query = "SELECT defaults FROM vw_portfolio_summary WHERE period = :period"
    assert spark.sql(query, args={"period": 3}).first()["defaults"] == 1


def test_a_repeated_run_counts_once(spark, make_panel, tmp_path):
    panel = make_panel({"id": 1, "time": 1}, {"id": 1, "time": 2})
    run_at = datetime.datetime(2024, 1, 31, 6, 0)
    for _ in range(2):
        run_cycle(panel, PanelSpec(), str(tmp_path), run_at)
    register = sinks.read_register(spark, f"{tmp_path}/dq_results")
    assert register.count() == 14
    assert quality.quality_score(quality.latest_rules(register)).first()["rules"] == 10
    assert register.agg({"run_timestamp": "min"}).first()[0] == run_at


def test_a_period_without_data_is_an_error(make_panel, tmp_path):
    panel = make_panel({"id": 1, "time": 1}, {"id": 1, "time": 2})
    run_at = datetime.datetime(2024, 1, 31)
    with pytest.raises(ValueError, match="99"):
        run_cycle(panel, PanelSpec(), str(tmp_path), run_at, period=99)
    assert not os.path.exists(f"{tmp_path}/dq_results")
