from __future__ import annotations

import glob
import os

import pyarrow.parquet as pq
import pytest
from panel_rows import rows_of
from pyspark.sql import functions as F

from ledgerloom.plans import reporting, warehouse
from ledgerloom.plans.warehouse import build_warehouse, lazy_warehouse, shared_folder
from ledgerloom.sources import sinks
from ledgerloom.sources.panel import read_csv
from ledgerloom.spec import PanelSpec


def test_csv_columns_are_read_by_name(spark, make_panel, tmp_path):
    panel = make_panel({"time": 3, "LTV_time": None}, {"id": 2})
    shuffled = panel.select("status_time", *reversed(panel.columns[:-1]))
    sinks.export_csv({"panel": shuffled}, str(tmp_path))
    back = read_csv(spark, f"{tmp_path}/panel")
    assert back.schema == panel.schema
    assert rows_of(back, "id") == rows_of(panel, "id")


def test_exported_reports_read_back(spark, small, tmp_path):
    tables = {name: small.report(name) for name in ("vw_roll_rates", "vw_provision")}
    sinks.export_csv(tables, str(tmp_path))
    for name, table in tables.items():
        back = spark.read.schema(table.schema).option("header", True).csv(f"{tmp_path}/{name}")
        keys = table.columns[:4]
        assert rows_of(back, *keys) == rows_of(table, *keys)


def test_commentary_is_one_ordered_file_per_quarter(small, tmp_path):
    lines = small.store.commentary_lines(small.register).cache()
    sinks.write_commentary(lines, str(tmp_path))
    expected: dict[str, list[str]] = {}
    for row in rows_of(lines, "period", "line_no"):
        expected.setdefault(row["reporting_quarter"], []).append(row["text"])
    assert len(expected) == 28
    for quarter, texts in expected.items():
        (path,) = glob.glob(f"{tmp_path}/reporting_quarter={quarter}/*.txt")
        with open(path) as f:
            assert f.read().rstrip("\n").split("\n") == texts


def test_register_only_grows(spark, small, tmp_path):
    path = f"{tmp_path}/register"
    rows = small.register
    first, last = rows.agg(F.min("run_timestamp"), F.max("run_timestamp")).first()
    for stamp in (first, last, last):
        sinks.append_register(rows.where(F.col("run_timestamp") == F.lit(stamp)), path)
    back = sinks.read_register(spark, path)
    assert back.schema == rows.schema
    kept = rows.where(F.col("run_timestamp").isin(first, last))
    keys = ("run_timestamp", "rule_name")
    assert rows_of(back, *keys) == rows_of(kept, *keys)


def test_whole_numbers_with_a_point(spark, make_panel, tmp_path):
    panel = make_panel({"time": 3}, {"id": 2, "status_time": None})
    sinks.export_csv({"good": panel.withColumn("time", F.col("time").cast("double"))}, str(tmp_path))
    assert rows_of(read_csv(spark, f"{tmp_path}/good"), "id") == rows_of(panel, "id")
    sinks.export_csv({"bad": panel.withColumn("time", F.lit(3.5))}, str(tmp_path))
    with pytest.raises(Exception, match="time is not a whole number: 3.5"):
        read_csv(spark, f"{tmp_path}/bad").collect()


def test_fact_files_are_sorted_by_period(small):
    """A filter on the period then skips most of a file."""
    paths = small.warehouse.fact.inputFiles()
    table = pq.read_table(paths[0].removeprefix("file:"), columns=["period"])
    periods = table["period"].to_pylist()
    assert periods == sorted(periods)


def test_views_answer_sql(spark, small):
    names = reporting.create_views(small.store)
    assert len(names) == 13
    total = spark.sql(
        "SELECT sum(active_balance) AS b FROM vw_segment_performance "
        "WHERE segment_type = 'Occupancy' AND period = 9"
    ).first()["b"]
    summary = spark.sql("SELECT active_balance AS b FROM vw_portfolio_summary WHERE period = 9")
    assert abs(total - summary.first()["b"]) < 0.01


def test_written_and_lazy_warehouse_agree(spark, make_panel, tmp_path):
    panel = make_panel(
        *[{"id": i, "time": t, "balance_time": 10.0 * i + t} for i in range(1, 6) for t in (1, 2, 5)]
    )
    lazy = lazy_warehouse(panel, PanelSpec())
    written = build_warehouse(panel, PanelSpec(), f"{tmp_path}/written")
    assert written.fact.schema.names == lazy.fact.schema.names
    for a, b in ((written.fact, lazy.fact), (written.dim, lazy.dim), (written.event, lazy.event)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder != shared_folder(spark)
    if configured:
        assert os.path.dirname(folder) == configured.rstrip("/")


def test_tasks_of_the_fact_go_by_rows(spark, make_panel, tmp_path, monkeypatch):
    """However small the rows are in a shuffle, a task gets no more of them."""
    panel = make_panel(*[{"id": i, "time": t} for i in range(60) for t in (1, 2, 4)])
    lazy = lazy_warehouse(panel, PanelSpec()).fact
    monkeypatch.setattr(warehouse, "TASK_ROWS", 15)
    fact = build_warehouse(panel, PanelSpec(), f"{tmp_path}/w").fact
    sizes = [r["count"] for r in fact.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 6 and max(sizes) < 120 and sum(sizes) == 240
    assert fact.exceptAll(lazy).count() == lazy.exceptAll(fact).count() == 0


def test_working_tables_are_compressed_well(spark, make_panel, tmp_path):
    built = build_warehouse(make_panel({}), PanelSpec(), f"{tmp_path}/w")
    rows = warehouse.written(spark.range(3), f"{tmp_path}/rows")
    for table in (built.dim, built.fact, rows):
        assert all(name.endswith(".zstd.parquet") for name in table.inputFiles())
