"""Counts taken while tables are written, and rules that can fail."""

from __future__ import annotations

import glob
import re

import pytest
from panel_rows import rows_of
from pyspark import TaskContext
from pyspark.sql import functions as F

from ledgerloom.operators import migration, quality
from ledgerloom.plans import bucketed, catalog
from ledgerloom.plans.reporting import REPORTS, ReportStore, tables
from ledgerloom.plans.warehouse import build_warehouse
from ledgerloom.sources import sinks
from ledgerloom.spec import PanelSpec


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_measures_are_those_of_the_written_table(spark, tmp_path):
    rows = spark.range(1000).withColumn("odd", F.col("id") % 2 == 1)
    table, found = sinks.counted(rows, f"{tmp_path}/t", {"odd": F.count_if("odd"), "sum": F.sum("id")})
    assert found == {"rows": 1000, "odd": 500, "sum": 499_500}
    assert table.count() == 1000
    empty, found = sinks.counted(rows.where("id < 0"), f"{tmp_path}/e", {"odd": F.count_if("odd"), "sum": F.sum("id")})
    assert found == {"rows": 0, "odd": 0, "sum": 0} and empty.count() == 0
    nothing, found = sinks.counted(rows.where(F.lit(False)), f"{tmp_path}/n")
    assert found == {"rows": 0} and nothing.columns == ["id", "odd"]


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_repeated_task_counts_once(spark, tmp_path, shuffled):
    """Tasks of the last stage and of one before it fail at first, after rows have passed."""

    def unsteady(batches):
        for batch in batches:
            yield batch
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
            raise RuntimeError("lost")

    rows = spark.range(0, 3000, 1, 3).mapInPandas(unsteady, "id long")
    if shuffled:
        rows = rows.groupBy((F.col("id") % 50).alias("id")).count()
    table, found = sinks.counted(rows, f"{tmp_path}/t", {"sum": F.sum("id")})
    assert found["rows"] == table.count() == (50 if shuffled else 3000)
    assert found["sum"] == table.agg(F.sum("id")).first()[0]


def test_the_build_counts_what_its_tables_hold(small):
    w = small.warehouse
    for name, table in tables(w).items():
        assert w.counts[name]["rows"] == table.count()
    keys = ("rule_name",)
    assert rows_of(small.store.ingest_findings(), *keys) == rows_of(
        quality.ingest_findings(w.panel, w.dim, w.fact), *keys
    )


def test_findings_and_manifest_read_no_table(small):
    assert "FileScan" not in plan(small.store.ingest_findings())
    counted = small.store.manifest()
    assert "FileScan" not in plan(counted)
    expected = {**{n: small.report(n) for n in REPORTS}, **tables(small.warehouse)}
    assert {r["object"]: r["rows"] for r in counted.collect()} == {n: t.count() for n, t in expected.items()}


def test_a_lazy_warehouse_is_counted_by_reading(make_warehouse, tmp_path):
    lazy = make_warehouse({"id": 1, "time": 1}, {"id": 1, "time": 4})
    found = dict(map(tuple, ReportStore(lazy, str(tmp_path)).manifest().collect()))
    assert found["fact_loan_quarter"] == 4 and found["dim_loan"] == 1


def test_duplicate_rule_sees_rows_appended_later(spark, make_panel, tmp_path):
    panel = make_panel(*[{"id": i, "time": t} for i in (1, 2) for t in (1, 2)])
    warehouse = build_warehouse(panel, PanelSpec(), f"{tmp_path}/w")
    store = ReportStore(warehouse, f"{tmp_path}/r")

    def duplicates(verify):
        return store.rules(verify).where("rule_name = 'duplicate_loan_period'").first()

    assert duplicates(True)["affected_rows"] == 0
    copy = warehouse.fact.where("loan_id = 2").limit(1).collect()
    spark.createDataFrame(copy, warehouse.fact.schema).write.mode("append").parquet(f"{tmp_path}/w/fact_loan_quarter")
    store.warehouse = type(warehouse)(
        **{**vars(warehouse), "fact": spark.read.schema(warehouse.fact.schema).parquet(f"{tmp_path}/w/fact_loan_quarter")}
    )
    assert duplicates(False)["affected_rows"] == 0
    assert (duplicates(True)["affected_rows"], duplicates(True)["status"]) == (1, "FAIL")


def test_rules_on_faulty_tables_fail(small):
    found = {r["rule_name"]: r["affected_rows"] for r in catalog.QUERIES["faulty_rules"](small).collect()}
    usual = {r["rule_name"]: r["affected_rows"] for r in small.store.rules().collect()}
    for rule in ("duplicate_loan_period", "segment_balance_reconciliation", "reporting_period_continuity"):
        assert usual[rule] == 0 < found[rule]
    assert found["duplicate_loan_period"] == small.faulty.duplicate_keys().count()


# --- bucketed tables ---------------------------------------------------------


def test_bucketed_joins_by_loan_move_nothing(spark, small):
    tables_ = small.bucketed
    by_loan = r"Exchange hashpartitioning\(loan_id"
    # Unbroadcast, or the small loans would be sent round.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucketed.copartitioned(spark):
            rates = plan(tables_.roll_rates())
        joined = plan(tables_.exposure_by_origination())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = plan(tables_.duplicate_keys())
    for text in (rates, joined, keys):
        assert not re.search(by_loan, text)
        assert "Bucketed: true" in text
    # Below the join or the grouping there is no exchange at all.
    for text in (rates, joined):
        assert "SortMergeJoin" in text and "Exchange" not in text[text.index("SortMergeJoin") :]
    assert text_after_last_exchange(keys).count("HashAggregate") >= 2
    usual = plan(migration.roll_rates_selfjoin(small.warehouse.fact_loan_quarter, small.spec))
    assert "Exchange" in usual[usual.index("Join") :]


def text_after_last_exchange(text):
    return text[text.rindex("Exchange") :]


def test_a_bucket_is_one_file(small):
    files = glob.glob(f"{small.path}/bucketed/fact_loan_quarter/*.parquet")
    numbers = [re.search(r"_(\d{5})\.c", f)[1] for f in files]
    assert len(numbers) == len(set(numbers)) <= bucketed.bucket_count(small.warehouse.counts["fact_loan_quarter"]["rows"], 2)


def test_bucket_counts():
    assert [bucketed.bucket_count(r, a) for r, a in ((0, 1), (10, 8), (10, 9), (10**9, 8))] == [1, 8, 16, 512]


def test_the_session_is_left_as_it_was(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), bucketed.copartitioned(spark):
        assert spark.conf.get(key) == "false"
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before
