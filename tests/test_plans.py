"""Shape of physical plans: what would decide how jobs behave at scale."""

from __future__ import annotations

import re

import pytest
from panel_rows import SMALL
from pyspark.sql import functions as F

from ledgerloom.operators import migration, portfolio, prepare, profiling, provision, quality
from ledgerloom.plans import catalog
from ledgerloom.plans.reporting import REPORTS
from ledgerloom.spec import PanelSpec

SPEC = PanelSpec()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> int:
    return plan(df).count("FileScan parquet")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_and_no_cross_join(small, name):
    text = plan(catalog.QUERIES[name](small))
    for operator in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_copies_are_cut_before_the_shuffle(small):
    text = plan(prepare.dedupe(small.warehouse.panel))
    limits = [m.start() for m in re.finditer("WindowGroupLimit", text)]
    exchange = text.index("Exchange")
    assert len(limits) == 2 and limits[0] < exchange < limits[1]


def test_entity_work_on_the_fact_shares_one_shuffle(small):
    text = plan(prepare.linked_rows(prepare.dedupe(small.warehouse.panel)))
    partitionings = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert [re.sub(r"#\d+L?|, \d+$", "", p) for p in partitionings] == ["loan_id", "loan_id, period"]
    # Sorts: one per shuffle, and one below the map-side cut.
    assert text.count("+- Sort [") == 3


def test_odd_rows_do_not_change_the_plan(make_panel):
    """A stray period, or many rows without an entity, and the plan stays as it is."""
    usual = [{"id": i, "time": t} for i in (1, 2) for t in (1, 2)]
    odd = [*usual, {"id": 1, "time": 500_000}, *[{"id": None, "time": 1}] * 50]
    texts = [
        re.sub(r"#\d+L?|ExistingRDD.*|\[plan_id=\d+\]|Scan.*", "", plan(
            prepare.linked_rows(prepare.dedupe(make_panel(*rows)))
        ))
        for rows in (usual, odd)
    ]
    assert texts[0] == texts[1]


def test_panel_keeps_every_shipped_line(spark, small):
    tables = {
        t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        for t in ("lineitem", "orders", "customer")
    }
    joined = (
        tables["lineitem"]
        .join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
    )
    assert small.warehouse.panel.count() == joined.count()


def test_reports_on_the_fact_scan_it_once(small):
    w = small.warehouse
    for df in (
        portfolio.portfolio_summary(w.fact, w.spec),
        portfolio.segment_performance(w.fact, w.spec),
        portfolio.status_mix(w.fact, w.spec),
        migration.roll_rates(w.fact, w.spec),
        provision.pd_horizon(w.fact, w.spec),
    ):
        assert scans(df) == 1


def test_reports_shuffle_only_aggregates(small):
    """Below the first exchange of each report there is a partial aggregate."""
    w = small.warehouse
    for name in ("vw_portfolio_summary", "vw_segment_performance", "vw_delinquency", "vw_roll_rates"):
        text = plan(REPORTS[name](w))
        deepest = text[text.rindex("Exchange") :].split("\n")[1]
        assert "HashAggregate" in deepest and "partial_" in deepest


def test_scans_read_only_needed_columns(small):
    w = small.warehouse
    text = plan(migration.roll_rates(w.fact, w.spec))
    (schema,) = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    columns = {part.split(":")[0] for part in schema.split(",") if ":" in part}
    assert columns <= {
        "period",
        "current_balance",
        "status_bucket",
        "moves_next",
        "next_status",
    }
    assert "PushedFilters: [IsNotNull(moves_next), EqualTo(moves_next,true)]" in text


def test_rules_scan_the_fact_once(small):
    w = small.warehouse
    counts = quality.rule_counts(
        w.dim,
        w.fact,
        w.periods,
        small.report("vw_segment_performance"),
        small.report("vw_portfolio_summary"),
        w.spec,
    )
    text = plan(counts)
    assert len(re.findall(r"FileScan parquet [^\n]*fact_loan_quarter", text)) == 1
    assert "hashpartitioning(loan_id" not in text


@pytest.mark.parametrize(
    "rows",
    [
        lambda p: prepare.entity_attributes(p),
        lambda p: profiling.final_status(p),
        lambda p: profiling.default_by_vintage(p),
    ],
)
def test_panel_rows_are_not_sorted_for_minima(small, rows):
    """Below the first exchange, entities are aggregated in a hash table."""
    text = plan(rows(small.warehouse.panel))
    below = text[text.rindex("Exchange") :]
    assert "HashAggregate" in below and "Sort" not in below


def test_changed_source_files_build_anew(spark, tmp_path):
    for name in catalog.SOURCES:
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(
            f"{tmp_path}/{name}.parquet"
        )
    first = catalog.context(spark, str(tmp_path))
    assert catalog.context(spark, str(tmp_path)) is first
    half = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_linenumber < 3")
    half.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    again = catalog.context(spark, str(tmp_path))
    assert again is not first
    assert again.warehouse.panel.count() == half.count()


def test_ingest_findings_scan_the_fact_once(small):
    w = small.warehouse
    text = plan(quality.ingest_findings(w.panel, w.dim, w.fact))
    assert len(re.findall(r"FileScan parquet [^\n]*fact_loan_quarter", text)) == 1
    # Only partial counts are shuffled, no loans.
    assert "hashpartitioning(loan_id" not in text


def test_one_entity_with_a_third_of_all_rows(spark, make_panel):
    """A heavily copied key reaches the shuffle as one row per task."""
    base = make_panel({}).drop("id", "time", "balance_time")
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(F.lit(1)).alias("time"),
        (F.col("id") % 1000 + 1).cast("double").alias("balance_time"),
    )
    values = base.first().asDict()
    panel = rows.select(
        "*", *[F.lit(v).cast(base.schema[c].dataType).alias(c) for c, v in values.items()]
    )
    kept = prepare.dedupe(panel)
    hot = kept.where("loan_id = 0").orderBy("period").collect()
    assert [(r["period"], float(r["balance_time"])) for r in hot] == [
        (t, float(min(i % 1000 + 1 for i in range(0, 60_000, 3) if i % 5 == t))) for t in range(5)
    ]
    assert kept.count() == 40_000 + 5


def test_quarters_and_not_times_are_shuffled(spark):
    from ledgerloom.sources.derived import shipped_rows

    text = shipped_rows(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join Inner") < text.index("year(")


def test_hot_customer_is_split_in_the_panel_join(spark, tmp_path):
    """One customer with a third of the rows: adaptive execution splits its join."""
    from ledgerloom.plans.warehouse import written
    from ledgerloom.sources.derived import entities_from_rows, panel_from_rows, shipped_rows

    n = 60_000
    owner = F.when(F.col("id") % 3 == 0, F.lit(19)).otherwise(F.col("id") % 5_000).cast("long")
    keys = spark.range(n)
    keys.select(F.col("id").alias("o_orderkey"), owner.alias("o_custkey")).write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    keys.select(
        F.col("id").alias("l_orderkey"),
        F.lit(1).alias("l_linenumber"),
        (F.rand(3) * 90_000 + 900).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"),
        F.lit(0.02).alias("l_tax"),
        F.expr("timestamp_ntz'1995-01-15' + make_dt_interval(cast(id % 2500 as int))").alias(
            "l_shipdate"
        ),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5_000).select(
        F.col("id").alias("c_custkey"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.lit("BUILDING").alias("c_mktsegment"),
    ).write.parquet(f"{tmp_path}/customer.parquet")
    small_scale = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in small_scale}
    for key, value in small_scale.items():
        spark.conf.set(key, value)
    try:
        folder = str(tmp_path)
        rows = written(shipped_rows(spark, folder), f"{folder}/rows")
        customer = spark.read.parquet(f"{folder}/customer.parquet")
        entities = written(entities_from_rows(rows, customer), f"{folder}/entities")
        panel = panel_from_rows(rows, entities)
        assert panel.count() == n
        assert panel.groupBy("id").count().agg(F.max("count")).first()[0] > 10_000
        panel.collect()
        assert "skew=true" in plan(panel)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
