"""Registered queries over the panel derived from the order tables.

The panel and its warehouse are written once per session and source folder,
below the shared folder of the session, and every query reads them from there.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import (
    commentary,
    insights,
    loss,
    migration,
    portfolio,
    prepare,
    profiling,
    provision,
    quality,
    vintage,
)
from ledgerloom.plans.bucketed import BucketedTables, copartitioned, save_tables
from ledgerloom.plans.faults import Faulty, write_faulty
from ledgerloom.plans.reporting import SORT_KEYS, ReportStore
from ledgerloom.plans.sqlapi import create_sql
from ledgerloom.plans.warehouse import Warehouse, build_warehouse, shared_folder, written
from ledgerloom.sources import sinks
from ledgerloom.sources.derived import (
    DERIVED_SPEC,
    entities_from_rows,
    panel_from_rows,
    shipped_rows,
    write_spoilt_csv,
)
from ledgerloom.sources.landing import REASONS, Landing, land_csv
from ledgerloom.sources.panel import schema_profile
from ledgerloom.spec import INGEST_PHASE, QUALITY_PHASE, PanelSpec

# Fixed values of the registered queries.
RUNS = [
    (INGEST_PHASE, datetime.datetime(2024, 1, 31, 6, 0)),
    (QUALITY_PHASE, datetime.datetime(2024, 1, 31, 6, 30)),
    (INGEST_PHASE, datetime.datetime(2024, 4, 30, 6, 0)),
    (QUALITY_PHASE, datetime.datetime(2024, 4, 30, 6, 30)),
]
BENIGN, STRESSED = insights.focus_vintages(DERIVED_SPEC)
COHORT_MIN_ENTITIES = 20
ORIGINATION_YEARS = [(1993, 1994), (1995, 1996), (1997, 2001)]
SHOWN_BANDS = ["1. <620", "6. 780+"]
MIN_OBSERVED_PCT = 50.0


class Context:
    """Warehouse and written reports of one source folder in one session."""

    def __init__(self, spark: SparkSession, folder: str):
        path = shared_folder(spark)
        rows = written(shipped_rows(spark, folder), f"{path}/rows")
        customer = spark.read.parquet(f"{folder}/customer.parquet")
        entities = written(entities_from_rows(rows, customer), f"{path}/entities")
        panel = written(panel_from_rows(rows, entities), f"{path}/panel")
        self.path = path
        self.warehouse: Warehouse = build_warehouse(panel, DERIVED_SPEC, path)
        self.store = ReportStore(self.warehouse, f"{path}/reports")

    @property
    def spec(self) -> PanelSpec:
        return self.warehouse.spec

    def report(self, name: str) -> DataFrame:
        return self.store.report(name)

    @cached_property
    def landing(self) -> Landing:
        """The panel through CSV with unreadable cells and records in it."""
        write_spoilt_csv(self.warehouse.panel, f"{self.path}/csv")
        return land_csv(self.warehouse.panel.sparkSession, f"{self.path}/csv", f"{self.path}/landed")

    @cached_property
    def bucketed(self) -> BucketedTables:
        return save_tables(self.warehouse, f"{self.path}/bucketed")

    @cached_property
    def faulty(self) -> Faulty:
        """The published tables with faults that the build itself never makes."""
        return write_faulty(self.store, f"{self.path}/faulty")

    @cached_property
    def exported(self) -> DataFrame:
        """The segment report through its CSV export."""
        name = "vw_segment_performance"
        report = self.report(name)
        sinks.export_csv({name: report}, f"{self.path}/export", SORT_KEYS)
        reader = report.sparkSession.read.schema(report.schema).option("header", True)
        return reader.csv(f"{self.path}/export/{name}")

    @cached_property
    def commentary_files(self) -> DataFrame:
        """Lines of the commentary's text files, by quarter."""
        sinks.write_commentary(self.store.commentary_lines(self.register), f"{self.path}/commentary")
        files = self.warehouse.fact.sparkSession.read.text(f"{self.path}/commentary")
        return files.select("reporting_quarter", F.col("value").alias("text"))

    def sql(self, statement: str) -> DataFrame:
        """A statement over the views and SQL functions of this folder's tables."""
        create_sql(self.store)
        return self.warehouse.fact.sparkSession.sql(statement)

    @property
    def register(self) -> DataFrame:
        return self.store.register("dq_results", RUNS)

    @property
    def register_after_ingest(self) -> DataFrame:
        """The register as the second ingest leaves it, before the rules run."""
        return self.store.register("dq_results_after_ingest", RUNS[:-1])


SOURCES = ("lineitem", "orders", "customer")

_contexts: dict[tuple[str, str], tuple[set, Context]] = {}


def _files(spark: SparkSession, folder: str) -> set[tuple[str, int, int]]:
    """Path, size and time of every source file, as its file system lists them."""
    context = spark.sparkContext
    found = set()
    for name in SOURCES:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.add((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return found


def context(spark: SparkSession, folder: str) -> Context:
    """The tables of a folder, built on first use and again after its files changed."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    files = _files(spark, key[1])
    if key not in _contexts or _contexts[key][0] != files:
        _contexts[key] = files, Context(spark, key[1])
    return _contexts[key][1]


def forget() -> None:
    """Build again on next use."""
    _contexts.clear()


def _manifest(c: Context) -> DataFrame:
    counted = c.store.manifest({"dq_results": c.register})
    return counted.where(F.col("object") != "dim_period_macro")


def _gapfill(c: Context) -> DataFrame:
    fact = c.warehouse.fact
    return fact.select(
        "loan_id",
        "period",
        "is_forward_filled",
        F.col("current_balance").alias("balance_time"),
        F.col("current_ltv").alias("LTV_time"),
        F.col("current_interest_rate").alias("interest_rate_time"),
        F.col("status_code").alias("status_time"),
        "default_time",
        "payoff_time",
    )


def _dedupe(c: Context) -> DataFrame:
    return prepare.dedupe(c.warehouse.panel)


def _bucketed_roll_rates(c: Context) -> DataFrame:
    tables = c.bucketed
    with copartitioned(c.warehouse.fact.sparkSession):
        return written(tables.roll_rates(), f"{c.path}/bucketed/roll_rates")


SUMMARY = "vw_portfolio_summary"
SEGMENTS = "vw_segment_performance"
CURVES = "vw_vintage_performance"
MOVEMENT = "vw_provision_movement"

QUERIES: dict[str, Callable[[Context], DataFrame]] = {
    # sources and sinks
    "src_panel": lambda c: c.warehouse.panel,
    "src_landed": lambda c: c.landing.accepted,
    "src_rejected": lambda c: c.landing.rejected.drop("file", "record"),
    "dq_rejected": lambda c: quality.rejected_finding(
        c.warehouse.panel.sparkSession, c.landing.counts, REASONS
    ),
    "schema_profile": lambda c: schema_profile(c.warehouse.panel),
    "dq_register": lambda c: c.register,
    "manifest_counts": _manifest,
    # preparation
    "panel_dedupe": _dedupe,
    "ingest_findings": lambda c: quality.ingest_findings(
        c.warehouse.panel, c.warehouse.dim, c.warehouse.fact
    ),
    "dq_long_gaps": lambda c: quality.long_gap_finding(c.warehouse.fact, c.spec),
    "dim_entity": lambda c: c.warehouse.dim_loan,
    "band_distribution": lambda c: insights.band_distribution(c.warehouse.dim, c.warehouse.fact),
    "dim_period": lambda c: c.warehouse.periods,
    "dim_period_macro": lambda c: c.warehouse.macro,
    "panel_gapfill": _gapfill,
    "fact_panel": lambda c: c.warehouse.fact_loan_quarter,
    "fact_event": lambda c: c.warehouse.fact_credit_event,
    "period_continuity": lambda c: insights.period_continuity(c.warehouse.periods),
    "focus_cohort_summary": lambda c: insights.focus_cohort_summary(
        c.warehouse.dim, c.warehouse.event, c.spec
    ),
    "focus_exposure": lambda c: insights.focus_exposure(c.warehouse.event, c.spec),
    "dq_latest_ingest": lambda c: quality.latest_ingest(c.register_after_ingest),
    # reports
    "portfolio_summary": lambda c: portfolio.portfolio_summary(c.warehouse.fact, c.spec),
    "segment_performance": lambda c: portfolio.segment_performance(c.warehouse.fact, c.spec),
    "status_mix": lambda c: portfolio.status_mix(c.warehouse.fact, c.spec),
    "roll_rates": lambda c: migration.roll_rates(c.warehouse.fact, c.spec),
    "roll_rates_selfjoin": lambda c: migration.roll_rates_selfjoin(c.warehouse.fact, c.spec),
    "vintage_curves": lambda c: vintage.vintage_curves(
        c.warehouse.dim, c.warehouse.fact, c.warehouse.event, c.spec
    ),
    "loss_exposure": lambda c: loss.loss_exposure(c.warehouse.event, c.spec),
    "stage_distribution": lambda c: provision.stage_distribution(c.warehouse.fact, c.spec),
    "pd_lifetime": lambda c: provision.pd_lifetime(c.warehouse.dim, c.warehouse.event),
    "pd_horizon": lambda c: provision.pd_horizon(c.warehouse.fact, c.spec),
    "provision": lambda c: provision.provision(
        c.warehouse.dim, c.warehouse.fact, c.warehouse.event, c.spec
    ),
    "provision_movement": lambda c: c.store.provision_movement(),
    # quality
    "dq_rules": lambda c: c.store.rules(),
    "dq_reconciliation": lambda c: c.store.reconciliation_by_dimension(),
    "dq_score": lambda c: quality.quality_score(quality.latest_rules(c.register)),
    "dq_history": lambda c: quality.register_history(c.register),
    "dq_latest_run": lambda c: quality.latest_rules(c.register),
    "dq_latest": lambda c: quality.failing_rules(c.register),
    # faults that only later writers can make
    "faulty_rules": lambda c: quality.rule_findings(*c.faulty.inputs(), c.spec),
    "faulty_keys": lambda c: c.faulty.duplicate_keys(),
    "faulty_reconciliation": lambda c: quality.reconciliation_by_dimension(
        c.faulty.segments, c.faulty.summary, c.spec
    ),
    # bucketed by loan
    "bucketed_roll_rates": _bucketed_roll_rates,
    "bucketed_duplicates": lambda c: c.bucketed.duplicate_keys(),
    "bucketed_exposure": lambda c: c.bucketed.exposure_by_origination(),
    # SQL functions
    "sql_provision": lambda c: c.sql(
        "SELECT * FROM provision() UNION ALL SELECT * FROM provision(0.45D, 90D, 8)"
    ),
    "sql_movement": lambda c: c.sql("SELECT * FROM provision_movement(lgd => 0.45D, stage2_ltv => 90D, horizon => 8)"),
    "sql_stage2": lambda c: c.sql(
        "SELECT 80D AS ltv, * FROM stage2_share(80D) UNION ALL SELECT 100D, * FROM stage2_share()"
    ),
    "sql_movers": lambda c: c.sql("SELECT * FROM top_mover_default(min_active => 10L)"),
    "sql_segments": lambda c: c.sql(
        "SELECT * FROM segments_of('Credit score band', array('1. <620', '6. 780+'))"
    ),
    "sql_vintages": lambda c: c.sql("SELECT * FROM vintage_curve(array('1995Q2', '1996Q4'), 50D)"),
    # commentary
    "movement_facts": lambda c: c.store.movement_facts(),
    "top_mover_growth": lambda c: commentary.top_mover_growth(
        c.report(SEGMENTS), c.report(SUMMARY), c.spec
    ),
    "top_mover_default": lambda c: commentary.top_mover_default(c.report(SEGMENTS), c.spec),
    "stage2_share": lambda c: c.store.stage2_share(),
    "commentary_lines": lambda c: c.store.commentary_lines(c.register),
    "commentary_files": lambda c: c.commentary_files,
    # exports
    "export_segments": lambda c: c.exported,
    # dashboard datasets
    "slicer_values": lambda c: insights.slicer_values(c.warehouse.dim),
    "headline_kpis": lambda c: insights.headline(c.report(SUMMARY), c.report(MOVEMENT)),
    "segment_mix": lambda c: insights.segment_mix(c.report(SEGMENTS), score_bands=SHOWN_BANDS),
    "status_pivot": lambda c: insights.status_pivot(c.report("vw_delinquency")),
    "roll_matrix": lambda c: insights.roll_matrix(c.report("vw_roll_rates")),
    "vintage_pivot": lambda c: insights.vintage_pivot(
        c.report(CURVES), [BENIGN, STRESSED], MIN_OBSERVED_PCT
    ),
    # profiles
    "profile_shape": lambda c: profiling.shape(c.warehouse.panel),
    "profile_nulls": lambda c: profiling.missing_values(c.warehouse.panel),
    "profile_term": lambda c: profiling.common_terms(c.warehouse.panel),
    "profile_status": lambda c: profiling.status_counts(c.warehouse.panel),
    "profile_final_status": lambda c: profiling.final_status(c.warehouse.panel),
    "profile_macro_means": lambda c: profiling.macro_means(c.warehouse.panel),
    "profile_macro_peaks": lambda c: profiling.macro_peaks(c.warehouse.panel),
    "profile_vintage_default": lambda c: profiling.default_by_vintage(
        c.warehouse.panel, COHORT_MIN_ENTITIES
    ),
    "profile_dupes_gaps": lambda c: profiling.duplicates_and_gaps(c.warehouse.panel),
    # insights
    "insight_band_cohort": lambda c: insights.band_by_cohort(c.warehouse.dim, c.warehouse.event),
    "insight_collateral": lambda c: insights.collateral_by_ltv(c.report("vw_loss_recovery")),
    "insight_equal_age": lambda c: insights.equal_age(c.report(CURVES), BENIGN, STRESSED),
    "insight_time_to_default": lambda c: insights.time_to_default(
        c.warehouse.event, c.report(CURVES)
    ),
    "insight_balance_rise": lambda c: insights.balance_rise_by_vintage(
        c.warehouse.fact, c.spec, ORIGINATION_YEARS
    ),
}


def _runner(query: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(context(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(query) for name, query in QUERIES.items()}
