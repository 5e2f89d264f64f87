"""Reports by name over one warehouse, and the reporting cycle."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ledgerloom.operators import commentary, loss, migration, portfolio, provision, quality, vintage
from ledgerloom.plans.warehouse import Warehouse
from ledgerloom.sources import sinks

# Every report, in the order in which they are published.
REPORTS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "vw_portfolio_summary": lambda w: portfolio.portfolio_summary(w.fact, w.spec),
    "vw_segment_performance": lambda w: portfolio.segment_performance(w.fact, w.spec),
    "vw_delinquency": lambda w: portfolio.status_mix(w.fact, w.spec),
    "vw_roll_rates": lambda w: migration.roll_rates(w.fact, w.spec),
    "vw_vintage_performance": lambda w: vintage.vintage_curves(w.dim, w.fact, w.event, w.spec),
    "vw_loss_recovery": lambda w: loss.loss_exposure(w.event, w.spec),
    "vw_provision": lambda w: provision.provision(w.dim, w.fact, w.event, w.spec),
    "vw_provision_movement": lambda w: provision.provision_movement(
        provision.provision(w.dim, w.fact, w.event, w.spec), w.spec
    ),
}

# Keys by which exports are sorted; they are unique in each report.
SORT_KEYS = {
    "vw_portfolio_summary": ("period",),
    "vw_segment_performance": ("segment_type", "segment_value", "period"),
    "vw_delinquency": ("segment_type", "segment_value", "period", "status_bucket"),
    "vw_roll_rates": ("from_period", "from_status", "to_status"),
    "vw_vintage_performance": ("origination_vintage", "quarters_on_book"),
    "vw_loss_recovery": ("segment_type", "segment_value"),
    "vw_provision": ("period", "ifrs9_stage", "credit_score_band"),
    "vw_provision_movement": ("period",),
    "dim_loan": ("loan_id",),
    "dim_date": ("period",),
    "fact_credit_event": ("loan_id",),
    "dq_results": ("run_timestamp", "phase", "rule_name"),
    "manifest": ("object",),
}


def tables(warehouse: Warehouse) -> dict[str, DataFrame]:
    """Published warehouse tables."""
    return {
        "dim_loan": warehouse.dim_loan,
        "fact_loan_quarter": warehouse.fact_loan_quarter,
        "fact_credit_event": warehouse.fact_credit_event,
        "dim_date": warehouse.periods,
        "dim_period_macro": warehouse.macro,
    }


def create_views(store: ReportStore) -> list[str]:
    """Temporary views of the tables and of the written reports.

    A filter on a report's view reads that small report, not the fact again.
    """
    reports = {name: store.report(name) for name in REPORTS}
    return sinks.create_views({**tables(store.warehouse), **reports})


class ReportStore:
    """Reports written once and read by whatever is built on them.

    Commentary, dashboards and cohort comparisons read a handful of reports
    each. A report is small, so it is written next to the warehouse on first
    use instead of scanning the fact again for every consumer.
    """

    def __init__(self, warehouse: Warehouse, path: str):
        self.warehouse = warehouse
        self.path = path
        self._written: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def report(self, name: str) -> DataFrame:
        if name == "vw_provision_movement":
            return self._once(name, self.provision_movement)
        return self._once(name, lambda: REPORTS[name](self.warehouse))

    def provision_movement(self) -> DataFrame:
        return provision.provision_movement(self.report("vw_provision"), self.warehouse.spec)

    def stage2_share(self) -> DataFrame:
        return provision.stage2_share(self.report("vw_provision"), self.warehouse.spec)

    def reconciliation_by_dimension(self) -> DataFrame:
        return quality.reconciliation_by_dimension(
            self.report("vw_segment_performance"),
            self.report("vw_portfolio_summary"),
            self.warehouse.spec,
        )

    def rules(self, verify: bool = False) -> DataFrame:
        """Findings of the ten rules, evaluated now.

        With ``verify``, duplicate keys are counted in the published fact as it stands,
        whatever has been appended to it, at the price of a shuffle by loan and period.
        """
        w = self.warehouse
        return quality.rule_findings(
            w.dim,
            w.fact,
            w.periods,
            self.report("vw_segment_performance"),
            self.report("vw_portfolio_summary"),
            w.spec,
            w.fact_loan_quarter if verify else None,
        )

    def ingest_findings(self) -> DataFrame:
        """From what the build counted as it wrote, if it did."""
        w = self.warehouse
        if w.counts:
            spark = w.fact.sparkSession
            return quality.counted_findings(spark, w.counts["dim_loan"], w.counts["fact_loan_quarter"])
        return self._once(
            "ingest_findings", lambda: quality.ingest_findings(w.panel, w.dim, w.fact)
        )

    def long_gap_finding(self) -> DataFrame:
        return quality.long_gap_finding(self.warehouse.fact, self.warehouse.spec)

    def manifest(self, more: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """Rows of every table and report, as counted when they were written.

        Tables in ``more`` are counted by reading them; so are all others of a warehouse
        that was not written.
        """
        w = self.warehouse
        for name in REPORTS:
            self.report(name)
        rows = {name: self._rows[name] for name in REPORTS}
        read = {**(more or {})}
        if w.counts:
            rows |= {name: counts["rows"] for name, counts in w.counts.items()}
        else:
            read |= tables(w)
        known = w.fact.sparkSession.createDataFrame(list(rows.items()), "object string, rows long")
        return known.unionByName(sinks.manifest(read)) if read else known

    def rule_findings(self) -> DataFrame:
        return self._once("rule_findings", self.rules)

    def register(self, name: str, runs: list[tuple[str, datetime.datetime]]) -> DataFrame:
        """Register after the given (phase, timestamp) runs, appended in order."""
        if name not in self._written:
            path = f"{self.path}/{name}"
            findings = {
                quality.INGEST_PHASE: self.ingest_findings,
                quality.QUALITY_PHASE: self.rule_findings,
            }
            for phase, run_at in runs:
                sinks.append_register(
                    quality.register_rows(findings[phase](), phase, run_at), path
                )
            self._written[name] = sinks.read_register(self.warehouse.fact.sparkSession, path)
        return self._written[name]

    def movement_facts(self) -> DataFrame:
        return commentary.movement_facts(
            self.report("vw_portfolio_summary"),
            self.report("vw_provision_movement"),
            self.warehouse.spec,
        )

    def commentary_lines(
        self, register: DataFrame, generated: str | None = None, period: int | None = None
    ) -> DataFrame:
        w = self.warehouse
        segments = self.report("vw_segment_performance")
        summary = self.report("vw_portfolio_summary")
        return commentary.commentary_lines(
            self.movement_facts(),
            commentary.top_mover_growth(segments, summary, w.spec),
            commentary.top_mover_default(segments, w.spec),
            self.stage2_share(),
            quality.failing_rules(register),
            generated,
            period,
        )

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._written:
            self._written[name], counts = sinks.counted(build(), f"{self.path}/{name}")
            self._rows[name] = counts["rows"]
        return self._written[name]
