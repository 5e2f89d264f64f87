"""One reporting cycle: ingest, rules, commentary, export."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import quality
from ledgerloom.plans.reporting import REPORTS, SORT_KEYS, ReportStore
from ledgerloom.plans.warehouse import build_warehouse
from ledgerloom.sources import sinks
from ledgerloom.sources.landing import REASONS, Landing
from ledgerloom.sources.panel import schema_profile
from ledgerloom.spec import INGEST_PHASE, QUALITY_PHASE, PanelSpec


def run_cycle(
    source: DataFrame | Landing,
    spec: PanelSpec,
    folder: str,
    run_at: datetime.datetime,
    period: int | None = None,
) -> ReportStore:
    """Rebuild the warehouse and reports under ``folder`` from a source panel or a landed source.

    ``run_at`` starts a folder of its own for the run's tables, since written
    reports are inputs of later steps, and stamps its findings. The register is
    shared by all runs and only grows; a run repeated with its stamp replaces itself.
    Commentary is written for ``period``, the latest one by default, and a period
    without data is an error. Reports and tables are exported as CSV in the order of
    their keys, with the profile of the source, row counts and the quality score. Rows that
    a landing rejected are one more finding of the ingest, and are exported too.
    """
    landed = isinstance(source, Landing)
    panel = source.accepted if landed else source
    spark: SparkSession = panel.sparkSession
    run = f"{folder}/run={run_at:%Y%m%dT%H%M%S}"
    register_path = f"{folder}/dq_results"
    warehouse = build_warehouse(panel, spec, f"{run}/warehouse")
    store = ReportStore(warehouse, f"{run}/reports")
    summary = store.report("vw_portfolio_summary")
    if period is None:
        period = summary.agg(F.max("period")).first()[0]
    elif summary.where(F.col("period") == period).isEmpty():
        raise ValueError(f"no data for period {period}")
    ingest = store.ingest_findings().unionByName(store.long_gap_finding())
    if landed:
        ingest = ingest.unionByName(quality.rejected_finding(spark, source.counts, REASONS))
    # The rules come second and need a later stamp to be the newest run.
    for phase, findings, at in (
        (INGEST_PHASE, ingest, run_at),
        (QUALITY_PHASE, store.rules(verify=True), run_at + datetime.timedelta(milliseconds=1)),
    ):
        sinks.append_register(quality.register_rows(findings, phase, at), register_path)
    register = sinks.read_register(spark, register_path)
    lines = store.commentary_lines(register, f"{run_at:%Y-%m-%d %H:%M}", period)
    sinks.write_commentary(lines, f"{run}/commentary")
    exported = {
        **{name: store.report(name) for name in REPORTS},
        "dim_loan": warehouse.dim_loan,
        "dim_date": warehouse.periods,
        "fact_credit_event": warehouse.fact_credit_event,
        "dq_results": register,
    }
    checks = {
        "source_profile": schema_profile(panel),
        "manifest": store.manifest({"dq_results": register}),
        "dq_score": quality.quality_score(quality.latest_rules(register)),
    }
    if landed:
        checks["rejected_source_rows"] = source.rejected
    sinks.export_csv({**exported, **checks}, f"{run}/export", SORT_KEYS)
    return store
