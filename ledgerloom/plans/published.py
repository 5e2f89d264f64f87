"""A warehouse and its reports that readers see whole, whatever the next build does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import prepare
from ledgerloom.plans.reporting import REPORTS, ReportStore
from ledgerloom.plans.warehouse import build_warehouse
from ledgerloom.sources import sinks
from ledgerloom.sources.versions import Versions
from ledgerloom.spec import PanelSpec

TABLES = {
    "dim_loan": prepare.DIM_COLUMNS,
    "fact_loan_quarter": prepare.FACT_COLUMNS,
    "fact_credit_event": prepare.EVENT_COLUMNS,
    "dim_date": (),
    "dim_period_macro": (),
}


@dataclass(frozen=True)
class Published:
    """One committed build: its number, and its tables and reports by name."""

    number: int
    tables: dict[str, DataFrame]

    def create_views(self) -> list[str]:
        """Views of this build. They keep showing it until they are created anew."""
        return sinks.create_views(self.tables)


def publish(panel: DataFrame, spec: PanelSpec, root: str, keep: int | None = None) -> Published:
    """Build warehouse and reports below ``root`` and commit them as its newest build.

    Everything is written to a new folder first. Whatever fails on the way, or if another
    build was committed meanwhile, readers keep the last commit. ``keep`` deletes all
    but so many of the newest builds afterwards.
    """
    spark = panel.sparkSession
    versions = Versions(spark, root)
    build = versions.begin()
    store = ReportStore(build_warehouse(panel, spec, f"{build.folder}/tables"), f"{build.folder}/reports")
    # Reports are written as they are first asked for, and the manifest asks for all.
    sinks.counted(store.manifest().coalesce(1), f"{build.folder}/tables/manifest")
    number = versions.commit(build)
    if keep is not None:
        versions.expire(keep)
    return open_published(spark, root, number)


def open_published(spark: SparkSession, root: str, number: int | None = None) -> Published:
    """The newest committed build below ``root``, or the one with ``number``."""
    versions = Versions(spark, root)
    number = versions.latest() if number is None else number
    folder = versions.folder(number)
    found = {name: spark.read.parquet(f"{folder}/reports/{name}") for name in REPORTS}
    for name, columns in TABLES.items():
        table = spark.read.parquet(f"{folder}/tables/{name}")
        found[name] = table.select(*columns) if columns else table
    found["manifest"] = spark.read.parquet(f"{folder}/tables/manifest")
    return Published(number, found)
