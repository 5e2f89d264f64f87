"""The prepared tables of one panel, lazy or written to shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import prepare, quality
from ledgerloom.sources.sinks import COMPRESSION, counted
from ledgerloom.spec import PanelSpec

# Panel rows of one task of the fact. A window and a sort hold a task's rows, some 0.5 KB
# each, in memory or spill them.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Warehouse:
    """Working tables. Use the properties below for the published columns.

    ``counts``: what was counted as each table was written, by table; None if lazy.
    """

    spec: PanelSpec
    panel: DataFrame
    dim: DataFrame
    fact: DataFrame
    event: DataFrame
    periods: DataFrame
    macro: DataFrame
    counts: Mapping[str, Mapping[str, int]] | None = None

    @property
    def dim_loan(self) -> DataFrame:
        return prepare.published(self.dim, prepare.DIM_COLUMNS)

    @property
    def fact_loan_quarter(self) -> DataFrame:
        return prepare.published(self.fact, prepare.FACT_COLUMNS)

    @property
    def fact_credit_event(self) -> DataFrame:
        return prepare.published(self.event, prepare.EVENT_COLUMNS)


def lazy_warehouse(panel: DataFrame, spec: PanelSpec) -> Warehouse:
    """All tables as one lazy plan. Small panels and tests; nothing is written."""
    dim = prepare.dim_rows(prepare.entity_attributes(panel), spec)
    macro = prepare.macro_rows(panel)
    linked = prepare.linked_rows(prepare.dedupe(panel))
    fact = prepare.fact_rows(linked, dim, macro, spec)
    return Warehouse(
        spec, panel, dim, fact, prepare.event_rows(fact), prepare.period_rows(fact, spec), macro
    )


def build_warehouse(panel: DataFrame, spec: PanelSpec, path: str) -> Warehouse:
    """Write the tables under ``path``, each from the ones written before it.

    Written tables cut the lineage: a lost executor repeats a task of one step,
    not the chain. The plan is the same for every panel.
    """
    counts: dict[str, dict[str, int]] = {}

    def write(name: str, rows: DataFrame, measures=None) -> DataFrame:
        table, counts[name] = counted(rows, f"{path}/{name}", measures)
        return table

    macro = write("dim_period_macro", prepare.macro_rows(panel))
    dim = write(
        "dim_loan", prepare.dim_rows(prepare.entity_attributes(panel), spec), quality.dim_measures()
    )
    # Tasks by rows, both sides alike: sizes in bytes tell little, since rows of one entity
    # shrink to a fraction when they are shuffled and are whole again where they are sorted.
    cores = panel.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-counts["dim_loan"]["placed"] // TASK_ROWS))
    linked = prepare.linked_rows(prepare.dedupe(panel).repartition(parts, "loan_id"))
    entities = dim.repartition(parts, "loan_id")
    # Sorted by period within each file, without a shuffle, so that a filter on the
    # period skips most of a file.
    fact_rows = prepare.fact_rows(linked, entities, macro, spec).sortWithinPartitions("period")
    fact = write("fact_loan_quarter", fact_rows, quality.fact_measures(spec))
    event = write("fact_credit_event", prepare.event_rows(fact))
    periods = write("dim_date", prepare.period_rows(fact, spec))
    return Warehouse(spec, panel, dim, fact, event, periods, macro, counts)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a parquet table at ``path``."""
    df.write.mode("overwrite").parquet(path, compression=COMPRESSION)
    # The schema is known, so reading back needs no footer inference job.
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, since a
    machine-local path is useless to the executors of a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{root.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
