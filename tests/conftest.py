from __future__ import annotations

import os
import sys
from dataclasses import replace

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from panel_rows import DEFAULTS, SMALL  # noqa: E402

from ledgerloom.operators import prepare  # noqa: E402
from ledgerloom.plans.warehouse import lazy_warehouse  # noqa: E402
from ledgerloom.spec import PANEL_SCHEMA, PanelSpec  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        # A task may fail once, as on a cluster.
        SparkSession.builder.master("local[4, 2]")
        .appName("ledgerloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Plan tests read scans in full.
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.debug.maxToStringFields", "200")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    def make(*rows: dict):
        unknown = {k for row in rows for k in row} - DEFAULTS.keys()
        assert not unknown, unknown
        values = [[{**DEFAULTS, **row}[c] for c in PANEL_SCHEMA.names] for row in rows]
        return spark.createDataFrame(values, PANEL_SCHEMA)

    return make


@pytest.fixture(scope="session")
def make_warehouse(make_panel):
    def make(*rows: dict, spec: PanelSpec = PanelSpec()):
        lazy = lazy_warehouse(make_panel(*rows), spec)
        # Cached, since reports read these few rows again and again.
        dim, fact = lazy.dim.cache(), lazy.fact.cache()
        return replace(
            lazy,
            dim=dim,
            fact=fact,
            event=prepare.event_rows(fact),
            periods=prepare.period_rows(fact, spec),
        )

    return make


@pytest.fixture(scope="session")
def small(spark):
    """Warehouse and reports over the smallest source tables."""
    from ledgerloom.plans import catalog

    return catalog.context(spark, SMALL)


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column expression over single literals."""

    def evaluate(build, items, kind):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
        rows = df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()
        return [row["r"] for row in rows]

    return evaluate
