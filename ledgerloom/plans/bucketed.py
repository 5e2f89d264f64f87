"""The fact and the loans as tables bucketed by loan.

Rows of a loan lie in the same bucket of both tables, so a join or a grouping by loan
reads matching buckets and moves nothing. Writing them costs one shuffle of each table,
which every later join by loan saves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import exact_sum
from ledgerloom.operators import migration, prepare, quality
from ledgerloom.plans.warehouse import Warehouse
from ledgerloom.spec import PanelSpec

# Rows of the larger table in a bucket: some 100 MB of a fact, sorted by one task.
BUCKET_ROWS = 2_000_000
_SUBSET_OF_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def bucket_count(rows: int, at_least: int) -> int:
    """A power of two, so that tables of different sizes can be given related numbers."""
    return 1 << max(0, max(at_least, -(-rows // BUCKET_ROWS)) - 1).bit_length()


def save(df: DataFrame, name: str, path: str, buckets: int, key: str, *order: str) -> DataFrame:
    """``df`` as a table of ``buckets`` files by ``key``, sorted by key and ``order``.

    Rows are dealt out as the buckets are, so each bucket is written by one task into one
    file. The table is the session's; its files stay where ``path`` says.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key, *order)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


@contextmanager
def copartitioned(spark: SparkSession) -> Iterator[None]:
    """Let rows that lie together by loan be joined by loan and period where they are.

    By default a join wants both sides dealt out by all its keys. Plans are made when a
    job starts, so the jobs themselves belong inside.
    """
    before = spark.conf.get(_SUBSET_OF_KEYS, None)
    spark.conf.set(_SUBSET_OF_KEYS, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SUBSET_OF_KEYS)
        else:
            spark.conf.set(_SUBSET_OF_KEYS, before)


@dataclass(frozen=True)
class BucketedTables:
    """Published fact and loans, bucketed alike."""

    spec: PanelSpec
    dim: DataFrame
    fact: DataFrame

    def roll_rates(self) -> DataFrame:
        """Transitions by a self-join of the fact; run it in ``copartitioned``."""
        return migration.roll_rates_selfjoin(self.fact, self.spec)

    def duplicate_keys(self) -> DataFrame:
        """Loan-periods the fact has more than once."""
        return quality.duplicate_keys(self.fact)

    def exposure_by_origination(self) -> DataFrame:
        """Rows and balance by period and attributes that only the loans have."""
        rows = self.fact.select("loan_id", "period", "current_balance").join(
            self.dim.select("loan_id", "property_type", "original_term_quarters"), "loan_id"
        )
        return rows.groupBy("period", "property_type", "original_term_quarters").agg(
            F.count("*").alias("loans"),
            exact_sum(F.col("current_balance"), self.spec.money_type).cast("double").alias("balance"),
        )


def save_tables(warehouse: Warehouse, path: str, buckets: int | None = None) -> BucketedTables:
    """Write the published tables of a warehouse below ``path``.

    ``buckets`` follows the rows of the fact, and is as many as the session's shuffles
    have at least.
    """
    spark = warehouse.fact.sparkSession
    if buckets is None:
        known = (warehouse.counts or {}).get("fact_loan_quarter")
        rows = known["rows"] if known else warehouse.fact.count()
        buckets = bucket_count(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mark = uuid.uuid4().hex
    return BucketedTables(
        warehouse.spec,
        save(
            prepare.published(warehouse.dim, prepare.DIM_COLUMNS),
            f"ledgerloom_dim_{mark}", f"{path}/dim_loan", buckets, "loan_id",
        ),
        save(
            prepare.published(warehouse.fact, prepare.FACT_COLUMNS),
            f"ledgerloom_fact_{mark}", f"{path}/fact_loan_quarter", buckets, "loan_id", "period",
        ),
    )
