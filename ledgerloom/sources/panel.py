"""Reading and checking a source panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.spec import PANEL_SCHEMA, STATUS_LABELS, VALID_SCORE


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header. Columns are taken by name, whatever their order."""
    raw = spark.read.option("header", True).csv(path)
    return conform(raw)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def conform(raw: DataFrame) -> DataFrame:
    """Required columns in their declared types; extra columns are dropped.

    A whole number may be written with a point (``3.0``) or an exponent. Text that is no
    number, or has a fraction where a whole number belongs, is an error.
    """
    verify_columns(raw)
    return raw.select(
        [
            (
                _whole_number(f.name)
                if f.dataType == T.LongType() and raw.schema[f.name].dataType == T.StringType()
                else F.col(f.name).cast(f.dataType)
            ).alias(f.name)
            for f in PANEL_SCHEMA
        ]
    )


def _whole_number(name: str) -> Column:
    number = F.trim(F.col(name)).cast("decimal(38,9)")
    whole = number.cast("long")
    return F.when(number != whole, F.raise_error(F.concat(
        F.lit(f"{name} is not a whole number: "), F.col(name)
    )).cast("long")).otherwise(whole)


def verify_columns(raw: DataFrame) -> None:
    """Raise when a required column is absent; extra columns are tolerated."""
    missing = [name for name in PANEL_SCHEMA.names if name not in raw.columns]
    if missing:
        raise ValueError(
            f"panel lacks required columns {missing}; it has {raw.columns}"
        )


def schema_profile(panel: DataFrame) -> DataFrame:
    """Size, period range and out-of-range counts of a panel, in one pass."""
    low, high = VALID_SCORE
    return panel.agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("entities"),
        F.min("time").alias("first_period"),
        F.max("time").alias("last_period"),
        F.count_if(~F.col("status_time").isin(*STATUS_LABELS)).alias("bad_status"),
        F.count_if(~F.col("FICO_orig_time").between(low, high)).alias("bad_score"),
        F.count_if(F.col("balance_time") < 0).alias("negative_balance"),
    )
