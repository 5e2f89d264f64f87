"""Exposure and collateral position at default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import exact_mean, exact_sum, percent, ratio
from ledgerloom.operators.segments import long_segments
from ledgerloom.spec import SEGMENT_DIMENSIONS, PanelSpec


def loss_exposure(event: DataFrame, spec: PanelSpec) -> DataFrame:
    """Defaults per segment and in total.

    Loss severity stays NULL: panels carry no recoveries to measure it from.
    """
    rows = long_segments(
        event,
        [
            "exposure_at_default",
            "ltv_at_default",
            "quarters_on_book_at_default",
            "original_balance",
        ],
        SEGMENT_DIMENSIONS,
        total=True,
    )
    exposure = exact_sum(F.col("exposure_at_default"), spec.money_type)
    age = F.col("quarters_on_book_at_default")
    return rows.groupBy("segment_type", "segment_value").agg(
        F.count("*").alias("defaults"),
        exposure.cast("double").alias("total_exposure_at_default"),
        ratio(exposure, F.count("exposure_at_default")).alias("avg_exposure_at_default"),
        exact_mean(F.col("ltv_at_default"), spec.measure_type).alias("avg_ltv_at_default"),
        percent(F.count_if(F.col("ltv_at_default") > 100), F.count("*")).alias(
            "pct_underwater_at_default"
        ),
        ratio(F.sum(age), F.count(age)).alias("avg_quarters_on_book_at_default"),
        percent(exposure, exact_sum(F.col("original_balance"), spec.money_type)).alias("exposure_as_pct_of_original"),
        F.lit(None).cast("double").alias("loss_severity_pct"),
    )
