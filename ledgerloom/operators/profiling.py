"""Profiles of a source panel before preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ordered
from ledgerloom.functions.columns import percent, ratio, rounded
from ledgerloom.spec import DEFAULT, PANEL_SCHEMA, STATUS_LABELS


def shape(panel: DataFrame) -> DataFrame:
    rows, entities = F.count("*"), F.count_distinct("id")
    return panel.agg(
        rows.alias("rows"),
        entities.alias("entities"),
        rounded(ratio(rows, entities), 1).alias("rows_per_entity"),
    )


def missing_values(panel: DataFrame) -> DataFrame:
    """Missing count and type of every column, from one pass."""
    counts = panel.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in PANEL_SCHEMA.names])
    types = F.create_map(
        *[F.lit(x) for f in PANEL_SCHEMA for x in (f.name, f.dataType.simpleString())]
    )
    return counts.unpivot([], PANEL_SCHEMA.names, "column_name", "missing").select(
        "column_name", types[F.col("column_name")].alias("data_type"), "missing"
    )


def common_terms(panel: DataFrame, top: int = 8) -> DataFrame:
    """Most frequent terms in periods; ties go to the shorter term."""
    return (
        panel.groupBy((F.col("mat_time") - F.col("orig_time")).alias("term"))
        .agg(F.count("*").alias("rows"))
        .where(F.col("term").isNotNull())
        .orderBy(F.desc("rows"), "term")
        .limit(top)
    )


def status_counts(panel: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return (
        panel.where(F.col("status_time").isNotNull())
        .groupBy("status_time")
        .agg(F.count("*").alias("rows"))
        .withColumn("label", F.try_element_at(labels, F.col("status_time").cast("int")))
    )


def _entity_ends(panel: DataFrame) -> DataFrame:
    """First origination period and last status of each entity, ignoring NULLs.

    First and last are by period, a missing one before all others; in one period the
    lowest origination and the highest status count. Reports are cut to one row a
    period first, so that then a value belongs to its period alone; both steps keep
    longs in hash tables.
    """
    reports = panel.groupBy("id", "time").agg(
        F.min("orig_time").alias("orig_time"), F.max("status_time").alias("status_time")
    )
    time = F.col("time")

    def of(value: str, pick) -> Column:
        return pick(value, F.when(F.col(value).isNotNull(), time))

    def undated(value: str) -> Column:
        return F.min(F.when(time.isNull(), F.col(value)))

    return reports.groupBy("id").agg(
        F.coalesce(undated("orig_time"), of("orig_time", F.min_by)).alias("orig_time"),
        F.coalesce(of("status_time", F.max_by), undated("status_time")).alias("final_status"),
    )


def final_status(panel: DataFrame) -> DataFrame:
    """Distribution of entities over their last status, in percent."""
    counts = (
        _entity_ends(panel)
        .where(F.col("final_status").isNotNull())
        .groupBy("final_status")
        .agg(F.count("*").alias("entities"))
    )
    # One row per status code is left, so the unpartitioned total is tiny.
    everything = F.sum("entities").over(Window.partitionBy())
    return counts.select(
        "final_status",
        "entities",
        rounded(percent(F.col("entities"), everything), 1).alias("pct_of_entities"),
    )


MACRO_MEASURES = {
    "uer_time": "unemployment_rate",
    "hpi_time": "house_price_index",
    "gdp_time": "gdp_growth",
}


def macro_means(panel: DataFrame) -> DataFrame:
    """Mean covariates per period, to two places."""

    def mean(column: str):
        total = F.sum(F.col(column).cast("decimal(18,6)"))
        return rounded(ratio(total, F.count(column)), 2)

    return panel.groupBy(F.col("time").alias("period")).agg(
        *[mean(column).alias(name) for column, name in MACRO_MEASURES.items()]
    )


def macro_peaks(panel: DataFrame) -> DataFrame:
    """Highest mean of each covariate and the first period that has it."""
    series = (
        macro_means(panel)
        .unpivot(["period"], list(MACRO_MEASURES.values()), "measure", "value")
        .where(F.col("value").isNotNull())
    )
    peak = F.max(F.struct("value", (-F.col("period")).alias("earliest")))
    return series.groupBy("measure").agg(peak.alias("peak")).select(
        "measure",
        (-F.col("peak.earliest")).alias("peak_period"),
        F.col("peak.value").alias("peak_value"),
    )


def default_by_vintage(
    panel: DataFrame, min_entities: int = 300, first: int = 1, last: int = 60
) -> DataFrame:
    """Final default share of origination periods with enough entities."""
    return (
        _entity_ends(panel)
        .where(F.col("orig_time").between(first, last))
        .groupBy("orig_time")
        .agg(
            F.count("*").alias("entities"),
            rounded(
                percent(F.count_if(F.col("final_status") == DEFAULT), F.count("*")), 1
            ).alias("default_pct"),
        )
        .where(F.col("entities") >= min_entities)
    )


def duplicates_and_gaps(panel: DataFrame) -> DataFrame:
    """Extra copies of entity-periods, and entities whose rows miss their span.

    Rows are counted per entity-period first, so the step by entity sees at
    most one row per period.
    """
    entities = (
        panel.groupBy("id", "time")
        .agg(F.count("*").alias("copies"))
        .groupBy("id")
        .agg(
            F.sum("copies").alias("rows"),
            F.sum(F.col("copies") - 1).alias("extra"),
            (F.max("time") - F.min("time") + 1).alias("span"),
        )
    )
    return entities.agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("rows") != F.col("span")).alias("entities_with_gaps"),
    )
