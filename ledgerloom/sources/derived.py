"""A credit panel derived from order tables.

Spells of customers play the loans and shipping quarters play the reporting
periods, so the panel has natural duplicates and gaps, and a row for every line
that has an order and a customer. Outcome and origination attributes are
functions of the entity id. Some values are missing or wrong on purpose, so that
every rule on rows and every NULL case has something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.spec import PANEL_SCHEMA, PanelSpec

# Fixed values of the derived panel.
FIRST_YEAR = 1995
BENIGN_VINTAGE, STRESSED_VINTAGE = 2, 8

DERIVED_SPEC = PanelSpec(
    calendar_anchor=(FIRST_YEAR, 1),
    focus_cohorts=((BENIGN_VINTAGE, "Benign cohort"), (STRESSED_VINTAGE, "Stressed cohort")),
    # Balances of the derived panel have three places, loan-to-value has five.
    money_scale=4,
    measure_scale=6,
    long_gap=6,
)


# Spells of one customer: one before the customer's first regular quarter, then one
# after another. Ids leave room for this many.
SPELLS = 64


def shipped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped lines by entity and quarter: ``lineitem`` and ``orders``, joined once.

    An entity is a spell of a customer, so every line has one and none is left out.
    No broadcast hints: both tables grow with the data, so the planner decides by size.
    """
    quarter = (F.year("l_shipdate") - FIRST_YEAR) * 4 + F.quarter("l_shipdate")
    # Quarters are shuffled instead of times: they take less.
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey",
        quarter.cast("long").alias("time"),
        "l_linenumber",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    regular = F.expr("1 + customer % 12")
    spell = F.when(F.col("time") < regular, 0).otherwise(
        F.expr("1 + (time - 1 - customer % 12) div (5 + customer % 20)")
    )
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("customer"),
            "time",
            "l_linenumber",
            "l_extendedprice",
            "l_discount",
            "l_tax",
        )
        .withColumn("id", F.col("customer") * SPELLS + spell)
        .drop("customer")
    )


def entities_from_rows(rows: DataFrame, customer: DataFrame) -> DataFrame:
    """Entities with their first and last period and their customer's attributes."""
    presence = rows.groupBy("id").agg(F.min("time").alias("mn"), F.max("time").alias("mx"))
    owner = F.expr(f"id div {SPELLS}") == F.col("c_custkey")
    return presence.join(customer, owner).select("id", "mn", "mx", "c_nationkey", "c_mktsegment")


def panel_from_rows(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Source panel over written ``rows`` and ``entities``.

    Read from storage, both sides are shuffled for the join, and only then can adaptive
    execution split the rows of an entity that holds much of the panel.
    """
    return rows.join(entities, "id").select(_panel_columns())


def _panel_columns() -> list:
    entity, time = F.col("id"), F.col("time")
    outcome = entity % 10
    # Some reports lack a status, have one without a label, or leave a default again.
    status = (
        F.when((entity + time * 5) % 103 == 0, None)
        .when((entity + time * 11) % 307 == 0, 7)
        .when((entity % 41 == 0) & (time == F.col("mn") + 1), 1)
        .when((time < F.col("mx")) | (outcome >= 7), 0)
        .when(outcome < 3, 1)
        .otherwise(2)
    )
    # Missing, negative and tied balances; the others have a third place.
    balance = (
        F.when((entity + time) % 97 == 0, None)
        .when((entity * 7 + time) % 211 == 0, -0.004)
        .when(entity % 25 == 0, F.lit(50000.0) + entity % 1000)
        .otherwise(F.col("l_extendedprice") + F.col("l_linenumber") / F.lit(1000.0))
    )
    # 2% of entities report a second origination period on some rows.
    restated = ((entity % 50 == 0) & (F.col("l_linenumber") >= 4)).cast("long")
    original_ltv = F.lit(40.0) + (entity * 37 % 800) / F.lit(10.0)
    original_rate = F.lit(3.0) + (entity % 40) / F.lit(10.0)
    house_prices = F.lit(100.0) + F.lit(3.0) * time - F.lit(0.1) * time * time
    start = F.col("mn") - entity % 5
    current_ltv = original_ltv * (F.lit(0.7) + F.col("l_discount") * F.lit(6.0))
    later = time > F.col("mn")
    values = {
        "id": entity,
        "time": time,
        "orig_time": start + restated,
        "first_time": F.col("mn"),
        "mat_time": start + 120,
        "balance_time": balance,
        "LTV_time": F.when(
            (entity + time * 2) % 89 != 0, current_ltv + (entity % 7) / F.lit(100000.0)
        ),
        "interest_rate_time": F.when(
            (entity + time * 3) % 101 != 0, original_rate + F.col("l_tax") * F.lit(10.0)
        ),
        "hpi_time": house_prices,
        "gdp_time": F.lit(2.0) - (time % 5) * F.lit(0.3),
        "uer_time": F.lit(4.0) + (time % 7) * F.lit(0.5),
        "REtype_CO_orig_time": F.col("c_mktsegment") == "MACHINERY",
        "REtype_PU_orig_time": F.col("c_mktsegment") == "HOUSEHOLD",
        "REtype_SF_orig_time": F.col("c_mktsegment") == "BUILDING",
        "investor_orig_time": F.col("c_nationkey") % 5 == 0,
        "balance_orig_time": F.when(
            ~(later & (entity % 5 == 0) & (F.col("l_linenumber") == 3)),
            100000 + entity * 7919 % 400000,
        ),
        "FICO_orig_time": F.when(entity % 29 == 0, None)
        .when((entity % 23 == 0) & (F.col("l_linenumber") == 1), None)
        .when(entity % 61 == 0, 950)
        .otherwise(500 + entity * 53 % 350),
        "LTV_orig_time": F.when(entity % 31 != 0, original_ltv),
        "Interest_Rate_orig_time": F.when(
            (entity % 37 != 0) | (F.col("l_linenumber") != 2), original_rate
        ),
        "hpi_orig_time": F.lit(100.0) + F.lit(3.0) * start - F.lit(0.1) * start * start,
        "default_time": status == 1,
        "payoff_time": status == 2,
        "status_time": status,
    }
    return [values[f.name].cast(f.dataType).alias(f.name) for f in PANEL_SCHEMA]


# Cells of the derived panel that its CSV spoils: multiplier of the id, modulus, column
# and what the cell becomes (%s: with the good value in front).
SPOILT_CELLS = (
    (1, 131, "balance_time", "n/a"),
    (3, 137, "FICO_orig_time", "7oo"),
    (5, 139, "time", "%s.5"),
    (7, 149, "LTV_time", "1e999"),
    (11, 151, "id", "9223372036854775808"),
)
# Rows cut short: multiplier, modulus and the cells that are left.
SHORT_RECORDS = (13, 157, 20)


def write_spoilt_csv(panel: DataFrame, folder: str) -> None:
    """The panel as CSV with a header, with cells and records that cannot be read.

    A record is written as one value without quotes, since no writer makes short ones.
    """

    def hit(times: int, modulus: int) -> Column:
        return (F.col("id") * times + F.col("time")) % modulus == 0

    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in panel.columns}
    for times, modulus, name, text in SPOILT_CELLS:
        spoilt = F.concat(cells[name], F.lit(text[2:])) if text.startswith("%s") else F.lit(text)
        cells[name] = F.when(hit(times, modulus), spoilt).otherwise(cells[name])
    times, modulus, left = SHORT_RECORDS
    record = F.array(*cells.values())
    record = F.when(hit(times, modulus), F.slice(record, 1, left)).otherwise(record)
    lines = panel.select(F.array_join(record, ",").alias(",".join(panel.columns)))
    lines.write.options(header=True, sep="\u0001", quote="\u0002").csv(folder)
