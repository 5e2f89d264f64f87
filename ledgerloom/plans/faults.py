"""Published tables with faults that a build never makes, for rules that guard against them.

The build removes copies, keeps every period and derives segments and totals from the
same rows, so three rules cannot fail on what it writes. They are there for what
happens later: rows appended twice, a period that was lost, a figure changed by hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.reporting import ReportStore
from ledgerloom.sources.sinks import counted

# Loan-periods with a copy (and those of them with two): multiplier, modulus.
COPIED, COPIED_TWICE = (7, 113), (7, 226)
LOST_PERIOD = 12
CHANGED_SEGMENT, CHANGED_PERIODS, CHANGE = "Occupancy", (9, 4), 1000.0


@dataclass(frozen=True)
class Faulty:
    dim: DataFrame
    fact: DataFrame
    periods: DataFrame
    segments: DataFrame
    summary: DataFrame

    def inputs(self) -> tuple[DataFrame, ...]:
        """In the order in which the rules take them."""
        return self.dim, self.fact, self.periods, self.segments, self.summary

    def duplicate_keys(self) -> DataFrame:
        keys = self.fact.groupBy("loan_id", "period").agg(F.count("*").alias("copies"))
        return keys.where("copies > 1")


def write_faulty(store: ReportStore, path: str) -> Faulty:
    """Copies some rows of the fact, loses a period and changes some segment balances."""
    w = store.warehouse
    fact = w.fact_loan_quarter.where(F.col("period") != LOST_PERIOD)

    def chosen(times: int, modulus: int):
        return (F.col("loan_id") * times + F.col("period")) % modulus == 0

    copies = F.lit(1) + chosen(*COPIED).cast("int") + chosen(*COPIED_TWICE).cast("int")
    repeated = fact.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")
    segments, summary = store.report("vw_segment_performance"), store.report("vw_portfolio_summary")
    modulus, rest = CHANGED_PERIODS
    is_changed = (F.col("segment_type") == CHANGED_SEGMENT) & (F.col("period") % modulus == rest)
    balance = F.col("active_balance") + F.when(is_changed, CHANGE).otherwise(0.0)

    def write(name: str, rows: DataFrame) -> DataFrame:
        return counted(rows, f"{path}/{name}")[0]

    return Faulty(
        w.dim,
        write("fact_loan_quarter", repeated),
        write("dim_date", w.periods.where(F.col("period") != LOST_PERIOD)),
        write("vw_segment_performance", segments.withColumn("active_balance", balance)),
        summary,
    )
