"""Landing a CSV source: rows that fit go on, the others are kept apart with reasons.

One pass over the files parses every record as text, judges every cell and writes one
table: the panel's columns in their types and, for rows that cannot be used, a list of
what is wrong. Good rows have no list, so reading either part is a filter on that
column, and no bad cell, however many there are, ends the read.

A record is rejected whole: a row with one unreadable cell would otherwise enter the
panel as a row with a missing value, which means something else there. Every bad cell
is reported, so one look at the rejected rows is enough to mend a source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.panel import verify_columns
from ledgerloom.sources.sinks import compilable, counted
from ledgerloom.spec import PANEL_SCHEMA

# Why a cell or a record is rejected.
MALFORMED = "malformed record"
NOT_A_NUMBER = "not a number"
NOT_WHOLE = "not a whole number"
OUT_OF_RANGE = "out of range"
REASONS = (MALFORMED, NOT_A_NUMBER, NOT_WHOLE, OUT_OF_RANGE)

# Digits, point and exponent; names such as NaN and suffixes such as 5d are no numbers.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# What nearly all cells are: numbers that surely fit their type, for one match and one cast.
_PLAIN_WHOLE = r"^ *[+-]?[0-9]{1,18} *\z"
_PLAIN_NUMBER = r"^ *[+-]?[0-9]{1,18}(?:\.[0-9]*)?(?:[eE][+-]?[0-9]{1,2})? *\z"
_RECORD, _PROBLEMS = "_record", "_problems"
_PROBLEM = "array<struct<column_name: string, value: string, reason: string>>"


@dataclass(frozen=True)
class Landing:
    """A landed source: usable rows, rejected cells, and counts taken as it was written.

    ``rejected`` has a row for each bad cell: file, record (the line of a malformed
    record), id and time as they stand in the source, column_name, value, reason.
    """

    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def land_csv(spark: SparkSession, path: str, folder: str) -> Landing:
    """Read CSV with a header, columns by name, and write it to ``folder``.

    A blank cell is missing, not wrong. A whole number may be written with a point or an
    exponent. A record with more or fewer cells than the header is malformed, and its
    cells are not judged. Extra columns are dropped. A file whose header differs from
    the first file's is an error, since its cells cannot be named.
    """
    names = spark.read.option("header", True).csv(path).columns
    cells = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RECORD]])
    raw = (
        spark.read.schema(cells)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RECORD)
        # Else a record's length would be judged by the columns that are read.
        .option("columnPruning", False)
        .csv(path)
    )
    verify_columns(raw)
    # File names in the rows cost little: columnar files keep each name once.
    landed = judged(raw.withColumn("_file", F.input_file_name()))
    measures = {"rows_read": F.count("*"), "rows_rejected": F.count(_PROBLEMS)}
    measures |= {f"cells_{reason.replace(' ', '_')}": _cells(reason) for reason in REASONS}
    with compilable(spark):
        table, counts = counted(landed, folder, measures)
    return Landing(accepted(table), rejected(table), counts)


def read_landing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Usable rows and rejected cells of an earlier landing."""
    table = spark.read.parquet(folder)
    return accepted(table), rejected(table)


def judged(raw: DataFrame) -> DataFrame:
    """The panel's columns in their types, and what keeps a row from being used.

    A cell that a plain pattern and one cast settle costs no more; a cell's reason is
    sought only in rows with a cell that has a text and no value.
    """
    names = PANEL_SCHEMA.names
    values = {f"_value_{f.name}": _value(f) for f in PANEL_SCHEMA}
    problems, suspects = [], []
    for field in PANEL_SCHEMA:
        text, reason = F.col(f"`{field.name}`"), _reason(field)
        suspect = F.col(f"_value_{field.name}").isNull() & (F.trim(text) != "")
        cell = F.struct(F.lit(field.name).alias("column_name"), text.alias("value"), reason.alias("reason"))
        problems.append(F.when(suspect, F.when(reason.isNotNull(), cell)))
        suspects.append(suspect)
    malformed = F.array(
        F.struct(
            F.lit(None).cast("string").alias("column_name"),
            F.lit(None).cast("string").alias("value"),
            F.lit(MALFORMED).alias("reason"),
        )
    )
    found = F.filter(F.array(*problems), lambda p: p.isNotNull())
    found = F.when(F.size(found) > 0, found)
    wrong = F.when(F.col(_RECORD).isNotNull(), malformed).when(reduce(or_, suspects), found)
    is_wrong = F.col(_PROBLEMS).isNotNull()
    return (
        raw.withColumns(values)
        .withColumn(_PROBLEMS, wrong.cast(_PROBLEM))
        .select(
            *[F.col(f"_value_{c}").alias(c) for c in names],
            _PROBLEMS,
            # What a rejected row is found by in its source; nothing for the others.
            F.when(is_wrong, F.col("_file")).alias("_file"),
            F.when(is_wrong, F.col(_RECORD)).alias(_RECORD),
            F.when(is_wrong, F.col("id")).alias("_id"),
            F.when(is_wrong, F.col("time")).alias("_time"),
        )
    )


def _cells(reason: str) -> Column:
    """How many cells are rejected for a reason."""
    cells = F.size(F.filter(_PROBLEMS, lambda p: p["reason"] == reason))
    return F.coalesce(F.sum(F.when(F.col(_PROBLEMS).isNotNull(), cells)), F.lit(0))


def _number(field: T.StructField) -> Column:
    """A cell's text if it is a number, else NULL."""
    text = F.trim(F.col(f"`{field.name}`"))
    return F.when(text.rlike(_NUMBER), text)


def _value(field: T.StructField) -> Column:
    """A cell's value, NULL if it has none or is wrong."""
    cell, number = F.col(f"`{field.name}`"), _number(field)
    if field.dataType == T.LongType():
        exact = number.try_cast("decimal(38,18)")
        whole = exact.try_cast("long")
        return F.when(cell.rlike(_PLAIN_WHOLE), cell.try_cast("long")).when(exact == whole, whole)
    double = number.try_cast("double")
    plain = F.when(cell.rlike(_PLAIN_NUMBER), cell.try_cast("double"))
    return plain.when(F.abs(double) != F.lit(float("inf")), double)


def _reason(field: T.StructField) -> Column:
    """The reason against a cell that is not blank, NULL if it is good."""
    number = _number(field)
    unreadable = F.when(number.isNull(), NOT_A_NUMBER)
    if field.dataType == T.LongType():
        exact = number.try_cast("decimal(38,18)")
        whole = exact.try_cast("long")
        return (
            unreadable.when(exact.isNull(), OUT_OF_RANGE)
            .when(exact != F.floor(exact), NOT_WHOLE)
            .when(whole.isNull(), OUT_OF_RANGE)
        )
    return unreadable.when(F.abs(number.try_cast("double")) == F.lit(float("inf")), OUT_OF_RANGE)


def accepted(table: DataFrame) -> DataFrame:
    return table.where(F.col(_PROBLEMS).isNull()).select(*PANEL_SCHEMA.names)


def rejected(table: DataFrame) -> DataFrame:
    return (
        table.where(F.col(_PROBLEMS).isNotNull())
        .select(
            F.col("_file").alias("file"),
            F.col(_RECORD).alias("record"),
            F.col("_id").alias("id"),
            F.col("_time").alias("time"),
            F.explode(_PROBLEMS).alias("p"),
        )
        .select("file", "record", "id", "time", "p.column_name", "p.value", "p.reason")
    )
