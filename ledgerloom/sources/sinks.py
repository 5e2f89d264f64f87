"""Writing results: quality register, CSV export, commentary text, views, counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.quality import REGISTER_SCHEMA
from ledgerloom.sources.versions import Versions

# Working tables are written once and read a few times; zstd makes them smaller than snappy.
COMPRESSION = "zstd"
REGISTER_KEYS = ("phase", "run_timestamp")


# The JVM only interprets methods of more bytecode than this.
_METHOD_LIMIT, _COMPILED = "spark.sql.codegen.hugeMethodLimit", "8000"


@contextmanager
def compilable(spark: SparkSession) -> Iterator[None]:
    """Let wide projections run as methods that the JVM compiles.

    By default Spark fuses steps into methods of up to 65535 bytes, and those beyond 8000
    are interpreted, row by row. Plans are made when a job starts, so the jobs themselves
    belong inside.
    """
    before = spark.conf.get(_METHOD_LIMIT, None)
    spark.conf.set(_METHOD_LIMIT, _COMPILED)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_METHOD_LIMIT)
        else:
            spark.conf.set(_METHOD_LIMIT, before)


def counted(
    df: DataFrame, path: str, measures: Mapping[str, Column] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """``df`` as a parquet table at ``path``, and its measures, ``rows`` among them.

    The measures are sums that the writing tasks keep beside their rows, so nothing is
    read again. They are taken directly below the writer, in the last stage of the job:
    a task that fails and is repeated there counts once, as its attempt that succeeded,
    and tasks of earlier stages can be repeated without being seen. Measures taken
    below a shuffle would count repeated tasks twice.
    """
    wanted = {"rows": F.count("*"), **(measures or {})}
    seen = Observation()
    watched = df.observe(seen, *[column.alias(name) for name, column in wanted.items()])
    watched.write.mode("overwrite").parquet(path, compression=COMPRESSION)
    # A plan that Spark knows to be empty runs without the observation.
    found = {name: seen.get.get(name) or 0 for name in wanted}
    # The schema is known, so reading back needs no footer inference job.
    return df.sparkSession.read.schema(df.schema).parquet(path), found


def append_register(rows: DataFrame, path: str) -> None:
    """Add the findings of a run to the register at ``path``, as one commit.

    Nothing that is there is rewritten, and readers see a run's findings all or not at
    all. The same run written again, for instance by a retry, is one more commit, and
    readers take the newest of each run, so it does not count twice. A run has one row
    per rule, so one file is enough.
    """
    log = Versions(rows.sparkSession, path)
    folder = log.begin().folder
    rows.select(*REGISTER_SCHEMA.names).coalesce(1).write.parquet(folder)
    log.append(folder)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """All committed findings, each run as it was written last."""
    folders = Versions(spark, path).folders()
    if not folders:
        return spark.createDataFrame([], REGISTER_SCHEMA)
    # One row for each run, and a few for each of its rules.
    numbers = spark.createDataFrame(
        [(folder.rsplit("/", 1)[1], number) for number, folder in folders.items()], "build string, number long"
    )
    build = F.regexp_extract("_metadata.file_path", "([0-9a-f]{32})/[^/]*$", 1)
    rows = spark.read.schema(REGISTER_SCHEMA).parquet(*folders.values()).withColumn("build", build)
    newest = F.max("number").over(Window.partitionBy(*REGISTER_KEYS))
    return (
        rows.join(numbers, "build")
        .withColumn("newest", newest)
        .where("number = newest")
        .select(*REGISTER_SCHEMA.names)
    )


def export_csv(
    tables: Mapping[str, DataFrame], folder: str, order: Mapping[str, Sequence[str]] | None = None
) -> None:
    """One CSV folder with header per table, written by all tasks of the table.

    A table named in ``order`` is sorted by those columns, across its files too: it is
    split into ranges, so no task sees the whole of it.
    """
    for name, table in tables.items():
        keys = (order or {}).get(name)
        ordered = table.orderBy(*keys) if keys else table
        ordered.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_commentary(lines: DataFrame, folder: str) -> None:
    """One text file per reporting quarter.

    A quarter has a few dozen lines; they are put in order inside one value, so
    that the order cannot depend on how rows reach the writer.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = lines.groupBy("reporting_quarter").agg(
        F.array_join(F.transform(ordered, lambda line: line["text"]), "\n").alias("text")
    )
    pages.write.mode("overwrite").partitionBy("reporting_quarter").text(folder)


def create_views(tables: Mapping[str, DataFrame]) -> list[str]:
    """Register each table as a temporary view, for ``spark.sql``."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return list(tables)


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each named table."""
    counts = [
        table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("object"), "rows")
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)
