from __future__ import annotations

import pytest
from document_rows import SCHEMA, rows
from pyspark.sql import DataFrame


@pytest.fixture(scope="session")
def documents(spark) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
