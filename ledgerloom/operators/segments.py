"""Long-form segmentation: one row per dimension and value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.spec import TOTAL_TYPE, TOTAL_VALUE


def long_segments(
    df: DataFrame, keep: Sequence[str], dimensions: Mapping[str, str], total: bool = False
) -> DataFrame:
    """``keep`` plus ``segment_type`` and ``segment_value``, a row per dimension.

    One scan whatever the number of dimensions (Spark plans it as an Expand).
    Group the result straight away: partial aggregation then leaves only the few
    (period, dimension, value) cells of each task to shuffle, however many rows
    one segment holds. Grouping by all dimensions at once first would shuffle
    their combinations, which are close to the rows themselves.
    """
    columns = [F.col(c).alias(label) for label, c in dimensions.items()]
    labels = list(dimensions)
    if total:
        columns.append(F.lit(TOTAL_VALUE).alias(TOTAL_TYPE))
        labels.append(TOTAL_TYPE)
    return df.select(*keep, *columns).unpivot(
        list(keep), [f"`{label}`" for label in labels], "segment_type", "segment_value"
    )
