"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: two long columns); root is the smallest.

    Each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest it knows, and ends when a round changes nothing. Rounds grow with the
    logarithm of the longest path. Only a count and a checksum of the links come to
    the driver; every round is a written table.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    mark = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Both sides of a join are written, so that a hub's rows can be split.
        least = both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("m"))
        least, both = stored(least, "least"), stored(both, "both")
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        large = stored(large, "large")
        smallest = stored(large.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        small = large.join(smallest, "a")
        edges = stored(
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(smallest.select("a", F.col("m").alias("b")))
            .distinct(),
            "links",
        )
        before, mark = mark, _checksum(edges)
        if mark == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _checksum(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )
