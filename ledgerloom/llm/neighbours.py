"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors get one more component so that inner product and distance order them alike.
A table hashes a vector by ``functions`` projections on Gaussian directions, each cut
into cells of a width. A query ranks the cells around its own by the estimated chance
that a neighbour lies there (differences of projections of points at distance r are
normal with deviation r) and visits them in that order until the chance of meeting a
neighbour at the distance r in one of the tables reaches ``success``. Candidates of all
tables are ranked by their exact score.

Distances differ between dense groups and the rest, so there are tables for several r,
read off the distance to the ``top``-th neighbour among all vectors of a bounded sample
of them. A query is done when its ``top`` nearest lie within r; others go on to the next
r. Those that no r has served are compared with all vectors, in chunks: a part of a
stated set of queries, whatever their number, and exact. The number of projections of a
table grows with the logarithm of the vectors, so that its cells do not fill up.

Equal vectors are one class with its smallest ids, so copies cost nothing. A cell with
more than ``chunk`` classes or queries is cut, so no task holds a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import importable, mixed, stored

TOP, QUERY_STEP = 20, 20
TABLES, WIDTH, REACH = 2, 1.4, 2
SUCCESS, SAMPLE, CHUNK, SEED = 0.985, 2048, 4096, 7
# One r serves distances up to SPREAD times the least, and a scale with less than FEW of
# the sample goes with the next; a last r, LAST times the greatest distance, serves those
# that miss a neighbour at the border.
SPREAD, FEW, LAST = 1.5, 0.1, 1.2


def functions_for(n: int) -> int:
    """Projections of a table over ``n`` vectors: 4 up to some 260,000, one more for each 16-fold."""
    return min(8, max(4, round(math.log2(max(2, n)) / 4)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part, each pair once.

    Left out: null ids, null or empty or zero vectors, vectors with a null or
    non-finite component, and vectors not of the most frequent length.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    good = vectors.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & finite
        & F.exists("embedding", lambda x: x != 0)
    )
    length = (
        good.groupBy(F.size("embedding").alias("n"))
        .agg(F.count("*").alias("c"))
        .orderBy(F.desc("c"), "n")
        .first()
    )
    if length is None:
        return good
    return good.where(F.size("embedding") == length["n"]).dropDuplicates(["vec_id", "embedding"])


def classes(rows: DataFrame, top: int = TOP) -> DataFrame:
    """embedding, rep (its smallest vec_id) and ids (its ``top`` + 1 smallest), once each."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1)
    ids = F.sort_array(F.collect_list("vec_id"))
    return few.groupBy("embedding").agg(ids.alias("ids")).select(
        F.col("ids")[0].alias("rep"), "embedding", "ids"
    )


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 26.2.17, to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    tail = np.exp(-x * x / 2) / sqrt(2 * np.pi) * poly
    return np.where(x >= 0, 1 - tail, tail)


class Index:
    """Directions and cells of all tables, and the order in which queries visit them."""

    def __init__(
        self,
        dimension: int,
        norm: float,
        distance: float,
        tables: int = TABLES,
        functions: int = 4,
        width: float = WIDTH,
        reach: int = REACH,
        success: float = SUCCESS,
        seed: int = SEED,
    ):
        random = np.random.default_rng(seed)
        self.norm, self.distance, self.tables, self.functions = norm, distance, tables, functions
        self.width = width * distance
        self.directions = random.standard_normal((dimension + 1, tables * functions))
        self.shifts = random.uniform(0, 1, tables * functions)
        self.per_table = 1 - (1 - success) ** (1 / tables)
        axes = np.meshgrid(*[np.arange(-reach, reach + 1)] * functions, indexing="ij")
        self.offsets = np.stack([a.ravel() for a in axes], axis=1)

    def _projected(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.column_stack((x, last)) @ self.directions / self.width + self.shifts

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells of a table's functions (last axis)."""
        key = np.zeros(cells.shape[:-1], np.uint64)
        for j in range(cells.shape[-1]):
            key = mixed(key + cells[..., j].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each vector in each table."""
        room = self.norm**2 - np.einsum("ij,ij->i", x, x)
        at = np.floor(self._projected(x, np.sqrt(np.maximum(room, 0))))
        return self._keys(at.reshape(len(x), self.tables, self.functions))

    def probes(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Query, table and the cells to visit, likeliest first.

        Queries are scaled to the norm of the indexed vectors, which changes no order.
        """
        x = x * (self.norm / np.linalg.norm(x, axis=1, keepdims=True))
        at = self._projected(x, np.zeros(len(x))).reshape(len(x), self.tables, self.functions)
        base = np.floor(at)
        inside = at - base
        spread = self.distance / self.width
        steps = np.arange(self.offsets.min(), self.offsets.max() + 2)
        edges = _normal_cdf((steps - inside[..., None]) / spread)
        chance = np.diff(edges, axis=-1)
        low = self.offsets.min()
        for q in range(len(x)):
            for t in range(self.tables):
                joint = np.ones(len(self.offsets))
                for j in range(self.functions):
                    joint = joint * chance[q, t, j, self.offsets[:, j] - low]
                order = np.argsort(-joint, kind="stable")
                enough = int(np.searchsorted(np.cumsum(joint[order]), self.per_table)) + 1
                yield q, t, self._keys(base[q, t] + self.offsets[order[:enough]])


def radii(distances: np.ndarray) -> list[float]:
    """Ascending distances that together serve all of these, one for each scale."""
    left, few = np.sort(distances), int(np.ceil(FEW * len(distances)))
    out = []
    while len(left):
        least = left[min(few, len(left)) - 1]
        served = int(np.searchsorted(left, SPREAD * least, "right"))
        out.append(float(left[:served][-1]))
        left = left[served:]
    return [*out, LAST * out[-1]] if out else []


def _closest(unit: np.ndarray, top: int):
    """The ``top`` + 1 greatest scores of every row of ``unit`` in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(unit), top + 1), -np.inf)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                scores = unit @ _matrix(batch.column("embedding").slice(lo, 1024)).T
                best = np.partition(np.hstack((best, scores)), -top - 1, axis=1)[:, -top - 1 :]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(unit), dtype=np.int32)), pa.array(list(best))],
            names=["s", "scores"],
        )

    return run


def fit(found: DataFrame, top: int = TOP, sample: int = SAMPLE, **options) -> list[Index] | None:
    """Indexes for these classes, by ascending r; none if all classes are neighbours.

    The sample is the classes with the smallest hashes of their id; the distance to
    the ``top``-th neighbour of each is exact, over all classes.
    """
    facts = found.agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"),
        F.max(F.size("embedding")).alias("dimension"),
    ).first()
    if not facts["n"]:
        return None
    if facts["n"] <= top + 1:
        return []
    rows = found.orderBy(F.xxhash64(F.lit(SEED), "rep"), "rep").limit(sample).select("embedding")
    x = np.array([r[0] for r in rows.collect()], float)
    norm = sqrt(facts["norm2"])
    unit = x * (norm / np.linalg.norm(x, axis=1, keepdims=True))
    closest = found.select("embedding").mapInArrow(_closest(unit, top), "s int, scores array<double>")
    # A class is among its own neighbours.
    last = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)[top]
    scores = [r["score"] for r in closest.groupBy("s").agg(last.alias("score")).collect()]
    distances = np.sqrt(np.maximum(2 * norm**2 - 2 * np.array(scores), 0.0))
    options = {"functions": functions_for(facts["n"]), **options}
    return [
        Index(facts["dimension"], norm, distance, **options)
        for distance in radii(np.maximum(distances, 1e-6 * norm))
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _members(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = index.cells(_matrix(batch.column("embedding")))
            rows = pa.array(np.repeat(np.arange(len(keys)), index.tables))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(index.tables, dtype=np.int32), len(keys))),
                    pa.array(keys.ravel()),
                    batch.column("rep").take(rows),
                    batch.column("embedding").take(rows),
                ],
                names=["t", "cell", "rep", "embedding"],
            )

    return run


def _visits(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for q, t, cells in index.probes(_matrix(part.column("embedding"))):
                    rows = pa.array(np.full(len(cells), q))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(cells), t, np.int32)),
                            pa.array(cells),
                            part.column("rep").take(rows),
                        ],
                        names=["t", "cell", "query"],
                    )

    return run


def _ranked(top: int):
    def run(visits: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "reps": [], "scores": []}
        if len(visits) and len(members):
            x, reps = np.stack(members["embedding"]), members["rep"].to_numpy()
            order = np.argsort(reps, kind="stable")
            x, reps = x[order], reps[order]
            scores = np.stack(visits["embedding"]) @ x.T
            for query, row in zip(visits["query"], scores, strict=True):
                best = np.arange(len(row))
                if len(row) > top + 1:
                    # Ties at the border stay in until ids decide.
                    border = np.partition(row, len(row) - top - 1)[len(row) - top - 1]
                    best = np.flatnonzero(row >= border)
                best = best[np.argsort(-row[best], kind="stable")][: top + 1]
                out["query"].append(query)
                out["reps"].append(reps[best])
                out["scores"].append(row[best])
        # An empty list alone would become a column of doubles, which is no column of arrays.
        kinds = {"query": "int64", "reps": object, "scores": object}
        return pd.DataFrame({name: pd.Series(out[name], dtype=kinds[name]) for name in kinds})

    return run


def _compared(visits: DataFrame, members: DataFrame, top: int) -> DataFrame:
    """query, rep and score of the best of each chunk of a cell, for each chunk of queries.

    Both sides have the cell and in how many chunks its members (parts) and queries
    (asks) are.
    """
    part = F.pmod(F.xxhash64("rep"), "parts").cast("int")
    ask = F.pmod(F.xxhash64("query"), "asks").cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = ["t", "cell", "part", "ask"]
    left = visits.withColumn("ask", ask).withColumn("part", each("parts"))
    right = members.withColumn("part", part).withColumn("ask", each("asks"))
    compared = (
        left.select(*group, "query", "embedding")
        .groupBy(*group)
        .cogroup(right.select(*group, "rep", "embedding").groupBy(*group))
        .applyInPandas(_ranked(top), "query long, reps array<long>, scores array<double>")
    )
    return compared.select("query", F.explode(F.arrays_zip("reps", "scores")).alias("p")).select(
        "query", F.col("p.reps").alias("rep"), F.col("p.scores").alias("score")
    )


def _probed(found: DataFrame, queries: DataFrame, index: Index, top: int, chunk: int) -> DataFrame:
    """Pairs of queries and the classes in the cells they visit."""
    members = stored(
        found.mapInArrow(_members(index), "t int, cell long, rep long, embedding array<double>"),
        "members",
    )
    visits = stored(
        queries.mapInArrow(_visits(index), "t int, cell long, query long"),
        "visits",
    )
    # Cells with members, in how many chunks, and the chunks of their queries.
    size = members.groupBy("t", "cell").agg(F.count("*").alias("n"))
    size = size.select("t", "cell", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    load = visits.groupBy("t", "cell").agg(F.count("*").alias("n"))
    load = load.select("t", "cell", F.ceil(F.col("n") / chunk).cast("int").alias("asks"))
    cells = stored(size.join(load, ["t", "cell"]), "cells")
    # Vectors go with the visits that are left, to cells that have members.
    asked = queries.select(F.col("rep").alias("query"), "embedding")
    met = visits.join(cells, ["t", "cell"]).join(asked, "query")
    return _compared(met, members.join(cells, ["t", "cell"]), top)


def _scanned(found: DataFrame, queries: DataFrame, top: int, chunk: int) -> DataFrame:
    """Pairs of queries and all classes, as one cell in chunks."""
    parts, asks = (max(1, -(-d.count() // chunk)) for d in (found, queries))
    one = {
        "t": F.lit(0), "cell": F.lit(0).cast("long"), "parts": F.lit(parts), "asks": F.lit(asks)
    }
    return _compared(
        queries.withColumnRenamed("rep", "query").withColumns(one), found.withColumns(one), top
    )


def _nearest(pairs: DataFrame, found: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """query, its vector (asked), score and ids of the ``top`` + 1 best classes of a query."""
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    # A class met in two tables has one score up to rounding: keep it once.
    once = pairs.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = once.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= top + 1)
    return (
        best.join(found, "rep")
        .join(queries.select(F.col("rep").alias("query"), F.col("embedding").alias("asked")), "query")
        .select(
            "query",
            "asked",
            F.aggregate(
                F.zip_with("embedding", "asked", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x
            ).alias("score"),
            "ids",
        )
    )


def search(
    vectors: DataFrame,
    top: int = TOP,
    query_step: int = QUERY_STEP,
    chunk: int = CHUNK,
    **options,
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` nearest of every ``query_step``-th id.

    Nearness is the inner product in double precision; ties go to the smaller vec_id.
    An id with several vectors is as many candidates, but never its own. See ``usable``
    for vectors that take no part; other columns are ignored.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = stored(usable(vectors), "vectors")
    found = stored(classes(rows, top), "classes")
    indexes = fit(found, top, **options)
    if indexes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(F.col("vec_id") % query_step == 0).join(
        found.select("embedding", "rep"), "embedding"
    )
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), "rep"), "asked")
    queries = stored(
        found.join(asked.select("rep").distinct(), "rep").select("rep", "embedding"), "queries"
    )
    left, results = queries, []
    for index in indexes:
        best = stored(_nearest(_probed(found, left, index, top, chunk), found, left, top), "best")
        # Nearest vectors within r, the query itself among them.
        length = F.sqrt(F.aggregate("asked", F.lit(0.0), lambda a, x: a + x * x))
        within = F.col("score") >= length * (index.norm - index.distance**2 / (2 * index.norm))
        met = best.where(within).groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
        done = stored(met.where(F.col("n") > top).select("query"), "done")
        results.append(best.join(done, "query"))
        left = stored(left.join(done.withColumnRenamed("query", "rep"), "rep", "left_anti"), "left")
    results.append(_nearest(_scanned(found, left, top, chunk), found, left, top))
    # Written, so that the rows of a vector that very many queries share can be split.
    exact = stored(reduce(DataFrame.unionByName, results).select("query", "score", "ids"), "exact")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(exact.withColumnRenamed("query", "rep"), "rep")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
