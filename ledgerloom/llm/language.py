"""Language identification by nearest centroid over TF-IDF character n-grams.

A text is its letters in lower case, everything else one space; n-grams of one to three
characters are hashed into ``BUCKETS``, weighted by 1 + ln(count) and by the inverse
document frequency over all learning documents, and scaled to length one. Each language
has several centroids, clustered (spherical k-means) from a bounded sample. A text gets
the language of the centroid with the largest cosine; texts farther from it than nearly
all of its own sample are marked ``rejected``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import importable, portions

BUCKETS, ORDERS = 4096, 3
# The classifier is fitted on at most this many texts of a language.
SAMPLE, CENTROIDS, ROUNDS = 400, 4, 12
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# Part of a centroid's own sample that lies beyond its radius.
REJECT = 0.005
PORTION = 1 << 20
_PLACES = 1 << 30

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter(
            (chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1
        )
    return _letters


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a document is kept out of learning; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (text by bucket) and whether a text has a letter."""
    joined = "".join("\0" + (t or "").replace("\0", " ").lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    border = points == 0
    row = np.cumsum(border) - 1
    letter = _is_letter()[points]
    has = np.zeros(len(texts), bool)
    has[row[letter]] = True
    # Each text begins with a space, and runs of other characters after a letter become one.
    keep = letter | border
    keep[1:] |= letter[:-1]
    code = np.where(letter, points, 32).astype(np.uint64)[keep]
    row = row[keep]
    flat = np.zeros(len(texts) * BUCKETS, np.float64)
    gram = np.zeros(len(code), np.uint64)
    for n in range(ORDERS):
        gram = gram[: len(code) - n] * np.uint64(0x9E3779B97F4A7C15) + code[n:]
        whole = row[: len(code) - n] == row[n:]
        mixed = (gram * np.uint64(0xD1B54A32D192ED03 + 2 * n)) >> np.uint64(52)
        at = row[: len(code) - n][whole] * BUCKETS + mixed[whole].astype(np.int64)
        flat += np.bincount(at, minlength=len(flat))
    return flat.reshape(len(texts), BUCKETS), has


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, has = counts(texts)
    weights = np.where(found > 0, 1 + np.log(np.maximum(found, 1)), 0.0) * idf
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights / np.where(norm > 0, norm, 1), has


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    for lo, hi in portions(texts, PORTION):
        for at in range(lo, hi, 512):
            yield at, min(hi, at + 512)


def inverse_frequencies(learning: DataFrame) -> np.ndarray:
    """ln((1 + n) / (1 + df)) + 1 of each bucket, over all texts of ``learning``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _portions(texts):
                df += (counts(texts[lo:hi])[0] > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate(([n], df)))],
            names=["bucket", "n"],
        )

    parts = learning.select("text").mapInArrow(run, "bucket long, n long")
    rows = parts.groupBy("bucket").agg(F.sum("n")).collect()  # BUCKETS + 1 at most
    sums = np.zeros(BUCKETS + 1)
    for bucket, n in rows:
        sums[bucket + 1] = n
    return np.log((1 + sums[0]) / (1 + sums[1:])) + 1


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from the mean and the points farthest from those chosen."""
    chosen = [x.mean(axis=0)]
    chosen[0] = chosen[0] / (np.linalg.norm(chosen[0]) or 1)
    near = x @ chosen[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ chosen[-1])
    centres = np.stack(chosen)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        fresh = centres.copy()
        for j in range(len(centres)):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                fresh[j] = mean / (np.linalg.norm(mean) or 1)
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres


class Model:
    """Languages, their centroids and radii, and the bucket weights."""

    def __init__(self, languages: list[str], centres: np.ndarray, radii: np.ndarray, idf: np.ndarray):
        self.languages, self.centres, self.radii, self.idf = languages, centres, radii, idf

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        x, has = vectors(texts, self.idf)
        cosine = x @ self.centres.T
        best = np.argmax(cosine, axis=1)
        score = np.where(has, np.clip(cosine[np.arange(len(x)), best], 0, 1), 0.0)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        return names, score, ~has | (score < self.radii[best])


def fit(documents: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from text and lang of documents that are not held out and have a lang.

    The sample of a language is the documents with the smallest hashes of id and text.
    """
    importable(documents.sparkSession)
    learning = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    idf = inverse_frequencies(learning)
    # Only about four samples a language go to the window, however many tasks there are.
    # The counts have one row per language.
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_PLACES))
    enough = (
        learning.groupBy(F.col("lang").alias("of"))
        .agg(F.count("*").alias("n"))
        .select("of", (F.lit(4.0 * sample * _PLACES) / F.col("n")).alias("below"))
    )
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    chosen = (
        learning.select("doc_id", "lang", "text", place.alias("place"))
        .join(F.broadcast(enough), F.col("lang") == F.col("of"))
        .where("place < below")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= sample)
        .select("lang", "text")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["text"])
        parts = [vectors(texts[lo:hi], idf) for lo, hi in _portions(texts)]
        x = np.concatenate([p[0][p[1]] for p in parts])
        if not len(x):
            return pd.DataFrame({"lang": [], "centre": [], "radius": []})
        centres = cluster(x, centroids)
        cosine = x @ centres.T
        own = np.argmax(cosine, axis=1)
        radii = [
            float(np.quantile(cosine[own == j, j], REJECT)) if (own == j).any() else 1.0
            for j in range(len(centres))
        ]
        return pd.DataFrame(
            {"lang": group["lang"].iloc[0], "centre": list(centres), "radius": radii}
        )

    rows = chosen.groupBy("lang").applyInPandas(
        run, "lang string, centre array<double>, radius double"
    )
    # A few rows per language.
    found = sorted(rows.collect(), key=lambda r: (r["lang"], r["radius"], r["centre"]))
    centres = np.array([r["centre"] for r in found]).reshape(-1, BUCKETS)
    return Model([r["lang"] for r in found], centres, np.array([r["radius"] for r in found]), idf)


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected, for every row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [shipped.value.predict(texts[lo:hi]) for lo, hi in _portions(texts)]
            names = [x for p in parts for x in p[0]]
            scores = np.concatenate([p[1] for p in parts] or [np.zeros(0)])
            rejected = np.concatenate([p[2] for p in parts] or [np.zeros(0, bool)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, _SCHEMA)


def identify(documents: DataFrame) -> DataFrame:
    return predict(documents, fit(documents))
