"""Removal of passages that a document with a smaller doc_id also has.

Seed and extend. Every stretch of ``length`` words has one anchor, the smallest hash
among its stretches of ``seed`` words (winnowing), so equal stretches have equal
anchors and documents meet by joining on anchors. A run is a longest sequence of
consecutive stretches with one anchor: the anchor, extended both ways as far as it
stays the smallest. Runs that meet are compared as a whole first; only where one
anchor has several different runs are the extensions compared stretch by stretch.
Extensions are compared by 128-bit hashes grouped over all occurrences at once, never
pair by pair, so a passage in a third of all documents costs as many rows as it has
occurrences. Matched stretches are merged into maximal repeats in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import (
    FIRST,
    SECOND,
    as_bytes,
    hashed_lists,
    importable,
    mixed,
    portions,
    second,
    signed,
    stored,
    text_key,
)

LENGTH, SEED = 50, 16


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if width > span:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


class _Texts:
    """Word hashes of some texts and hashes of their stretches."""

    def __init__(self, texts: list[bytes | None]):
        self.hashes, self.bounds = hashed_lists([(t or b"").split() for t in texts])
        self.sums = FIRST.prefixes(self.hashes), SECOND.prefixes(second(self.hashes))

    def keys(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each stretch, its length included."""
        size = mixed((end - start).astype(np.uint64))
        return tuple(
            signed(r.stretch(s, start, end) ^ size)
            for r, s in zip((FIRST, SECOND), self.sums, strict=True)
        )


def _runs(texts: list[bytes | None], length: int, seed: int):
    """Row, first and last stretch, anchor and keys of every run."""
    t = _Texts(texts)
    n = len(t.hashes)
    if n < length:
        return None
    anchors = _minima(FIRST.windows(t.sums[0], seed), length - seed + 1)
    row = np.repeat(np.arange(len(texts)), np.diff(t.bounds))[: len(anchors)]
    at = np.flatnonzero(np.arange(len(anchors)) + length <= t.bounds[row + 1])
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (anchors[at[1:]] != anchors[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    a, b, row = at[first], at[last], row[at[first]]
    start = t.bounds[row]
    return row, a - start, b - start, signed(anchors[a]), *t.keys(a, b + length)


_RUN_SCHEMA = "doc_id long, th long, a int, b int, m long, s1 long, s2 long"
_WINDOW_SCHEMA = "doc_id long, th long, a int, w1 long, w2 long"


def _run_rows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi in portions(texts):
                found = _runs(texts[lo:hi], length, seed)
                if found is not None:
                    row, a, b, m, s1, s2 = found
                    rows = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(rows),
                            batch.column("th").take(rows),
                            *[pa.array(x, pa.int32()) for x in (a, b)],
                            *[pa.array(x) for x in (m, s1, s2)],
                        ],
                        names=["doc_id", "th", "a", "b", "m", "s1", "s2"],
                    )

    return run


def _window_rows(length: int):
    """Every stretch of the listed runs, with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            listed = batch.column("runs")
            for lo, hi in portions(texts):
                t = _Texts(texts[lo:hi])
                ranges = listed.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), ranges.value_lengths().to_numpy())
                flat = ranges.flatten()
                a, b = (flat.field(x).to_numpy().astype(np.int64) for x in (0, 1))
                counts = b - a + 1
                steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                row, at = np.repeat(row, counts), np.repeat(a, counts) + steps
                start = t.bounds[row] + at
                w1, w2 = t.keys(start, start + length)
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("th").take(rows),
                        pa.array(at, pa.int32()),
                        pa.array(w1),
                        pa.array(w2),
                    ],
                    names=["doc_id", "th", "a", "w1", "w2"],
                )

    return run


def repeats(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Stretches of words to remove: doc_id, th (hash of the text), start, end.

    Word positions from 0, end exclusive; stretches of one document may overlap. Rows
    with a null doc_id neither lose nor cause anything. Rows with one doc_id do not
    act on each other; those that also have one text share their stretches.
    """
    importable(documents.sparkSession)
    docs = documents.select("doc_id", "text", text_key().alias("th")).where("doc_id IS NOT NULL")
    runs = stored(docs.mapInArrow(_run_rows(length, seed), _RUN_SCHEMA), "runs")
    # What is joined by a key is written first: of two written sides, adaptive execution
    # splits the rows of a key that very many documents share.
    shared = runs.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = stored(shared.where("lo < hi").select("m"), "shared")
    near = stored(runs.join(shared, "m", "left_semi"), "near")
    # Equal runs: all but those of the first document go as a whole.
    firsts = stored(near.groupBy("s1", "s2").agg(F.min("doc_id").alias("first")), "firsts")
    compared = stored(near.join(firsts, ["s1", "s2"]), "compared")
    whole = compared.where("doc_id > first").select(
        "doc_id", "th", F.col("a").alias("start"), (F.col("b") + length).alias("end")
    )
    # One anchor with different runs: extend stretch by stretch.
    mixed_up = near.groupBy("m").agg(
        F.min("s1").alias("x1"), F.max("s1").alias("y1"), F.min("s2").alias("x2"), F.max("s2").alias("y2")
    )
    mixed_up = stored(mixed_up.where("x1 < y1 OR x2 < y2").select("m"), "mixed")
    heads = compared.where("doc_id = first").join(mixed_up, "m", "left_semi")
    by_document = heads.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("a", "b")).alias("runs")
    )
    # Rows repeated with text and all would only repeat their windows.
    texts = docs.join(by_document, ["doc_id", "th"]).select("doc_id", "th", "text", "runs")
    windows = stored(texts.mapInArrow(_window_rows(length), _WINDOW_SCHEMA), "windows")
    sources = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    sources = stored(sources.where("lo < hi").select("w1", "w2", "lo"), "sources")
    single = (
        windows.join(sources, ["w1", "w2"])
        .where("doc_id > lo")
        .select("doc_id", "th", F.col("a").alias("start"), (F.col("a") + length).alias("end"))
    )
    return whole.unionByName(single)


def _cut(texts: list[bytes | None], ranges: pa.Array):
    """Words and, of each word, whether it stays; per text."""
    flat, ends = ranges.flatten(), np.cumsum(ranges.value_lengths().fill_null(0).to_numpy())
    start, end = (flat.field(x).to_numpy() for x in (0, 1))
    for i, text in enumerate(texts):
        words = (text or b"").split()
        lo = ends[i - 1] if i else 0
        stays = None
        if ends[i] > lo:
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, start[lo : ends[i]], 1)
            np.add.at(marks, end[lo : ends[i]], -1)
            stays = np.cumsum(marks)[:-1] == 0
        yield words, stays


def without_repeats(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space), per row.

    A null text has no words. Repeated rows each give a row; see ``repeats`` for null
    and repeated ids. Other columns are ignored.
    """
    docs = documents.select("doc_id", "text", text_key().alias("th"))
    cuts = (
        repeats(documents, length, seed)
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    )
    joined = docs.join(cuts, ["doc_id", "th"], "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            total, removed, kept = [], [], []
            for words, stays in _cut(texts, batch.column("cuts")):
                left = words if stays is None else [w for w, s in zip(words, stays, strict=True) if s]
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    return without_repeats(documents, length, seed).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
