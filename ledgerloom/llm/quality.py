"""Quality rules: counts of words, symbols and repeats, and zstandard ratios in bands.

The ratio of a text's bytes to its compressed bytes is low for noise and high for
repetition, and grows with length in any text. So the whole text and each of its chunks
of ``CHUNK`` bytes have the limits of the band their length falls into.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import FIRST, bytes_in_parts, give_back, hashed_lists, importable, portions

# Bytes from which a band starts, and the smallest and largest ratio accepted in it.
# Wide around prose: limits lie a tenth or more outside what labelled prose shows.
BANDS = (
    (0, 0.0, 1.6),
    (128, 0.9, 2.1),
    (256, 1.15, 2.2),
    (512, 1.25, 2.35),
    (1024, 1.4, 2.5),
    (2048, 1.55, 2.6),
    (4096, 1.65, 2.75),
    (8192, 1.7, 2.85),
    (16384, 1.75, 3.0),
    (65536, 1.8, 3.2),
)
CHUNK, LEVEL = 2048, 3
# A text is rejected if chunks out of their band hold more than this part of its bytes.
BAD_CHUNKS = 0.3
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WORDS = 10, 20, 5
SYMBOLS = "#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_STARTS = [b[0] for b in BANDS]


def _outside(compress, data: bytes) -> tuple[float, bool]:
    ratio = len(data) / len(compress(data))
    _, low, high = BANDS[bisect_right(_STARTS, len(data)) - 1]
    return ratio, not low <= ratio <= high


def compression(compress, data: bytes) -> tuple[float | None, float, bool]:
    """Ratio of the whole text, part of it in chunks out of band, and the verdict."""
    if not data:
        return None, 0.0, False
    ratio, bad = _outside(compress, data)
    wrong = 0
    for at in range(0, len(data), CHUNK) if len(data) > CHUNK else ():
        chunk = data[at : at + CHUNK]
        wrong += len(chunk) * _outside(compress, chunk)[1]
    share = wrong / len(data)
    return ratio, share, not bad and share <= BAD_CHUNKS


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def _characters(text: bytes) -> int:
    """Code points of UTF-8 text: bytes that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and words in stretches of five that it has more than once."""
    hashes, bounds = hashed_lists([t.split() for t in texts])
    counts = np.diff(bounds)
    repeated = np.zeros(len(texts), np.int64)
    windows = FIRST.windows(FIRST.prefixes(hashes), REPEAT_WORDS)
    row = np.repeat(np.arange(len(texts)), counts)[: len(windows)]
    at = np.flatnonzero(np.arange(len(windows)) + REPEAT_WORDS <= bounds[row + 1])
    if not len(at):
        return counts, repeated
    order = np.lexsort((windows[at], row[at]))
    a, r = windows[at][order], row[at][order]
    same = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hits = at[order[twice]]
    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, hits, 1)
    np.add.at(marks, hits + REPEAT_WORDS, -1)
    covered = np.cumsum(marks)[:-1] > 0
    sums = np.concatenate(([0], np.cumsum(covered)))
    return counts, sums[bounds[1:]] - sums[bounds[:-1]]


def measure(texts: list[bytes | None]) -> dict[str, list | np.ndarray]:
    """All measures and verdicts of some texts; a null text counts as empty."""
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    filled = [t or b"" for t in texts]
    parts = [_repeated_words(filled[lo:hi]) for lo, hi in portions(filled)]
    n_words = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)])
    n_repeat = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_PERCENT * n_words)
    verdicts = [compression(compress, t) for t in filled]
    return {
        "n_words": n_words,
        "word_chars": [_characters(t) - sum(map(t.count, _SPACES)) for t in filled],
        "n_symbols": [sum(map(t.count, SYMBOLS.encode())) for t in filled],
        "n_dup_lines": [_duplicate_lines(t) for t in filled],
        "n_repeat_words": n_repeat,
        "ratio": [v[0] for v in verdicts],
        "bad_chunk_share": [v[1] for v in verdicts],
        "base_failed": failed,
        "kept": [bool(v[2]) and not f for v, f in zip(verdicts, failed, strict=True)],
    }


_TYPES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "ratio": pa.float64(),
    "bad_chunk_share": pa.float64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
}
_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, ratio double, bad_chunk_share double, base_failed boolean, kept boolean"
)


def scores(documents: DataFrame) -> DataFrame:
    """Measures and verdict of every row, by doc_id.

    A null or empty text has no words and fails; its ratio is null. Repeated rows and
    null ids are rows like others; other columns are ignored.
    """
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            done = 0
            for texts in bytes_in_parts(batch.column("text")):
                found = measure(texts)
                ids = batch.column("doc_id").slice(done, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(found[c], t) for c, t in _TYPES.items()]],
                    names=["doc_id", *_TYPES],
                )
                done += len(texts)
        give_back()

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def accepted(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns.

    Only texts go to the workers, and one bit a row comes back.
    """
    importable(documents.sparkSession)

    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for batch in batches:
            yield pa.array(
                [v for texts in bytes_in_parts(batch) for v in measure(texts)["kept"]], pa.bool_()
            )
        give_back()

    return documents.where(F.arrow_udf(verdicts, "boolean")("text"))


def digest(documents: DataFrame) -> DataFrame:
    return scores(documents).withColumn("ratio", F.round("ratio", 6))
