"""What the operators share: shared storage, words, row keys and array helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a longest run of anything but the six white space characters of ASCII.
# bytes.split() without arguments cuts at exactly these.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

# Text handled at once by numpy inside a task.
BATCH_BYTES = 4 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is shipped with the job; a worker ignores a folder
    that it does not have.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, known]))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-llm-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a new Parquet table in the shared folder, read back.

    This cuts the lineage: a lost executor repeats tasks of one step, and a table
    that is read twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{uuid.uuid4().hex}/{label}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str | Column = "text") -> Column:
    """Tells rows with one doc_id but different texts apart."""
    return F.xxhash64(text)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def bytes_in_parts(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[list[bytes | None]]:
    """The texts of a column, about ``limit`` bytes of them at a time.

    Only one part is in Python's memory, whatever a batch holds; the column itself stays
    in the buffer that Arrow has for it.
    """
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield as_bytes(column.slice(start, stop - start))
        start = stop


# How to empty what a module keeps between the tasks of one worker, by module.
caches: dict[str, Callable[[], None]] = {}


def give_back(keep: str = "") -> None:
    """Empty this worker's caches but those of module ``keep``, and return the memory.

    Workers are reused, so what a stage has kept would add to what later stages need.
    """
    for name, clear in caches.items():
        if name != keep:
            clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def portions(texts: list[bytes | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes of text each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class WordHashes(dict):
    """64-bit hash of a word, remembered for words seen before in this process."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()
caches["words"] = _hashes.clear


def hashed_lists(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and where each list starts and ends."""
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    words = chain.from_iterable(lists)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, int(bounds[-1])), bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence from prefix sums, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << int(n).bit_length()
            for name, step in (("powers", self.base), ("inverses", self.inverse)):
                factors = np.full(size, step, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], dtype=np.uint64, out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(sums))
        return mixed((sums[end] - sums[start]) * self.inverses[start])

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Of every ``width`` consecutive values."""
        n = len(sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(len(sums))
        return mixed((sums[width:] - sums[:n]) * self.inverses[:n])


# Any two odd numbers; the second hash makes keys of 128 bits.
FIRST, SECOND = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1B54A32D192ED03)


def second(values: np.ndarray) -> np.ndarray:
    return mixed(values ^ np.uint64(0x5851F42D4C957F2D))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A body for mapInArrow from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield out

    return run
