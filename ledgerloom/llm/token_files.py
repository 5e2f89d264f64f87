"""Token ids as bit-packed blocks.

File format: a Parquet table, written and read by Spark so that it can lie in any store.
A row is a block of whole documents in ascending doc_id order:

    part, block      place of the block: range partition, number within it
    first            ids of earlier blocks of the part
    doc_ids          the documents, in order
    doc_offsets      where each document's ids start in the block, and the end
    bits             bits per id, the fewest that hold every id of the vocabulary
    payload          ids one after another, ``bits`` each, lowest bit first

The k-th id of a block lies at bit k * bits, so any range unpacks by itself. A block is
closed once it has ``block_ids`` ids; a longer document makes a longer block. The table
``parts`` (part, start) says how many ids precede each part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bytes_in_parts, give_back, importable, stored, text_key
from ledgerloom.llm.tokens import encoder, vocabulary_path

END, BLOCK_IDS = 2, 1 << 16
# Words a worker remembers: more of them save time, some 300 bytes each.
WORDS = 1_000_000

_BLOCKS = (
    "part int, block int, first long, n_ids long, least long, greatest long, doc_ids array<long>, "
    "doc_offsets array<int>, bits int, payload binary"
)


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def _whole(bits: int) -> str | None:
    """The number type whose bytes the packed bits are, if there is one."""
    return f"<u{bits // 8}" if bits in (8, 16, 32) else None


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, lowest bit first."""
    if whole := _whole(bits):
        return ids.astype(whole).tobytes()
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    flags = np.unpackbits(octets, axis=1, bitorder="little", count=bits)
    return np.packbits(flags.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on; only their bytes are looked at."""
    lo = start * bits
    if whole := _whole(bits):
        return np.frombuffer(payload, whole, count, lo // 8).astype("<u4")
    octets = np.frombuffer(payload, np.uint8)[lo // 8 : (lo + count * bits + 7) // 8]
    flags = np.unpackbits(octets, bitorder="little")[lo % 8 : lo % 8 + count * bits]
    values = np.zeros((count, 4), np.uint8)
    packed = np.packbits(flags.reshape(count, bits), axis=1, bitorder="little")
    values[:, : packed.shape[1]] = packed
    return values.view("<u4").ravel()


def _blocks(path: str, end: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, WORDS)
        bits = bits_for(max(tokenizer.size, end + 1))
        part, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids, named = np.concatenate(held), [d for d in doc_ids if d is not None]
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([min(named, default=None)], pa.int64()),
                    pa.array([max(named, default=None)], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([offsets], pa.list_(pa.int32())),
                    pa.array([bits], pa.int32()),
                    pa.array([pack(ids, bits)], pa.binary()),
                ],
                names=[c.split()[0] for c in _BLOCKS.split(", ")],
            )

        for batch in batches:
            names, lo = batch.column("doc_id").to_pylist(), 0
            for texts in bytes_in_parts(batch.column("text")):
                ids, bounds = tokenizer.encode(texts, end)
                for i in range(len(texts)):
                    doc_ids.append(names[lo + i])
                    lengths.append(int(bounds[i + 1] - bounds[i]))
                    held.append(ids[bounds[i] : bounds[i + 1]])
                    size += lengths[-1]
                    if size >= block_ids:
                        yield close()
                        first, block = first + size, block + 1
                        doc_ids, lengths, held, size = [], [], [], 0
                lo += len(texts)
            give_back(keep="tokens")
        if doc_ids:
            yield close()

    return run


def write(
    documents: DataFrame,
    vocabulary: str | None = None,
    end: int = END,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """The blocks of all documents, written to the shared folder.

    A null text is empty and has only the end id. Null ids come first; rows that share
    an id follow one another by a hash of their text. Other columns are ignored.
    """
    importable(documents.sparkSession)
    ordered = (
        documents.select("doc_id", "text", text_key().alias("th"))
        .repartitionByRange("doc_id", "th")
        .sortWithinPartitions("doc_id", "th")
        .select("doc_id", "text")
    )
    run = _blocks(vocabulary_path(vocabulary), end, block_ids)
    return stored(ordered.mapInArrow(run, _BLOCKS), "token-blocks", compression="none")


def parts(blocks: DataFrame) -> DataFrame:
    """part and start, the ids of all earlier parts; one row per written file."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (array) of every document in the blocks."""
    return _read(blocks, "ids array<long>", lambda ids: ids, pa.list_(pa.int64()))


def digest(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as 32-bit little-endian numbers."""
    return _read(
        blocks, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64()
    )


def _read(blocks: DataFrame, column: str, of_ids, kind: pa.DataType) -> DataFrame:
    # One row per range partition, so the number of shuffle partitions bounds it.
    placed = blocks.join(F.broadcast(parts(blocks)), "part").select(
        (F.col("start") + F.col("first")).alias("start"), "doc_ids", "doc_offsets", "bits", "payload"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, offsets = batch.column(0)[row].as_py(), batch.column(2)[row].values.to_numpy()
                payload, bits = batch.column(4)[row].as_py(), batch.column(3)[row].as_py()
                ids = unpack(payload, bits, 0, int(offsets[-1]))
                lo, hi = offsets[:-1], offsets[1:]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1)[row].values,
                        pa.array(lo.astype(np.int64) + start),
                        pa.array((hi - lo).astype(np.int64)),
                        pa.array([of_ids(ids[a:b]) for a, b in zip(lo, hi, strict=True)], kind),
                    ],
                    names=["doc_id", "start", "n_tokens", column.split()[0]],
                )

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def lookup(blocks: DataFrame, doc_id: int) -> DataFrame:
    """Ids of one document: reads the blocks that can hold it and unpacks only its range.

    Blocks are in the order of ids and carry their least and greatest one, so files and
    pages of other blocks are skipped by their statistics.
    """
    found = blocks.where(
        (F.col("least") <= doc_id) & (F.col("greatest") >= doc_id) & F.array_contains("doc_ids", doc_id)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for k, name in enumerate(row["doc_ids"]):
                    if name == doc_id:
                        lo, hi = row["doc_offsets"][k : k + 2]
                        ids = unpack(row["payload"], row["bits"], lo, hi - lo)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name]), pa.array([ids.tolist()], pa.list_(pa.int64()))],
                            names=["doc_id", "ids"],
                        )

    return found.mapInArrow(run, "doc_id long, ids array<long>")
