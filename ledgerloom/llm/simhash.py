"""Near duplicates by 64-bit fingerprints that differ in few bits.

Pigeonhole blocks: fingerprints are cut into ``distance + 2`` blocks of bits. Two that
differ in at most ``distance`` bits agree in two blocks at least, so they meet in the
bucket of some pair of blocks. Members of a bucket are paired and their distance is
verified. A bucket with more than ``bucket_rows`` different fingerprints is not paired:
there each member states its neighbours at half the distance within the remaining bits,
and members that state one value are at most ``distance`` apart. That is exact for an
even distance and takes rows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bytes_in_parts, give_back, importable, stored, text_key
from ledgerloom.llm.components import components

SHINGLE, DISTANCE, BUCKET_ROWS = 3, 2, 48
_BITS = 64
_ALL = (1 << _BITS) - 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A-Z lower-cased, words, shingles with repeats; bits set in over half the hashes."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        columns = [words[i:] for i in range(shingle)]
        hashes = [digest(x, 42) for x in map(b" ".join, zip(*columns))]  # noqa: B905
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint as a signed long), per row."""
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            parts = bytes_in_parts(batch.column("text"))
            prints = [fingerprint(t, shingle) for texts in parts for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "th", "fp"],
            )

    docs = documents.select("doc_id", "text", text_key().alias("th"))
    return docs.mapInArrow(run, "doc_id long, th long, fp long")


def _signed(mask: int) -> int:
    mask &= _ALL
    return mask - (1 << _BITS) if mask >> (_BITS - 1) else mask


def _masks(distance: int) -> list[int]:
    """Bits of every pair of blocks."""
    edges = [round(_BITS * i / (distance + 2)) for i in range(distance + 3)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def links(prints: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most ``distance`` bits apart.

    ``prints`` has distinct values ``fp``. Every link is between fingerprints that
    close; in large buckets only links to the smallest of a value are stated, which
    connects the same fingerprints.
    """
    if distance % 2:
        raise ValueError("the distance must be even")
    masks = _masks(distance)
    bucket = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
                for i, m in enumerate(masks)
            ]
        )
    ).alias("e")
    members = prints.select("fp", bucket).select("fp", "e.t", "e.k")
    sizes = members.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    sized = stored(members.join(sizes, ["t", "k"]), "buckets")
    few = sized.where(F.col("n") <= bucket_rows).select("t", "k", F.col("fp").alias("a"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    paired = (
        few.join(few.withColumnRenamed("a", "b"), ["t", "k"])
        .where((F.col("a") > F.col("b")) & close)
        .select("a", "b")
    )
    many = sized.where(F.col("n") > bucket_rows)
    stated = many.select("t", "fp", F.explode(_variants(masks, distance // 2)).alias("v"))
    # Values that only one member states link nothing.
    hubs = stated.groupBy("t", "v").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
    starred = (
        stated.join(hubs.where("b < top"), ["t", "v"])
        .select(F.col("fp").alias("a"), "b")
        .where((F.col("a") > F.col("b")) & close)
    )
    return paired.unionByName(starred).distinct()


def _variants(masks: list[int], flips: int) -> Column:
    """All values at most ``flips`` bits away, outside the bits that the bucket fixes."""
    choice = F.lit(None).cast("array<long>")
    for t, mask in enumerate(masks):
        free = [1 << i for i in range(_BITS) if not mask >> i & 1]
        turns = [0, *(sum(c) for n in range(1, flips + 1) for c in combinations(free, n))]
        values = F.transform(
            F.array(*[F.lit(_signed(x)) for x in turns]), lambda x: F.col("fp").bitwiseXOR(x)
        )
        choice = F.when(F.col("t") == t, values).otherwise(choice)
    return choice


def groups(
    documents: DataFrame,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """doc_id, th, fp, root (smallest linked fingerprint) and component_id, per row.

    component_id is the smallest doc_id of the group, null only if all ids are. A null
    text has no words, and texts without words share the fingerprint zero. Repeated
    rows are rows of one group.
    """
    prints = stored(fingerprints(documents, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), distance, bucket_rows))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # Written, so that the rows of a common fingerprint can be split.
    named = stored(rooted.select("fp", "root").join(stored(smallest, "smallest"), "root"), "named")
    return prints.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def digest(documents: DataFrame) -> DataFrame:
    found = groups(documents)
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def representatives(
    documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """``documents`` with one row of each group: the smallest doc_id, null ids last.

    Of rows that share that doc_id, the one with the smallest hash of its text stays,
    and of equal rows one. All columns are kept.
    """
    found = groups(documents, shingle, distance)
    best = found.where("doc_id <=> component_id").groupBy("root", "component_id").agg(
        F.min("th").alias("th")
    )
    chosen = best.select(*_named("component_id"), "th").distinct()
    # Equal rows meet first, in the tasks that read them and then by the key of the
    # join, so texts are shuffled once. A row is one value: no column can be mistaken.
    keyed = documents.select(*_named("doc_id"), text_key().alias("th"), F.struct("*").alias("row"))
    one = keyed.groupBy("id", "nameless", "th").agg(F.first("row").alias("row"))
    return one.join(chosen, ["id", "nameless", "th"], "left_semi").select("row.*")


def _named(doc_id: str) -> list[Column]:
    """A doc_id as two columns without nulls, which a join can compare."""
    return [F.coalesce(doc_id, F.lit(0)).alias("id"), F.isnull(doc_id).alias("nameless")]
