"""Merkle manifest of a table: a postorder append log built in aligned blocks.

Every row is a leaf. The leaves of a language, in the order of their ids, are the lowest
level of a tree in which 8 neighbours become one node; the roots of the languages are
the leaves of one more tree of the same kind.

A builder takes 512 leaves that begin at a multiple of 512, so its subtrees meet no
other builder's, and appends every node to its block of the log as it is completed:
children first, then their parent. The tops of the blocks are the leaves of the next
tier, until one node is left. In such a log a node's position follows from its level and
index alone, by counting the nodes that are completed before it (``position``); proofs
read siblings at computed positions and follow no pointers.

How it runs. Texts are hashed in the scan and not moved. Leaves are dealt out in ranges
of (lang, doc_id), so a language with most rows is spread like any other; their places
come from counts per range. One shuffle brings the 512 of a block together, one row a
block goes through the tiers, and proofs go down again, a block at a time. The tiers
grow with the logarithm of the rows; each is a written table, so a lost executor costs
a part of one tier.

Defined results: nulls hash as ``-`` and come first; rows with one doc_id come in the
order of their digests, so equal rows are interchangeable; a null doc_id is never
tampered with, having no digits; an empty table has no leaves and no root. Other columns
are ignored. A proof without siblings is the digest of an empty string.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 3
FANOUT = 1 << BITS
TIER = 3  # levels of a builder
SPAN = FANOUT**TIER  # leaves of a builder
TAMPERED = 3  # rows whose checksum of the id this divides
BYTES = 32


def field(value: Column) -> Column:
    """A value that tells where it ends: bytes, colon, value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed): each row's digest; changed: that of a tampered row."""
    original = [F.col(c) for c in COLUMNS]
    changed = [lowered(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return documents.select(
        "doc_id", "lang", leaf(original).alias("leaf"), F.when(tampered, leaf(changed)).alias("changed")
    )


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, its rank from 0 in the given order, ties broken at will.

    Ranges are sorted one by one; a window sees one count for each range, never rows.
    """
    df = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("place", 33)
    counts = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    rest = [c for c in df.columns if c != "place"]
    # One row for each partition of a shuffle.
    return df.withColumn("part", part).join(F.broadcast(starts), "part").select(*rest, at.alias("place"))


def position(level: int, index: int, n: int, levels: int) -> int:
    """Where the node stands in the postorder log of a tree over ``n`` leaves.

    When it is completed, the first ``seen`` leaves are. Of its own and lower levels all
    nodes over them are in the log; of higher levels those that were full one leaf ago.
    """
    seen = min((index + 1) * FANOUT**level, n)
    lower = sum(-(-seen // FANOUT**k) for k in range(level + 1))
    return lower + sum((seen - 1) // FANOUT**k for k in range(level + 1, levels + 1)) - 1


def levels_over(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def combined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def build(digests: list[str], levels: int) -> bytes:
    """The log of a builder: nodes in the order in which they are completed."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def append(node: str, level: int) -> None:
        log.append(node)
        if level < levels:
            open_[level].append(node)
            if len(open_[level]) == FANOUT:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        append(combined(run), level + 1)

    for digest in digests:
        append(digest, 0)
    for level in range(levels):  # the last run of a level may be short
        if open_[level]:
            close(level)
    return b"".join(map(bytes.fromhex, log))


def node(log: bytes, at: int) -> str:
    return log[BYTES * at : BYTES * (at + 1)].hex()


def siblings(log: bytes, n: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each leaf, bottom up, the siblings on the left and on the right of its path."""
    found: list[list[tuple[str, str]]] = []
    for level in range(levels):
        count = -(-n // FANOUT**level)
        nodes = [node(log, position(level, i, n, levels)) for i in range(count)]
        runs = []
        for i in range(count):
            start = i - i % FANOUT
            runs.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + FANOUT])))
        found.append(runs)
    return [[found[level][i // FANOUT**level] for level in range(levels)] for i in range(n)]


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


_BLOCK = (
    "tree long, block long, nodes long, levels int, log binary, ids array<long>, changed array<string>, top string"
)
_BLOCK_ARROW = pa.schema(
    [
        ("tree", pa.int64()),
        ("block", pa.int64()),
        ("nodes", pa.int64()),
        ("levels", pa.int32()),
        ("log", pa.binary()),
        ("ids", pa.list_(pa.int64())),
        ("changed", pa.list_(pa.string())),
        ("top", pa.string()),
    ]
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, from leaves in order."""

    def closed(key, rows) -> pa.RecordBatch:
        (tree, block), nodes = key, rows[0][0]
        levels = levels_over(nodes) if nodes <= SPAN else TIER
        log = build([r[1] for r in rows], levels)
        row = (tree, block, nodes, levels, log, [r[2] for r in rows], [r[3] for r in rows], node(log, -1 + len(log) // BYTES))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_ARROW.types, strict=True)], schema=_BLOCK_ARROW)

    key, rows = None, []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("tree", "place", "nodes", "leaf", "id", "changed")]
        for tree, place, *row in zip(*columns, strict=True):
            if (tree, place // SPAN) != key:
                if rows:
                    yield closed(key, rows)
                key, rows = (tree, place // SPAN), []
            rows.append(row)
    if rows:
        yield closed(key, rows)


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every tier, the lowest first.

    ``nodes``: tree, place in it from 0, nodes (how many the tree has), leaf, id, changed.
    """
    out: list[DataFrame] = []
    while True:
        block = F.floor(F.col("place") / SPAN)
        blocks = stored(
            nodes.withColumn("block", block)
            .repartition("tree", "block")
            .sortWithinPartitions("tree", "place")
            .select("tree", "place", "nodes", "leaf", "id", "changed")
            .mapInArrow(_blocks, _BLOCK),
            f"tier{len(out)}",
        )
        out.append(blocks)
        above = blocks.where(F.col("nodes") > SPAN)
        if above.isEmpty():
            return out
        nodes = above.select(
            "tree",
            F.col("block").alias("place"),
            F.ceil(F.col("nodes") / SPAN).alias("nodes"),
            F.col("top").alias("leaf"),
            F.lit(None).cast("long").alias("id"),
            F.lit(None).cast("string").alias("changed"),
        )


_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH = "tree long, place long, leaf string, path array<struct<left: string, right: string>>, subroot string, root string"
_PATH_ARROW = pa.schema(
    [("tree", pa.int64()), ("place", pa.int64()), ("leaf", pa.string()), ("path", _STEP), ("subroot", pa.string()), ("root", pa.string())]
)
_PROOF = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def _opened(batch: pa.RecordBatch):
    """Each block of a batch with what proofs of its leaves need."""
    for row in _rows(batch):
        log, levels = row["log"], row["levels"]
        n = len(row["ids"])
        above = [(s["left"], s["right"]) for s in row["path"]]
        yield row, [node(log, position(0, i, n, levels)) for i in range(n)], siblings(log, n, levels), above


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each leaf of a block, its whole path to the root."""
    for batch in batches:
        for row, digests, below, above in _opened(batch):
            n, start = len(digests), row["block"] * SPAN
            listed = [[{"left": a, "right": b} for a, b in path + above] for path in below]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * n, pa.int64()),
                    pa.array(range(start, start + n), pa.int64()),
                    pa.array(digests),
                    pa.array(listed, _STEP),
                    pa.array([row["subroot"]] * n, pa.string()),
                    pa.array([row["root"]] * n, pa.string()),
                ],
                schema=_PATH_ARROW,
            )


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        for row, digests, below, above in _opened(batch):
            subroot, root = row["subroot"], row["root"]
            proof = [combined([x for step in path + above for x in step]) for path in below]
            end = [folded(c or d, path + above) for c, d, path in zip(row["changed"], digests, below, strict=True)]
            n = len(digests)
            columns = [row["ids"], digests, [subroot] * n, [root] * n, proof, end, [e == root for e in end]]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _addressed(levels: list[DataFrame], tops: DataFrame):
    """Blocks of the lowest tier with the path above each; ``tops``: that of each tree."""
    above = None
    for blocks in reversed(levels):
        # A tree's highest block takes the path of its tree, others that of their node above.
        paths = tops.withColumn("block", F.lit(0).cast("long")).withColumn("highest", F.lit(True))
        if above is not None:
            paths = paths.unionByName(
                above.select("tree", F.col("place").alias("block"), "path", "subroot", "root", F.lit(False).alias("highest"))
            )
        joined = blocks.withColumn("highest", F.col("nodes") <= SPAN).join(paths, ["tree", "block", "highest"])
        if blocks is levels[0]:
            return joined
        above = stored(joined.mapInArrow(_paths, _PATH), "paths")


@dataclass(frozen=True)
class Manifest:
    """The written log: blocks of the trees of languages and of the tree above them.

    ``languages``: lang, tree (number of its tree), start (place of its first leaf among
    all), nodes (how many leaves it has).
    """

    languages: DataFrame
    lower: list[DataFrame]
    upper: list[DataFrame]

    def subroots(self) -> DataFrame:
        """(tree, subroot) of every language."""
        return _tops(self.lower).select("tree", F.col("top").alias("subroot"))

    def root(self) -> str | None:
        row = _tops(self.upper).select("top").first()
        return row and row["top"]

    def log(self) -> DataFrame:
        """(lang, position, level, index, digest): the trees of languages as one log each."""
        parts = [
            blocks.select("tree", "block", "levels", "log", F.size("ids").alias("n")).mapInArrow(
                _entries(tier * TIER), "tree long, level int, index long, digest string"
            )
            for tier, blocks in enumerate(self.lower)
        ]
        nodes = parts[0]
        for part in parts[1:]:
            # A tier's leaves are the tops of the blocks below it and stand there.
            nodes = nodes.unionByName(part)
        sizes = self.languages.select("lang", "tree", "nodes")
        return nodes.join(sizes, "tree").select("lang", _position_column().alias("position"), "level", "index", "digest")

    def proofs(self) -> DataFrame:
        """Every leaf's proof, and where folding it (tampered, if it was) ends."""
        empty = F.array().cast("array<struct<left: string, right: string>>")
        top = _tops(self.upper).select("tree", empty.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("top").alias("root"))
        of_languages = _addressed(self.upper, top).mapInArrow(_paths, _PATH)
        tops = of_languages.select(F.col("place").alias("tree"), "path", F.col("leaf").alias("subroot"), "root")
        return _addressed(self.lower, stored(tops, "languages")).mapInArrow(_proofs, _PROOF)


def _tops(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for blocks in levels[1:]:
        out = out.unionByName(blocks)
    return out.where(F.col("nodes") <= SPAN)


def _entries(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                n, levels, log = row["n"], row["levels"], row["log"]
                found = []
                for level in range(1 if base else 0, levels + 1):
                    first = row["block"] * FANOUT ** (TIER - level) if level <= TIER else 0
                    for i in range(-(-n // FANOUT**level)):
                        found.append((row["tree"], base + level, first + i, node(log, position(level, i, n, levels))))
                if found:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)],
                        ["tree", "level", "index", "digest"],
                    )

    return run


def _position_column() -> Column:
    """``position`` as a column, of level, index and nodes."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level") * BITS)
    seen = F.least((F.col("index") + 1) * width, F.col("nodes"))
    total = F.lit(-1).cast("long")
    for k in range(63 // BITS):
        full, begun = F.shiftright(seen - 1, BITS * k), -F.shiftright(-seen, BITS * k)
        total = total + F.when(F.col("level") >= k, begun).otherwise(full)
    return total


def manifest(documents: DataFrame) -> Manifest:
    """Builds and writes the log of ``documents``."""
    # Many equal rows are spread over ranges by a last key.
    written = stored(leaves(documents), "leaves").withColumn("tie", F.monotonically_increasing_id())
    placed = stored(numbered(written, "lang", "doc_id", "leaf", "tie").drop("tie"), "placed")
    spans = placed.groupBy("lang").agg(F.min("place").alias("start"), F.count("*").alias("nodes"))
    languages = stored(numbered(spans, "lang").withColumnRenamed("place", "tree"), "spans")
    named = languages.select(F.col("lang").alias("named"), "tree", "start", "nodes")
    nodes = placed.join(named, placed["lang"].eqNullSafe(named["named"])).select(
        "tree", (F.col("place") - F.col("start")).alias("place"), "nodes", "leaf", F.col("doc_id").alias("id"), "changed"
    )
    lower = tiers(nodes)
    count = languages.count()
    none = F.lit(None)
    upper = tiers(
        _tops(lower).select(
            F.lit(0).cast("long").alias("tree"),
            F.col("tree").alias("place"),
            F.lit(count).cast("long").alias("nodes"),
            F.col("top").alias("leaf"),
            none.cast("long").alias("id"),
            none.cast("string").alias("changed"),
        )
    )
    return Manifest(languages, lower, upper)


def digest(documents: DataFrame) -> DataFrame:
    """Every row's leaf, roots and proof, and whether its tampered copy still verifies."""
    return manifest(documents).proofs()
