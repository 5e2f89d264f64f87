"""Prefix trie of conversations, by truncation peeling.

A conversation is its sequence of turns (role, text). Peeling starts at the greatest
depth: conversations that end there join the nodes that survive from below, each node
is finished, its last turn is stripped, and nodes with one remaining sequence merge. So
one descent finds every node and sums what lies under it.

How it runs. A turn is a digest of fixed width, a conversation the string of its
digests, so the order of strings is the order of the trie and a prefix of turns is a
prefix of the string. Equal conversations become one row. The rows are dealt out in
ranges of that order, which no popular first turn can make uneven, and every task peels
blocks of neighbouring rows. Only prefixes of a block's first and last row can occur in
other blocks: these two *spines* leave the block with what was summed at each depth, and
are peeled again as rows of the next level, until one small block holds all. Work grows
with the number of turns, the number of levels with the logarithm of the blocks; depth
costs no rounds. Texts never leave the scan; a conversation's digests (40 characters a
turn) are one string, so a task holds at least the 64 longest of its block.

Defined results: rows without conv_id take no part; a null role or text is empty; turns
of one conversation with the same number come in the order of their digests, and a
repeated row is one more turn; an empty table has no nodes, not even a root. ``%``
truncates towards zero, so conversation -7 belongs to -5. Other columns are ignored.
Equality of turns is by 128-bit digests and lengths.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

FAMILY = 5  # conversations c - c % FAMILY .. share a head
HEADS = 9  # of fewer than this many turns

DIGEST, SIZE = 32, 8  # hexadecimal characters
WIDTH = DIGEST + SIZE

# A block is peeled at once: this many turns, but never fewer rows than ROWS.
TURNS, ROWS = 200_000, 64
# Rows and characters of a task.
TASK_ROWS, TASK_CHARS = 4_000, 64 << 20
# Conversation numbers in one fragment of a list of ends.
IDS = 1024

ENTRY = "depth int, n long, conv long, children long, leaves long, saved long, ends string"
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn): every turn's place from 1 and its digest with its length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text)
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "code")
    return (
        conversations.where("conv_id IS NOT NULL")
        .select("conv_id", "turn", F.concat(digest, F.lpad(F.hex(size), SIZE, "0")).alias("code"))
        .select("conv_id", F.row_number().over(order).alias("place"), F.col("code").alias("turn"))
    )


def head(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): head of the family's first conversation, then what follows its own.

    A turn goes to its own conversation and, if it is in a head, to the at most nine
    that can take it; those that do not exist have no turn of their own and go again.
    """
    kin = F.array(*[F.try_add("conv_id", F.lit(i).cast("long")) for i in range(1 - FAMILY, FAMILY)])
    takers = F.filter(
        kin, lambda c: (c - c % FAMILY == F.col("conv_id")) & (F.col("place") <= head(c))
    )
    to = F.transform(takers, lambda c: F.struct(c.alias("id"), F.lit(False).alias("own")))
    own = F.array(F.struct(F.col("conv_id").alias("id"), F.lit(True).alias("own")))
    is_first = (F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)
    sent = (
        turns(conversations)
        .withColumn("to", F.explode(F.when(is_first, F.concat(own, to)).otherwise(own)))
        .select(F.col("to.id").alias("conv_id"), "to.own", "place", "turn")
    )
    taken = ~F.col("own") | (F.col("place") > head(F.col("conv_id")))
    listed = F.sort_array(F.collect_list(F.when(taken, F.struct("place", "turn"))))
    return (
        sent.groupBy("conv_id")
        .agg(F.max("own").alias("own"), listed.alias("turns"))
        .where("own")
        .select("conv_id", F.array_join(F.col("turns.turn"), "").alias("path"))
    )


def _digest_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes the fragments of each key, which come in order, as they pass."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends"])


def ends(paths: DataFrame) -> DataFrame:
    """(key, ends): digest of the ascending numbers of the conversations of each path.

    Numbers are joined in fragments first, so a path of many copies reaches the task
    that hashes it as a few long rows, which pass one after another.
    """
    fragments = (
        paths.groupBy(F.md5("path").alias("key"), F.floor(F.col("conv_id") / IDS).alias("range"))
        .agg(F.sort_array(F.collect_list("conv_id")).cast("array<string>").alias("ids"))
        .select("key", "range", F.array_join("ids", ",").alias("ids"))
    )
    return (
        fragments.repartition("key")
        .sortWithinPartitions("key", "range")
        .select("key", "ids")
        .mapInArrow(_digest_of_ids, "key string, ends string")
    )


class _State:
    """What a node has gathered; kids are finished children that wait for its conv_id."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "ends", "kids")

    def __init__(self) -> None:
        self.n = self.children = self.leaves = self.saved = 0
        self.conv = self.ends = None
        self.kids: list[tuple] = []

    def add(self, n, conv, children, leaves, saved, ends=None) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if self.conv is None or conv is not None and conv < self.conv:
            self.conv = conv
        if ends is not None:
            self.ends = ends

    def merge(self, other: _State) -> None:
        self.add(other.n, other.conv, other.children, other.leaves, other.saved, other.ends)
        if len(self.kids) < len(other.kids):
            self.kids, other.kids = other.kids, self.kids
        self.kids += other.kids


def _shared(a: str, b: str) -> int:
    """Turns that two paths have in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def _keys(path: str) -> list[str]:
    """A name for each prefix of a path, the empty one first."""
    state = hashlib.md5()
    out = [state.hexdigest()]
    for i in range(0, len(path), WIDTH):
        state.update(path[i : i + WIDTH].encode())
        out.append(state.hexdigest())
    return out


NO_ENDS = hashlib.sha256().hexdigest()


def peel(paths: list[str], entries: list[list[tuple]], whole: bool, named: bool):
    """Peels one block: distinct paths in ascending order, each with sums by depth.

    Returns node rows (``NODE``, own key, parent's key) and spines (path, entries).
    ``whole``: the block is all there is, so every node is finished. ``named``: nodes
    get keys, by which children finished earlier find their parent.
    """
    last = len(paths) - 1
    ended, meet, given = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, path in enumerate(paths):
        ended[len(path) // WIDTH].append(i)
        for depth, *sums in entries[i]:
            given[depth].append((i, sums))
    for i in range(last):
        meet[_shared(paths[i], paths[i + 1])].append(i)

    group = list(range(len(paths)))

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    keys = {i: _keys(paths[i]) for i in (range(last + 1) if named else {0, last}) if named or not whole}
    rows: list[tuple] = []
    spines: dict[int, list[tuple]] = {0: [], last: []}
    alive: dict[int, _State] = {}
    for depth in range(max(ended), -1, -1):
        # Conversations that end here join; stripped sequences that have become equal merge.
        for i in ended[depth]:
            alive[i] = _State()
        for i in meet[depth]:
            a, b = find(i), find(i + 1)
            group[b] = a
            alive[a].merge(alive.pop(b))
        for i, sums in given[depth]:
            alive[find(i)].add(*sums)
        first, final = find(0), find(last)
        for i, state in alive.items():
            stripped = alive[i] = _State()
            if not whole and i in (first, final):
                # Other blocks may share it: what it gathered waits in the spine.
                spine = 0 if i == first else last
                if state.n:
                    spines[spine].append(
                        (depth, state.n, state.conv, state.children, state.leaves, state.saved, state.ends)
                    )
                rows += [(*kid[:2], None, *kid[3:], keys[spine][depth]) for kid in state.kids]
                continue
            size = int(paths[i][depth * WIDTH - SIZE : depth * WIDTH], 16) if depth else 0
            leaves, saved = state.leaves or 1, state.saved + (state.n - 1) * size
            rows += [(*kid[:2], state.conv, *kid[3:], None) for kid in state.kids]
            key = keys[i][depth] if named else None
            node = (state.conv, depth, None, state.n, state.children, leaves, saved, state.ends or NO_ENDS, key)
            if depth:
                stripped.add(state.n, state.conv, 1, leaves, saved)
                stripped.kids.append(node)
            else:
                rows.append((*node, None))
    return rows, [] if whole else [(paths[i], x) for i, x in spines.items()]


_NODE_ARROW = [
    ("conv_id", pa.int64()),
    ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()),
    ("n_children", pa.int64()),
    ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()),
    ("key", pa.string()),
    ("parent_key", pa.string()),
]
_ENTRY_ARROW = pa.struct(
    [
        ("depth", pa.int32()),
        ("n", pa.int64()),
        ("conv", pa.int64()),
        ("children", pa.int64()),
        ("leaves", pa.int64()),
        ("saved", pa.int64()),
        ("ends", pa.string()),
    ]
)
_OUT = pa.schema([*_NODE_ARROW, ("path", pa.string()), ("entries", pa.list_(_ENTRY_ARROW))])
_SLICE = 20_000  # rows in one batch


def _peeler(whole: bool, named: bool):
    """A body for mapInArrow over rows in ascending order of path."""
    names = _ENTRY_ARROW.names

    def out(paths, entries) -> Iterator[pa.RecordBatch]:
        rows, spines = peel(paths, entries, whole, named)
        for i in range(0, len(rows), _SLICE):
            columns = [pa.array(x, t) for x, t in zip(zip(*rows[i : i + _SLICE], strict=True), _OUT.types, strict=False)]
            blank = [pa.nulls(len(columns[0]), t) for t in _OUT.types[len(columns) :]]
            yield pa.RecordBatch.from_arrays([*columns, *blank], schema=_OUT)
        if spines:
            blank = [pa.nulls(len(spines), t) for _, t in _NODE_ARROW]
            listed = [[dict(zip(names, e, strict=True)) for e in x] for _, x in spines]
            yield pa.RecordBatch.from_arrays(
                [*blank, pa.array([p for p, _ in spines]), pa.array(listed, _OUT.types[-1])], schema=_OUT
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        entries: list[list[tuple]] = []
        count = 0
        for batch in batches:
            for path, listed in zip(batch["path"].to_pylist(), batch["entries"].to_pylist(), strict=True):
                if not whole and count >= TURNS and len(paths) >= ROWS:
                    yield from out(paths, entries)
                    paths, entries, count = [], [], 0
                paths.append(path)
                entries.append([tuple(e[k] for k in names) for e in listed])
                count += len(path) // WIDTH + 1
        if paths:
            yield from out(paths, entries)

    return run


def trie(paths: DataFrame) -> DataFrame:
    """Every node of the trie over (conv_id, path); the columns are ``NODE``."""
    spark = paths.sparkSession
    paths = stored(paths, "paths")
    classes = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    zero = F.lit(0).cast("long")
    depth = (F.length("path") / WIDTH).cast("int")
    entry = F.struct(
        depth.alias("depth"), "n", "conv", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends"
    )
    records = stored(
        classes.withColumn("key", F.md5("path")).join(ends(paths), "key").select("path", F.array(entry).alias("entries")),
        "conversations",
    )
    schema = f"{NODE}, key string, parent_key string, path string, entries array<struct<{_ddl(ENTRY)}>>"
    levels: list[DataFrame] = []
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        count, chars = records.agg(F.count("*"), F.sum(F.length("path"))).first()
        tasks = max(min(count // TASK_ROWS, shuffles), (chars or 0) // TASK_CHARS)
        whole = tasks <= 1
        dealt = records.coalesce(1) if whole else records.repartitionByRange(tasks, "path")
        out = stored(
            dealt.sortWithinPartitions("path").mapInArrow(_peeler(whole, bool(levels)), schema), f"level{len(levels)}"
        )
        levels.append(out)
        if whole:
            break
        records = out.where("path IS NOT NULL").select("path", "entries")
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = nodes.where("path IS NULL")
    columns = [c for c in nodes.columns if c not in ("path", "entries", "key", "parent_key")]
    if len(levels) == 1:
        return nodes.select(columns)
    # Children finished before their parent learn its conv_id by its key.
    parents = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    late = nodes.where("parent_key IS NOT NULL").join(parents, "parent_key")
    return (
        nodes.where("parent_key IS NULL")
        .select(columns)
        .unionByName(late.withColumn("parent_conv_id", F.col("found")).select(columns))
    )


def _ddl(columns: str) -> str:
    return ", ".join(": ".join(c.split(" ")) for c in columns.split(", "))


def digest(conversations: DataFrame) -> DataFrame:
    """The nodes of all conversations, rebuilt by families."""
    return trie(rebuilt(conversations))
