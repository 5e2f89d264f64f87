"""Packing documents into sequences, by linear grouping over the histogram of lengths.

Lengths are at most the capacity, so their histogram is small whatever the corpus, and
the whole packing is planned on it: large lengths are sorted and cut into groups of
equal cardinality, each rounded up to its longest; patterns of few rounded sizes that
fill a sequence are chosen for all groups; the real lengths take the rounded places;
small lengths fill what is left, tightest place first. The plan is a list of runs
(pieces of one length, by rank, go to so many consecutive sequences), whose number
depends on the capacity and not on the corpus. Pieces find their run by length and
rank, and ranks are computed in two levels, so no task holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bytes_in_parts, give_back, importable, stored, text_key
from ledgerloom.llm.tokens import encoder, vocabulary_path

CAPACITY, END, SALTS = 2048, 0, 128
# Lengths up to capacity / SMALL_PART are small. The plan with the fewest sequences of
# these numbers of groups is used; all are far below the number of large lengths (1792),
# so sizes are few and most lengths are rounded.
SMALL_PART, GROUPS = 8, (64, 128, 256)

_PIECES = "doc_id long, th long, piece int, start long, length long, ids_crc32 long"


def pieces(
    documents: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    end: int = END,
) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of ``capacity`` if longer.

    Columns doc_id, th (hash of the text), piece, start, length, ids_crc32. A null text
    is empty and gives one piece of one id.
    """
    importable(documents.sparkSession)
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keep="tokens")
        tokenizer = encoder(path)
        for batch in batches:
            done = 0
            for texts in bytes_in_parts(batch.column("text")):
                ids, bounds = tokenizer.encode(texts, end)
                data = memoryview(ids.astype("<u4").view(np.uint8))
                sizes = np.diff(bounds)
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(len(texts)), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = (bounds[row] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                rows = pa.array(row + done)
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("th").take(rows),
                        pa.array(piece, pa.int32()),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[c.split()[0] for c in _PIECES.split(", ")],
                )
            # The words stay for the worker's next task, all else goes back.
            give_back(keep="tokens")

    docs = documents.select("doc_id", "text", text_key().alias("th"))
    return docs.mapInArrow(run, _PIECES)


def _fullest(sizes: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each size fill ``room`` best, large sizes first among equals."""
    mask = (1 << (room + 1)) - 1
    stages = []  # sums reachable with this size and smaller ones
    reach = 1
    for size in reversed(sizes):
        if size > room or not counts[size]:
            continue
        stages.append((size, reach))
        more = reach
        for _ in range(min(counts[size], room // size)):
            more = reach | (more << size) & mask
        reach = more
    left = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for size, without in reversed(stages):
        for k in range(min(counts[size], left // size), -1, -1):
            if without >> (left - k * size) & 1:
                break
        if k:
            chosen[size] = k
            left -= k * size
    return chosen


class Plan:
    """Runs of a packing: pieces of ``length`` with ranks from ``rank`` on, ``count`` of
    them, go to sequences from ``sequence`` on, ``per`` in each, from ``offset`` on."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[0]):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = {}  # room left: (sequence, count)
        self.rooms: list[int] = []
        limit = capacity // SMALL_PART
        large = {n: c for n, c in histogram.items() if n > limit}
        self._ranks: dict[int, int] = {}
        if large:
            self._large(large, groups)
        for length in sorted((n for n in histogram if n <= limit), reverse=True):
            self._small(length, histogram[length])

    def _leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in self.room:
                insort(self.rooms, room)
                self.room[room] = []
            self.room[room].append((sequence, count))

    def _groups(self, large: dict[int, int], groups: int) -> dict[int, list[list[int]]]:
        """Rounded size: its real [length, count] in falling order."""
        total, out, passed = sum(large.values()), {}, 0
        share = -(-total // groups)
        rounded = None
        for length in sorted(large, reverse=True):
            left = large[length]
            while left:
                if passed % share == 0:
                    rounded = length
                take = min(left, share - passed % share)
                members = out.setdefault(rounded, [])
                if members and members[-1][0] == length:
                    members[-1][1] += take
                else:
                    members.append([length, take])
                passed, left = passed + take, left - take
        return out

    def _large(self, large: dict[int, int], groups: int) -> None:
        members = self._groups(large, groups)
        counts = {size: sum(c for _, c in m) for size, m in members.items()}
        sizes = sorted(members, reverse=True)
        for longest in sizes:
            while counts[longest]:
                counts[longest] -= 1
                pattern = _fullest(sizes, counts, self.capacity - longest)
                counts[longest] += 1
                pattern[longest] = pattern.get(longest, 0) + 1
                times = min(counts[s] // k for s, k in pattern.items())
                self._place(pattern, times, members)
                for s, k in pattern.items():
                    counts[s] -= k * times

    def _place(self, pattern: dict[int, int], times: int, members: dict) -> None:
        """``times`` sequences of a pattern, filled with real lengths."""
        stretches = [(self.sequences, times, 0)]  # sequence, count, ids so far
        self.sequences += times
        for size in sorted(pattern, reverse=True):
            for _ in range(pattern[size]):
                filled = []
                for sequence, count, used in stretches:
                    while count:
                        head = members[size][0]
                        length, take = head[0], min(count, head[1])
                        self._run(length, take, sequence, 1, used)
                        filled.append((sequence, take, used + length))
                        head[1] -= take
                        if not head[1]:
                            members[size].pop(0)
                        sequence, count = sequence + take, count - take
                stretches = filled
        for sequence, count, used in stretches:
            self._leave(self.capacity - used, sequence, count)

    def _run(self, length: int, count: int, sequence: int, per: int, offset: int) -> None:
        rank = self._ranks.get(length, 0)
        self._ranks[length] = rank + count
        self.runs.append((length, rank, count, sequence, per, offset))

    def _small(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                sequence, there = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room], self.rooms[at]
            else:
                room, sequence, there = self.capacity, self.sequences, -(-count // (self.capacity // length))
                self.sequences += there
            per = room // length
            full = min(there, count // per)
            if full:
                self._run(length, full * per, sequence, per, self.capacity - room)
                self._leave(room - per * length, sequence, full)
                count -= full * per
            if full < there:
                if count:  # fewer than one sequence takes
                    self._run(length, count, sequence + full, count, self.capacity - room)
                    self._leave(room - count * length, sequence + full, 1)
                    count, full = 0, full + 1
                self._leave(room, sequence + full, there - full)

    def arrays(self) -> dict[str, np.ndarray]:
        table = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        return dict(zip(("length", "rank", "count", "sequence", "per", "offset"), table.T, strict=True))


def ranked(cut: DataFrame, salts: int = SALTS) -> tuple[DataFrame, dict[int, int]]:
    """``cut`` plus rank, its place among pieces of its length; and the histogram."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th", "piece"), F.lit(salts)))
    sums = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    earlier = Window.partitionBy("length").orderBy("salt")
    sums_before = sums.select(
        "length", "salt", (F.sum("n").over(earlier) - F.col("n")).alias("before")
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "th", "piece")
    out = salted.join(sums_before, ["length", "salt"]).withColumn(
        "rank", F.col("before") + F.row_number().over(order) - 1
    )
    # At most ``capacity`` rows.
    histogram = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("n")).collect()}
    return out.drop("salt", "before"), histogram


def assign(cut: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """``cut`` (as from ``pieces``) with sequence_id and offset. Sequences hold at most
    ``capacity`` ids and have no gaps. Repeated rows are packed each by itself."""
    with_rank, histogram = ranked(cut)
    plans = [Plan(histogram, capacity, n) for n in groups]
    plan = min(plans, key=lambda p: p.sequences).arrays()
    # One sorted number for (length, rank); ranks stay far below 2**48.
    keys = (plan["length"] << 48) + plan["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            n = rank - plan["rank"][at]
            sequence, place = np.divmod(n, plan["per"][at])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(plan["sequence"][at] + sequence),
                    pa.array(plan["offset"][at] + place * length),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    return with_rank.mapInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long",
    )


def pack(
    documents: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    end: int = END,
    groups: tuple[int, ...] = GROUPS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids and repeated rows are packed like others; other columns are ignored; no
    documents give no rows.
    """
    return assign(stored(pieces(documents, capacity, vocabulary, end), "pieces"), capacity, groups)
