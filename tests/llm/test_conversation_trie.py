"""The trie against its definition, node by node."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from document_rows import CLASHING
from pyspark.sql import functions as F

from ledgerloom.llm import conversation_trie, sql
from ledgerloom.llm.conversation_trie import peel

SCHEMA = "conv_id long, turn long, role string, text string"


def code(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.md5(f"{len(role)}:".encode() + role + text).hexdigest()


def sequences(rows):
    """conv_id -> rebuilt turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, code(role, text), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        out[conv] = own.get(base, [])[:h] + turns[h:]
    return out


def nodes(rows):
    convs = sequences(rows)
    members, children = defaultdict(list), defaultdict(list)
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children[prefix]
        own = (len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        leaves[prefix] = sum(leaves[b] for b in below) or 1
        saved[prefix] = own + sum(saved[b] for b in below)
    out = Counter()
    for prefix, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        sums = (len(inside), len(children[prefix]), leaves[prefix], saved[prefix])
        out[(min(inside), len(prefix), parent, *sums, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def awkward():
    """Nulls, repeated turns and rows, copies, absent first conversations, extreme ids, long chains."""
    rng = random.Random(5)
    rows = []
    for conv in [*range(-12, 60), 2**63 - 1, -(2**63)]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 12, 40])):
            role, text = rng.choice(["u", "a", None, ""]), rng.choice(["x", "y", None, "ü", "", "A long reply"])
            rows.append((conv, rng.choice([turn, turn, None, 0]), role, text))
    for conv in (100, 105, 110, 115, 200, 205):
        rows += [(conv, t, "u", f"t{t}") for t in range(300 if conv < 200 else 290)]
    return [*rows, *rows[:10], (None, 1, "u", "x")]


def found(frame):
    return Counter(tuple(r) for r in conversation_trie.digest(frame).collect())


def test_nodes(spark):
    assert found(spark.createDataFrame(awkward(), SCHEMA).repartition(3)) == nodes(awkward())


def test_blocks_and_levels_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "TASK_ROWS", 6)
    monkeypatch.setattr(conversation_trie, "TURNS", 20)
    monkeypatch.setattr(conversation_trie, "ROWS", 3)
    monkeypatch.setattr(conversation_trie, "IDS", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert found(spark.createDataFrame(awkward(), SCHEMA)) == nodes(awkward())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


@pytest.mark.parametrize("size", [3, 4, 7])
def test_any_cut_into_blocks_gives_the_same_sums(size):
    """Spines of blocks, peeled again, hold what one block holds."""
    rng = random.Random(size)
    turn = [f"{i:032x}{i + 1:08x}" for i in range(3)]
    paths = sorted({"".join(rng.choices(turn, k=rng.randrange(9))) for _ in range(60)})
    entries = [[(len(p) // 40, 1 + i % 3, i, 0, 0, 0, str(i))] for i, p in enumerate(paths)]
    whole = Counter(r[:2] + r[3:8] for r in peel(paths, entries, True, False)[0])
    rows = []
    while len(paths) > size:
        spines = []
        for i in range(0, len(paths), size):
            block, left = peel(paths[i : i + size], entries[i : i + size], False, False)
            rows += block
            spines += left
        paths, entries = [p for p, _ in spines], [e for _, e in spines]
    rows += peel(paths, entries, True, False)[0]
    assert Counter(r[:2] + r[3:8] for r in rows) == whole


def test_many_copies_and_one_long_conversation(spark):
    copies = [(5 * i, t, "u", f"{t}") for i in range(3000) for t in range(2)]
    long = [(50_001, t, None, "é" * (t % 3)) for t in range(20_000)]
    frame = spark.createDataFrame(copies + long, SCHEMA)
    assert found(frame) == nodes_of_copies(copies, long)


def nodes_of_copies(copies, long):
    """By the same definition, without the prefixes of the long conversation as tuples."""
    out = nodes(copies + [r for r in long if r[1] < 10])
    convs = sequences(copies + long)[50_001]
    n, leaf = len(convs), hashlib.sha256(b"50001").hexdigest()
    short = len(sequences(copies + [r for r in long if r[1] < 10])[50_001])
    none = hashlib.sha256(b"").hexdigest()
    for row in [r for r in out if r[0] == 50_001 and r[1] == short]:
        del out[row]
        first = row[2]
        for depth in range(short, n + 1):
            out[(50_001, depth, first, 1, int(depth < n), 1, 0, leaf if depth == n else none)] += 1
            first = 50_001
    return out


def test_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == Counter()
    assert found(spark.createDataFrame([(None, None, None, None)], SCHEMA)) == Counter()
    # Conversation 7 takes its head from 5, which does not exist, and keeps nothing of its own.
    assert found(spark.createDataFrame([(7, 1, "a", "b")], SCHEMA)) == nodes([(7, 1, "a", "b")])
    frame = spark.createDataFrame(awkward()[:80], SCHEMA)
    names = [c for c in CLASHING if c not in frame.columns] + ["code", "own", "path", "n", "conv", "key", "entries"]
    assert found(frame.select("*", *[F.lit(7).alias(c) for c in dict.fromkeys(names)])) == found(frame)


def test_sql_agrees(spark):
    rows = awkward()
    frame = spark.createDataFrame(rows, SCHEMA)
    with duckdb.connect() as con:
        con.register("conversations", frame.toArrow())
        other = con.sql(sql.statements()["op12_conversation_trie"]).select(", ".join(conversation_trie.digest(frame).columns))
        assert Counter(other.fetchall()) == nodes(rows)
