"""The manifest against its definition, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest
from document_rows import CLASHING, SCHEMA, rows
from pyspark.sql import functions as F

from ledgerloom.llm import merkle, sql

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """The root over nodes, and for each the siblings of its path: (left, right) by level."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i : i + 8]
            for j in range(len(run)):
                for leaf_no in own[i + j]:
                    paths[leaf_no].append((run[:j], run[j + 1 :]))
            above.append(digest(run))
            owners.append([x for group in own[i : i + 8] for x in group])
        nodes, own = above, owners
    return nodes[0], paths


def proofs(table):
    langs = sorted({r[2] for r in table}, key=lambda x: (x is not None, (x or "").encode()))
    if not langs:
        return Counter()
    per = [
        sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in table if r[2] == x), key=lambda k: k[:3])
        for x in langs
    ]
    trees = [tree([x[2] for x in leaves]) for leaves in per]
    root, upper = tree([t[0] for t in trees])
    out = Counter()
    for leaves, (subroot, lower), above in zip(per, trees, upper, strict=True):
        for (_, _, own, row), below in zip(leaves, lower, strict=True):
            doc_id, text, *rest = row
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            folded = leaf(doc_id, text, *rest)
            for left, right in below + above:
                folded = digest([*left, folded, *right])
            listed = digest(x for left, right in below + above for x in left + right)
            out[(doc_id, own, subroot, root, listed, folded, folded == root)] += 1
    return out


def awkward():
    """Nulls and repeated rows, trees of one leaf, of short runs and of several tiers, many languages."""
    return [
        *rows(),
        *[(1000 + i, f"Text {i}", "xx", None, i) for i in range(1100)],
        *[(3000 + i, f"text {i}", "yy", None, i) for i in range(513)],
        *[(5000 + i, None, f"l{i}", "s", None) for i in range(600)],
        *[(None, None, None, None, None)] * 3,
    ]


def found(frame):
    return Counter(tuple(r) for r in merkle.digest(frame).select(COLUMNS).collect())


def test_proofs(spark):
    table = awkward()
    expected = proofs(table)
    assert found(spark.createDataFrame(table, SCHEMA).repartition(3)) == expected
    assert any(not r[-1] for r in expected) and any(r[-1] for r in expected)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_sizes(spark, n):
    table = [(i, f"Text {i}", "en", None, i) for i in range(n)]
    assert found(spark.createDataFrame(table, SCHEMA)) == proofs(table)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 512])
@pytest.mark.parametrize("more", [0, 2])
def test_positions_are_those_of_the_log(n, more):
    """Also where the last nodes of all levels have one child."""
    levels = merkle.levels_over(n) + more
    digests = [digest([str(i)]) for i in range(n)]
    log = merkle.build(digests, levels)
    at = {}
    nodes = digests
    for level in range(levels + 1):
        for i, node in enumerate(nodes):
            place = merkle.position(level, i, n, levels)
            assert merkle.node(log, place) == node
            at[place] = level
        nodes = [digest(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    assert sorted(at) == list(range(len(log) // 32))


def test_the_log_is_in_the_order_of_completion(spark):
    table = awkward()
    made = merkle.manifest(spark.createDataFrame(table, SCHEMA))
    by_lang = {}
    for r in made.log().collect():
        by_lang.setdefault(r["lang"], []).append((r["position"], r["level"], r["index"], r["digest"]))
    for lang, log in by_lang.items():
        log.sort()
        assert [x[0] for x in log] == list(range(len(log)))
        leaves = [x[3] for x in log if x[1] == 0]
        stack: list[tuple] = []  # a node's children are the last before it, as in any postorder
        for _, level, index, node in log:
            if level:
                children = [s for s in stack if s[0] == level - 1]
                assert digest(s[2] for s in children) == node
                assert [s[1] // 8 for s in children] == [index] * len(children)
                stack = stack[: len(stack) - len(children)]
            stack.append((level, index, node))
        expected = sorted((r[0] is not None, r[0] or 0, leaf(*r)) for r in table if r[2] == lang)
        assert leaves == [x[2] for x in expected]
        assert stack == [(log[-1][1], 0, tree(leaves)[0])]
    assert {r["root"] for r in made.proofs().select("root").distinct().collect()} == {made.root()}


def test_other_columns(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    names = [c for c in CLASHING if c not in frame.columns]
    names += ["leaf", "changed", "tree", "block", "nodes", "levels", "log", "path", "tie", "before", "index"]
    assert found(frame.select("*", *[F.lit(7).alias(c) for c in dict.fromkeys(names)])) == proofs(rows())


def test_sql_agrees(spark):
    frame = spark.createDataFrame(awkward(), SCHEMA)
    with duckdb.connect() as con:
        con.register("documents", frame.toArrow())
        other = con.sql(sql.statements()["op13_merkle"]).select(", ".join(COLUMNS)).fetchall()
    assert Counter(other) == proofs(awkward())
