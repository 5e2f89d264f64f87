"""DuckDB statements for the trie and the manifest, by other routes."""

from __future__ import annotations

from ledgerloom.llm.conversation_trie import FAMILY, HEADS
from ledgerloom.llm.merkle import COLUMNS, FANOUT, TAMPERED

# Trees of fewer leaves than FANOUT to this power.
_LEVELS = 10


def crc32(text: str) -> str:
    """The checksum of ASCII text, bit by bit."""
    bit = "lambda a, i: xor(a >> 1, 3988292384 * (a & 1))"
    return (
        f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), "
        f"lambda s, b: list_reduce(range(8), {bit}, xor(s, b)), 4294967295::BIGINT), 4294967295)"
    )


def trie() -> str:
    """Nodes grouped by their whole prefixes, sums over every node's ancestors."""
    return f"""
    WITH turns AS MATERIALIZED (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS p, code, bytes
        FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
                     md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code
              FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS MATERIALIZED (
        SELECT conv_id AS c, conv_id - conv_id % {FAMILY} AS base, {crc32('conv_id::VARCHAR')} % {HEADS} AS h
        FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (
        SELECT c, p, code, bytes FROM convs JOIN turns ON conv_id = base WHERE p <= h
        UNION ALL SELECT c, p, code, bytes FROM convs JOIN turns ON conv_id = c WHERE p > h),
    prefixes AS MATERIALIZED (
        SELECT c, row_number() OVER w AS d, md5(string_agg(code, '') OVER w) AS k, bytes
        FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY p)
        UNION ALL SELECT c, 0, '', 0 FROM convs),
    linked AS MATERIALIZED (
        SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS parent, max(d) OVER (PARTITION BY c) AS length FROM prefixes),
    nodes AS MATERIALIZED (
        SELECT d, k, any_value(parent) AS parent, any_value(bytes) AS bytes, min(c) AS conv, count(*) AS n,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = length), '')) AS ends
        FROM linked GROUP BY d, k),
    counted AS MATERIALIZED (
        SELECT nodes.*, coalesce(children, 0) AS children
        FROM nodes LEFT JOIN (SELECT d - 1 AS d, parent AS k, count(*) AS children FROM nodes WHERE d > 0 GROUP BY ALL)
            USING (d, k)),
    sums AS (
        SELECT above.d, above.k, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * counted.bytes) AS saved
        FROM counted JOIN prefixes AS above ON above.c = conv AND above.d <= counted.d GROUP BY above.d, above.k)
    SELECT node.conv AS conv_id, node.d::BIGINT AS depth, up.conv AS parent_conv_id, node.n::BIGINT AS n_convs,
           node.children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
           node.ends AS ends_sha256
    FROM counted AS node JOIN sums USING (d, k) LEFT JOIN nodes AS up ON up.d = node.d - 1 AND up.k = node.parent"""


def _climb(name: str, leaves: str, key: str) -> tuple[list[str], list[str]]:
    """Relations of the levels over ``leaves`` (key, i, digest), and the names of their runs."""
    ctes = [f"{name}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM ({leaves}))"]
    runs = []
    for level in range(_LEVELS):
        ctes.append(
            f"{name}r{level} AS MATERIALIZED (SELECT {key}, i // {FANOUT} AS i, any_value(n) AS n, "
            f"list(digest ORDER BY i) AS run FROM {name}{level} GROUP BY {key}, i // {FANOUT})"
        )
        ctes.append(
            f"{name}{level + 1} AS MATERIALIZED (SELECT {key}, i, (n + {FANOUT - 1}) // {FANOUT} AS n, "
            f"CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM {name}r{level})"
        )
        runs.append(f"{name}r{level}")
    return ctes, runs


def _fold(runs: list[str], rows: str, key: str, name: str) -> list[str]:
    """Relations that add each level's siblings to ``rows`` and fold ``changed`` with them."""
    out = []
    for level, run in enumerate(runs):
        at = f"((rows.i // {FANOUT**level}) % {FANOUT})"
        left, right = f"array_to_string(run[1 : {at}], '')", f"array_to_string(run[{at} + 2 :], '')"
        out.append(
            f"{name}{level} AS MATERIALIZED (SELECT rows.* REPLACE ("
            f"siblings || CASE WHEN n > 1 THEN {left} || {right} ELSE '' END AS siblings, "
            f"CASE WHEN n > 1 THEN sha256({left} || changed || {right}) ELSE changed END AS changed) "
            f"FROM {rows} AS rows JOIN {run} ON rows.{key} IS NOT DISTINCT FROM {run}.{key} "
            f"AND rows.i // {FANOUT ** (level + 1)} = {run}.i)"
        )
        rows = f"{name}{level}"
    return out


def manifest() -> str:
    """Levels one by one; every row meets its runs level by level."""

    def leaf(text: str) -> str:
        fields = [text if c == "text" else c for c in COLUMNS]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    capitals = "".join(map(chr, range(65, 91)))
    lowered = f"translate(text, '{capitals}', '{capitals.lower()}')"
    lower, lower_runs = _climb("a", "SELECT lang, i, digest FROM docs", "lang")
    upper, upper_runs = _climb(
        "b", "SELECT 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, digest, lang "
        f"FROM a{_LEVELS}", "one"
    )
    docs = f"""docs AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS i,
               CASE WHEN {crc32('doc_id::VARCHAR')} % {TAMPERED} = 0 THEN {leaf(lowered)} ELSE digest END AS changed,
               '' AS siblings
        FROM (SELECT *, {leaf('text')} AS digest FROM documents))"""
    first = _fold(lower_runs, "docs", "lang", "f")
    moved = f"""moved AS MATERIALIZED (
        SELECT d.doc_id, d.digest AS leaf, b0.digest AS subroot, d.siblings, d.changed, b0.i AS i, 0 AS one
        FROM f{_LEVELS - 1} AS d JOIN b0 ON d.lang IS NOT DISTINCT FROM b0.lang)"""
    second = _fold(upper_runs, "moved", "one", "g")
    return f"""
    WITH {', '.join([docs, *lower, *upper, *first, moved, *second])}
    SELECT doc_id, leaf, subroot, b.digest AS root, sha256(siblings) AS proof_sha256, changed AS folded_root,
           changed = b.digest AS verified
    FROM g{_LEVELS - 1} CROSS JOIN b{_LEVELS} AS b"""
