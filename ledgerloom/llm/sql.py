"""DuckDB statements for the operators that SQL can express, by other routes."""

from __future__ import annotations

from ledgerloom.llm import sql_trees
from ledgerloom.llm.mixing import BLOCK, LIMIT, SEED, SHARE, WEIGHTS
from ledgerloom.llm.pii import _IBAN_LENGTHS, CONTEXT_CHARS, THRESHOLD
from ledgerloom.llm.substrings import LENGTH

_WORD = r"[^\x20\x09-\x0D]+"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"

# Digits from the right; every second one doubled, and 9 less if that is over 9.
_LUHN = """list_reduce(list_transform(string_split(reverse(digits), ''), lambda c, i:
    CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT < 5 THEN 2 * c::INT ELSE 2 * c::INT - 9 END),
    lambda a, b: a + b, 0) % 10 = 0"""
_MOD_97 = """list_reduce(list_transform(
    regexp_extract_all(substr(replace(value, ' ', ''), 5) || substr(replace(value, ' ', ''), 1, 4), '.'),
    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END),
    lambda a, b: (a * CASE WHEN b < 10 THEN 10 ELSE 100 END + b) % 97, 0) = 1"""

# A country and two digits after something else; the longest form that its country's
# length allows and that nothing follows is then read from there.
_HEAD = "[^A-Za-z0-9][A-Z]{2}[0-9]{2}"


def _number() -> str:
    """The account number at a head: the first form that ends before something else."""
    forms = []
    for length, countries in _IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"({countries.replace(' ', '|')})[0-9]{{2}}( ?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    forms.append("[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?")
    found = ", ".join(f"nullif(regexp_extract(ahead, '\\A({f})[^A-Za-z0-9]', 1), '')" for f in forms)
    return f"coalesce({found}, '')"


# name, pattern, condition, prior score with checksum, context words, base kind
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.7,
     "mail|contact|write|address", True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     rf"regexp_full_match(value, '{_OCTET}(\.{_OCTET}){{3}}')", 0.6,
     "host|server|address|login|client", True),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length(digits) BETWEEN 16 AND 19 AND {_LUHN}", 0.9,
     "card|visa|credit|payment|account", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15", 0.6,
     "phone|call|tel|mobile|fax", True),
    ("iban", _HEAD, f"value <> '' AND {_MOD_97}", 0.8, "iban|bank|account|transfer", False),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
     r"NOT regexp_matches(left_text, '[0-9-]\z') AND NOT regexp_matches(right_text, '\A[0-9-]') "
     "AND left(value, 3) NOT IN ('000', '666') AND left(value, 3) < '900' "
     "AND substr(value, 5, 2) <> '00' AND substr(value, 8) <> '0000'",
     0.4, "ssn|social|security|insurance", False),
)


def _pii() -> str:
    parts = []
    for number, (name, pattern, valid, prior, context, base) in enumerate(_KINDS):
        near = (
            f"regexp_matches(lower(right(' ' || left_text, {CONTEXT_CHARS + 1}) || ' ' || "
            f"left(right_text || ' ', {CONTEXT_CHARS + 1})), '[^a-z]({context})[^a-z]')"
        )
        score = f"least({prior} + CASE WHEN {near} THEN 0.3 ELSE 0 END, 1.0)"
        # A head is found with what precedes it, in a text with one character more in front.
        headed = pattern == _HEAD
        text = "' ' || t" if headed else "t"
        value, after, left = (
            (_number(), "substr(right_text, length(value) - 3)", "left_text || left(head, 1)")
            if headed
            else ("head", "right_text", "left_text")
        )
        parts.append(
            f"""SELECT row, {number} AS kind_no, '{name}' AS kind, start, start + length(value) AS stop, {score} AS score
            FROM (SELECT row, start, value, {left} AS left_text, {after} AS right_text,
                         regexp_replace(value, '[^0-9]', '', 'g') AS digits
              FROM (SELECT *, {value} AS value
                FROM (SELECT *, substr(t, start::BIGINT + 1, 64) || ' ' AS ahead
                  FROM (SELECT row, t, head, left_text, right_text,
                      before + coalesce(sum(length(head)) OVER (PARTITION BY row ORDER BY i
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                    FROM (SELECT row, t, i, m[i] AS head, s[i] AS left_text, s[i + 1] AS right_text,
                              sum(length(s[i])) OVER (PARTITION BY row ORDER BY i) AS before
                          FROM (SELECT row, t, unnest(generate_series(1, len(m))) AS i, m, s
                                FROM (SELECT row, t, regexp_extract_all({text}, '{pattern}') AS m,
                                             string_split_regex({text}, '{pattern}') AS s FROM docs)))))))
            WHERE ({valid}) AND ({'true' if base else f"{score} >= {THRESHOLD}"})"""
        )
    base = [k[0] for k in _KINDS if k[5]]
    counts = ", ".join(
        f"count(*) FILTER (kind = '{k[0]}')::BIGINT AS n_{k[0]}" for k in _KINDS
    )
    listed = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY kind_no, start)"
    return f"""
    WITH docs AS MATERIALIZED (
        SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
    spans AS ({' UNION ALL '.join(parts)})
    SELECT doc_id, {counts},
        sha256(coalesce({listed} FILTER (kind IN ({', '.join(f"'{b}'" for b in base)})), '')) AS base_sha256,
        coalesce({listed} FILTER (kind IS NOT NULL), '') AS spans,
        coalesce(string_agg(printf('%.1f', score::DOUBLE), ',' ORDER BY kind_no, start)
                 FILTER (kind IS NOT NULL), '') AS scores
    FROM docs LEFT JOIN spans USING (row) GROUP BY row, doc_id"""


_SUBSTRINGS = rf"""
    WITH docs AS MATERIALIZED (
        SELECT row_number() OVER () AS row, doc_id,
               regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
    windows AS MATERIALIZED (
        SELECT row, doc_id, i, array_to_string(words[i : i + {LENGTH - 1}], ' ') AS w
        FROM (SELECT row, doc_id, words, unnest(generate_series(1, len(words) - {LENGTH - 1})) AS i FROM docs)),
    firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
    hits AS (SELECT row, i FROM windows JOIN firsts USING (w) WHERE doc_id > first),
    gone AS (SELECT DISTINCT row, unnest(generate_series(i, i + {LENGTH - 1})) AS i FROM hits),
    words AS (SELECT row, unnest(generate_series(1, len(words))) AS i, unnest(words) AS word FROM docs),
    kept AS (
        SELECT row, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
        FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (row)"""


def _mixing() -> str:
    """Targets by resharing until none is above; taken by prefixes of the shuffled streams."""
    weight = f"[{', '.join(map(str, WEIGHTS))}][(n - 1) % {len(WEIGHTS)} + 1]"
    return rf"""
    WITH RECURSIVE docs AS MATERIALIZED (
        SELECT row_number() OVER () AS row, doc_id, source,
               len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
               md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place
        FROM documents),
    sources AS MATERIALIZED (
        SELECT source, source_size, {weight} AS weight, {LIMIT} * source_size AS bound,
               sum(source_size) OVER () * {SHARE}::DOUBLE AS wanted, sum(weight) OVER () AS weights
        FROM (SELECT source, sum(size)::BIGINT AS source_size,
                     row_number() OVER (ORDER BY source NULLS LAST) AS n FROM docs GROUP BY source)),
    shares(round, level) AS (
        SELECT 0, max(wanted / weights) FROM sources
        UNION ALL
        SELECT round + 1,
               (SELECT (max(wanted) - sum(CASE WHEN bound <= weight * level THEN bound ELSE 0 END))
                       / nullif(sum(CASE WHEN bound <= weight * level THEN 0 ELSE weight END), 0)
                FROM sources)
        FROM shares WHERE round < (SELECT count(*) FROM sources)),
    targets AS (
        SELECT source, source_size,
               CASE WHEN bound <= weight * level THEN bound::DOUBLE ELSE weight * level END AS target
        FROM sources, (SELECT level FROM shares WHERE level IS NOT NULL ORDER BY round DESC LIMIT 1)),
    placed AS (
        SELECT row, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, row) - size AS start FROM docs)
    SELECT doc_id, size, source_size, target,
           (SELECT sum(greatest(0, least(start + e * source_size + size, round(target)::BIGINT)
                                   - (start + e * source_size)))
            FROM range({LIMIT}) AS r(e))::BIGINT AS taken
    FROM docs JOIN placed USING (row) JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source"""


def statements() -> dict[str, str]:
    assert BLOCK > 0  # any size of blocks takes the same words
    return {
        "op1_pii": _pii(),
        "op2_substring_dedup": _SUBSTRINGS,
        "op4_mixing": _mixing(),
        "op12_conversation_trie": sql_trees.trie(),
        "op13_merkle": sql_trees.manifest(),
    }
