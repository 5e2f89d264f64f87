"""Personal data: patterns propose spans, checksums confirm, context adjusts the score.

Everything is built-in DataFrame functions over one row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
# Elements of one fold that builds an array, and code points of one block of a text: a
# fold copies its array at every step, and positions in a text are counted from its start.
FOLD, BLOCK = 512, 256


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``gate`` is a cheap condition without which the pattern cannot match. ``accept``
    gets a match and the text before and after it up to the next match, and says
    whether the match is valid. ``required`` kinds stay whatever their score;
    others need ``score >= THRESHOLD``, where the score is ``prior``, plus 0.4 if
    ``checked`` (a checksum confirmed it), plus 0.3 if a context word is near.
    If ``head`` is set, the pattern takes only so many characters and the match is its
    first group, looked ahead: matches that fail do not hide others that start in them.
    """

    name: str
    pattern: str
    gate: str
    accept: Callable[[Column, Column, Column], Column]
    prior: float
    checked: bool
    context: str
    required: bool = True
    head: int = 0


THRESHOLD = 0.6
_ADDRESS = "A-Za-z0-9._%+-"
_LABEL = "A-Za-z0-9-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod_97(match: Column) -> Column:
    """Remainder of an account number: four characters moved to the end, A is 10."""
    code = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    step = lambda rest, c: F.when(
        F.ascii(c) < 58, (rest * 10 + F.ascii(c) - 48) % 97
    ).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step)


def _apart(before: Column, after: Column, inside: str) -> Column:
    """Neither neighbour of a match is in the class ``inside``."""
    return ~before.rlike(f"[{inside}]$") & ~after.rlike(f"^[{inside}]")


def _whole_ssn(match: Column, before: Column, after: Column) -> Column:
    area = F.substr(match, F.lit(1), F.lit(3))
    return (
        _apart(before, after, "0-9-")
        & ~area.isin("000", "666")
        & (area < "900")
        & (F.substr(match, F.lit(5), F.lit(2)) != "00")
        & (F.substr(match, F.lit(8)) != "0000")
    )


# Account numbers by length, of the registry of ISO 13616.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Numbers of the length of their country, whatever follows; else of any length."""
    forms = []
    for length, countries in _IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(
            f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}"
        )
    forms.append("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
    return rf"(?<![A-Za-z0-9])(?=((?:{'|'.join(forms)})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"


# The patterns match what the plain forms in the comments match. Starts are anchored
# where a longer match would begin, and repetitions do not backtrack, so that time
# stays linear in texts that are one long run of such characters.
KINDS = (
    Kind(
        "email",
        # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
        rf"(?:\G|(?<![{_ADDRESS}]))[{_ADDRESS}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
        "@",
        lambda m, b, a: F.lit(True),
        0.7,
        False,
        "mail|contact|write|address",
    ),
    Kind(
        "ip",
        # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        r"[0-9]\.[0-9]",
        lambda m, b, a: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        0.6,
        False,
        "host|server|address|login|client",
    ),
    Kind(
        "card",
        # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits: whole runs of that many only
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        r"[0-9][\x20-]?[0-9]",
        lambda m, b, a: F.call_function("luhn_check", _digits(m)),
        0.5,
        True,
        "card|visa|credit|payment|account",
    ),
    Kind(
        "phone",
        # \+[0-9][\x20().0-9-]+[0-9], 8 to 15 digits
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        lambda m, b, a: F.length(_digits(m)).between(8, 15),
        0.6,
        False,
        "phone|call|tel|mobile|fax",
    ),
    Kind(
        "iban",
        _iban(),
        "[A-Z]{2}[0-9]{2}",
        lambda m, b, a: _mod_97(m) == 1,
        0.4,
        True,
        "iban|bank|account|transfer",
        required=False,
        head=4,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "[0-9]-[0-9]{2}-[0-9]",
        _whole_ssn,
        0.4,
        False,
        "ssn|social|security|insurance",
        required=False,
    ),
)
BASE = tuple(k.name for k in KINDS if k.required)


def _blocks(array: Column) -> Column:
    """The array as an array of arrays of ``FOLD`` elements."""
    last = F.expr("int(-1)") + F.ceil(F.size(array) / FOLD).cast("int")
    numbers = F.when(F.size(array) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda b: F.slice(array, b * FOLD + 1, FOLD))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(steps: Column) -> Column:
    """What lies before each element: the sums of the steps before it, in linear time."""
    empty = F.array().cast("array<int>")

    def summed(values: Column, start: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(start.alias("at"), empty.alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    def by_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x))
        starts = summed(totals, F.lit(0))
        return F.flatten(F.zip_with(starts, blocks, lambda start, block: summed(block, start)))

    return _bound(steps, lambda s: _bound(_blocks(s), by_blocks))


def _spans(kind: Kind, pieces: Column, matches: Column) -> Column:
    """Valid spans of one kind from the pieces between matches and the matches.

    Positions are code points from 0, ends exclusive.
    """
    took = (lambda m: F.lit(kind.head)) if kind.head else F.length
    steps = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + took(m)
    )

    def span(befores: Column) -> Callable[[Column, Column], Column]:
        def at(match: Column, i: Column) -> Column:
            left, right = F.get(pieces, i), F.get(pieces, i + 1)
            start = F.get(befores, i) + F.length(left)
            if kind.head:
                right = F.substr(right, F.length(match) - kind.head + 1)
            valid = kind.accept(match, left, right)
            # Words with something before and after them, so that hotel is no tel.
            near = F.lower(
                F.concat(
                    F.right(F.concat(F.lit(" "), left), F.lit(CONTEXT_CHARS + 1)),
                    F.lit(" "),
                    F.left(F.concat(right, F.lit(" ")), F.lit(CONTEXT_CHARS + 1)),
                )
            )
            context = near.rlike(f"[^a-z](?:{kind.context})[^a-z]")
            score = F.lit(kind.prior + 0.4 * kind.checked) + F.when(context, 0.3).otherwise(0.0)
            return F.struct(
                F.lit(kind.name).alias("kind"),
                start.alias("start"),
                (start + F.length(match)).alias("end"),
                match.alias("value"),
                F.least(score, F.lit(1.0)).alias("score"),
                valid.alias("valid"),
            )

        return at

    found = _bound(_running(steps), lambda befores: F.transform(matches, span(befores)))
    return F.filter(
        found,
        lambda s: s["valid"] & (F.lit(kind.required) | (s["score"] >= THRESHOLD)),
    )


def find(documents: DataFrame) -> DataFrame:
    """``documents`` plus ``pii_spans``, an array of (kind, start, end, value, score, valid).

    Sorted by kind in the order of ``KINDS``, then by start. A null text counts as
    empty. Rows stay as they are: repeated rows, null ids and columns of any name are
    kept, except that a column ``pii_spans`` is replaced. Spans of different kinds may
    overlap, and account numbers that start in one another.
    """
    text = F.col("text")
    empty = F.array().cast("array<string>")
    found, pieces, spans = {}, {}, {}
    for kind in KINDS:
        k = f"__{kind.name}"
        pattern = F.lit(kind.pattern)
        possible = text.rlike(kind.gate)
        matches = F.regexp_extract_all(text, pattern, F.lit(1 if kind.head else 0))
        found[f"{k}_m"] = F.when(possible, matches).otherwise(empty)
        pieces[f"{k}_s"] = F.when(
            F.size(f"{k}_m") > 0, F.split("text", kind.pattern, -1)
        ).otherwise(empty)
        spans[kind.name] = _spans(kind, F.col(f"{k}_s"), F.col(f"{k}_m"))
    # A row is one value, so no column of its own can be mistaken for one of these.
    kept = [c for c in documents.columns if c != "pii_spans"]
    rows = documents.select(F.struct(*map(_quoted, kept)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.withColumns(found).withColumns(pieces)
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in kept], F.concat(*spans.values()).alias("pii_spans")
    )


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def spans(documents: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start, end, value, score."""
    rows = find(documents).select("doc_id", F.explode("pii_spans").alias("s"))
    return rows.select("doc_id", "s.kind", "s.start", "s.end", "s.value", "s.score")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by its kind in angle brackets.

    Spans that overlap are replaced together, by the kind that starts first. Columns
    and rows stay; ``n_chars``, if there, is counted anew for changed texts; a null
    text stays null.
    """
    ordered = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    )
    none = F.array().cast("array<struct<from: int, to: int, kind: string>>")

    def step(a: Column, s: Column) -> Column:
        part = F.struct(a["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        overlaps = s["start"] < a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(overlaps, a["out"]).otherwise(F.concat(a["out"], F.array(part))).alias("out"),
        )

    def merged(a: Column, block: Column) -> Column:
        within = F.aggregate(block, F.struct(a["at"].alias("at"), none.alias("out")), step)
        return F.struct(
            within["at"].alias("at"), F.concat(a["out"], F.array(within["out"])).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<from: int, to: int, kind: string>>>").alias("out"))
    parts = F.aggregate(_blocks(F.col("ordered")), start, merged)

    def replaced(blocks: Column) -> Callable[[Column], Column]:
        def of(plan: Column) -> Column:
            texts = F.transform(
                F.flatten(plan["out"]),
                lambda p: F.concat(_cut(blocks, p["from"], p["to"]), F.lit("<"), p["kind"], F.lit(">")),
            )
            tail = _cut(blocks, plan["at"], F.size(blocks) * BLOCK)
            return F.concat(F.array_join(texts, ""), tail)

        return of

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    done = _bound(blocks, lambda b: _bound(parts, replaced(b)))
    found = find(documents.select(F.struct("*").alias("row"), "text"))
    out = (
        found.select("row", "text", F.col("pii_spans").alias("spans"))
        .withColumn("ordered", ordered)
        .withColumn("redacted", F.when(F.size("spans") > 0, done).otherwise(F.col("text")))
    )
    changed = {"text": F.col("redacted")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(
            F.col("row.n_chars")
        )
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text that is cut into blocks."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.greatest(F.ceil(end / BLOCK).cast("int") - first, F.lit(0))
    near = F.array_join(F.slice(blocks, first + 1, count), "")
    return F.substr(near, start - first * BLOCK + 1, end - start)


def listed(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(
        ",",
        F.transform(
            array,
            lambda s: F.concat(
                s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")
            ),
        ),
    )


def digest(documents: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and list of all spans, one row per document."""
    found = find(documents).select("doc_id", "pii_spans")
    count = lambda name: F.size(F.filter("pii_spans", lambda s: s["kind"] == name)).cast("long")
    base = F.filter(
        "pii_spans", lambda s: reduce(lambda a, b: a | b, [s["kind"] == name for name in BASE])
    )
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )
