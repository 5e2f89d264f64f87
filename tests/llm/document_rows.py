"""Rows for the operator tests; fixtures are in conftest.py."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("an", "be", "Cor", "du", "élan", "fi,", "go.") for b in ("", "ra", "ti", "sou")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "x", "yz", "q"]) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, copies, repeated rows, personal data."""
    shared = prose(1, 60)
    texts = [
        prose(2, 300),
        prose(2, 300),
        prose(3, 80) + " " + shared + " " + prose(4, 80),
        shared + "\n" + prose(5, 40),
        prose(6, 30) + "\t" + shared,
        "",
        " \t\n ",
        None,
        "one",
        "Two words",
        prose(7, 6000),
        prose(8, 120) + " a.b@c-d.org x@y _@z.w.v 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 ",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111111 tel +1 (017) 555-7713 "
        "+12 345 (+49 30 1234567 ) mail é@x.com é.a@b.c_d@e.f",
        "bank account DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432; ssn 123-45-6789, 987-65-4321",
        "a " * 400,
        "line one\nline one\n\n \nline two\n" + prose(9, 30),
        "#*$%&|<> 123 456 !!!",
    ]
    out = [
        (i, t, ["en", "de", None][i % 3], [None, "a", "b", "é"][i % 4], len(t or ""))
        for i, t in enumerate(texts)
    ]
    edited = prose(2, 300).split()
    for i in range(6):
        edited[10 * i] = f"edit{i}"
        out.append((100 + i, " ".join(edited), "en", "a", None))
    out.append(out[2])
    out.append((3, prose(10, 70) + " " + shared, "en", "b", 1))
    out.append((None, shared, "en", "a", 0))
    return out


CLASHING = (
    "th fp root size key place part source_no source_size target taken rn offset sequence_id "
    "start end length piece rank score pii_spans kept w m a b held_out __id __key __th"
).split()
