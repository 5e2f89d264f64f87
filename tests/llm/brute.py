"""The contracts of the operators, by definition."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = r"[^\x20\x09-\x0D]+"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return re.findall(WORD, text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    def valid(kind, match):
        digits = re.sub("[^0-9]", "", match)
        return {
            "email": lambda: True,
            "ip": lambda: all(int(x) <= 255 for x in match.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 8 <= len(digits) <= 15,
        }[kind]()

    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]


def fingerprint(text, shingle=3):
    found = words(lowered(text))
    parts = [" ".join(found[i : i + shingle]) for i in range(len(found) - shingle + 1)]
    parts = parts or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=2):
    """Group number of each fingerprint."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Target of each source, by resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = {}
    while True:
        left = [s for s in names if s not in full]
        level = (share * sum(sizes.values()) - sum(full.values())) / max(1, sum(weight[s] for s in left))
        over = [s for s in left if weight[s] * level > limit * sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in left}
        full |= {s: float(limit * sizes[s]) for s in over}


def quality(text):
    found = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 5))
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered), failed


_tokenizer = None


def ids(text, end):
    global _tokenizer
    _tokenizer = _tokenizer or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*_tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def fold(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def repeats(rows, length=50):
    """doc_id, words, removed words and digest of what is left, per row."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, words in split:
        for i in range(len(words) - length + 1) if d is not None else ():
            key = tuple(words[i : i + length])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - length + 1) if d is not None else ():
            if first[tuple(words[i : i + length])] < d:
                gone.update(range(i, i + length))
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return out
