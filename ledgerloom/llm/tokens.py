"""Token ids of whole texts, with each distinct word encoded once per process."""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, repeat

import numpy as np

from ledgerloom.llm.common import caches

# Tokenizers file that drops white space: words never share a token, so ids of a text
# are the ids of its words one after another.
VOCABULARY = "word_bpe_49k.json"

# Letters of which each has one lower-case letter, then closing marks: the letters are
# one piece of the tokenizer and the marks another.
_ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordEncoder:
    """Ids by a tokenizers file whose tokens never contain or cross white space.

    Words are remembered up to ``limit`` of them; then all but the most used ones are
    forgotten, so memory stays bounded. That changes the time, never the ids.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.tokenize = self.tokenizer.model.tokenize
        self.limit = limit
        # The model sees bytes as letters; the tokenizer itself says which.
        before = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(c): before(c)[0][0] for c in _ACCENTED}
        self._forget()

    def _forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.uses = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _keep_common(self) -> None:
        """Forgets all but the words used most, half of the limit at most."""
        words, n = list(self.words), len(self.words)
        least = max(2, int(np.partition(self.uses[:n], -(self.limit // 2))[-(self.limit // 2)]) + 1)
        kept = np.flatnonzero(self.uses[:n] >= least)
        lengths, starts, uses = self.lengths[kept], self.starts[kept], self.uses[kept]
        ends = np.cumsum(lengths)
        at = np.arange(lengths.sum()) + np.repeat(starts - (ends - lengths), lengths)
        flat = self.flat[at]
        self._forget()
        self.words = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.starts, self.lengths, self.uses = ends - lengths, lengths, uses
        self.flat, self.used = flat, len(flat)

    def _encode_others(self, words: list[str]) -> None:
        """Words that are not plain, by the whole tokenizer, each by itself."""
        fresh = list(dict.fromkeys(w for w in words if w not in self.pieces))
        if fresh:
            # The library encodes a list of words one by one.
            encoding = self.tokenizer.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in fresh]
            for i, of in zip(encoding.ids, encoding.word_ids, strict=True):
                ids[of].append(i)
            self.pieces.update(zip(fresh, map(_as_bytes, ids), strict=True))

    def _encode_plain(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.translate(self.letters)
        ids = self.pieces[piece] = _as_bytes([t.id for t in self.tokenize(letters)])
        return ids

    def _learn(self, words: list[bytes]) -> None:
        pieces, encode = self.pieces, self._encode_plain
        texts = b" ".join(words).decode().split(" ")
        matches = list(map(_PLAIN.fullmatch, texts))
        self._encode_others([t for t, m in zip(texts, matches, strict=True) if not m])
        parts: list[bytes] = []
        for text, match in zip(texts, matches, strict=True):
            if match:
                stem, marks = match.groups()
                stem = stem.lower()
                ids = pieces.get(stem) or encode(stem)
                if marks:
                    ids += pieces.get(marks) or encode(marks)
            else:
                ids = pieces[text]
            parts.append(ids)
        ids = np.frombuffer(b"".join(parts), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first, last = len(self.words), len(self.words) + len(words)
        needs = {"starts": last, "lengths": last, "uses": last, "flat": self.used + len(ids)}
        for name, need in needs.items():
            old = getattr(self, name)
            if need > len(old):
                more = max(need - len(old), len(old) // 2)
                setattr(self, name, np.concatenate((old, np.zeros(more, old.dtype))))
        self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:last] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.words.update(zip(words, range(first, last), strict=True))

    def encode(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``; and where each text starts."""
        if len(self.words) > self.limit:
            self._keep_common()
        lists = [(t or b"").split() for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        words = list(chain.from_iterable(lists))
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            at[new] = np.fromiter(map(self.words.__getitem__, missing), np.int64, len(new))
        self.uses[: len(self.words)] += np.bincount(at, minlength=len(self.words))
        sizes = self.lengths[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], sizes)]
        ends = np.cumsum(counts)
        bounds = np.zeros(len(texts) + 1, np.int64)
        bounds[1:] = total[ends] + np.arange(1, len(texts) + 1)
        out = np.empty(bounds[-1], np.uint32)
        stop = np.zeros(len(out), bool)
        stop[bounds[1:] - 1] = True
        out[stop], out[~stop] = end, ids
        return out, bounds


def _as_bytes(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers; unlike lists, bytes do not burden the garbage collector."""
    return array("I", ids).tobytes()


_encoders: dict[str, WordEncoder] = {}
caches["tokens"] = _encoders.clear


def encoder(path: str, limit: int = 600_000) -> WordEncoder:
    """One per process and file; it remembers up to ``limit`` words from now on."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].limit = limit
    return _encoders[path]
