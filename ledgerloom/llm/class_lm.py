"""Class-based bigram language model with exchange clustering, and its scores of texts.

p(word | before) = p(class | class before) * p(word | class). Classes come from the
likelihood of all class bigrams, in two steps. The ``core_words`` most frequent words are
exchanged one by one: each goes to the class that raises the likelihood most, on tables
that every move brings up to date, so the likelihood never falls and no class runs
empty. Then every other known word that occurs ``min_count`` times goes to the class
that its neighbours' classes make likeliest, unless its shape's class is; that step is
kept only if the likelihood of all class bigrams, counted anew, has risen. Rarer words
belong to the class of their shape (digits, marks, letters, length), so any text has a
class sequence, and unseen words have a share of their shape's probability. The end of a
text is a class and a word of its own; a text starts after an end.

Counts are over all words of all learning documents. Texts are read twice: to count
words, and to write every text as a sequence of word numbers, on which all later steps
work. Words are 64-bit hashes; counts of words are a distributed table. The
``known_words`` most frequent words (a fixed bound, some 10 MB) have numbers; others keep
their shape's class and meet their counts by a shuffle. The driver sees bigrams of core
words (at most 537 x 537 counts), of classes, and the class of each known word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bytes_in_parts, importable, stored, text_key

CORE_WORDS, KNOWN_WORDS, MIN_COUNT = 512, 1 << 19, 3
CLASSES, ROUNDS = 48, 12
FOLDS, HELD_OUT = 7, 2
# Added to counts of words in a class, and weight of class frequencies in transitions.
WORD_PRIOR, CLASS_PRIOR = 0.5, 16.0
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_END = xxhash.xxh3_64_intdigest(b"")
SHAPES = 24
_PORTION = 2 << 20
_MARKS = b".,;:!?"


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a document is kept out of learning; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def shape(word: bytes) -> int:
    """What a word looks like: its kind, closing mark and length; below ``SHAPES``."""
    stem = word.rstrip(_MARKS)
    if not stem:
        return 0
    if not stem.isalnum() and not all(c > 127 or 97 <= c <= 122 for c in stem):
        return 1 if any(48 <= c <= 57 for c in stem) else 2
    if any(48 <= c <= 57 for c in stem):
        return 3
    size = min(9, len(stem) // 2)
    return 4 + size + 10 * (stem != word)


class _Words:
    """Numbers words as they come; remembers their hash and shape up to a limit."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.shapes = [_END], [-1]

        class Index(dict):
            def __missing__(index, word: bytes) -> int:  # noqa: N805
                number = index[word] = len(index)
                self.hashes.append(xxhash.xxh3_64_intdigest(word))
                self.shapes.append(shape(word))
                return number

        self.index = Index({b"": 0})

    def read(self, texts: list[bytes | None]):
        """Numbers of all words, each text closed by 0; and where each text ends."""
        if len(self.index) > self.LIMIT:
            self._forget()
        lists = [(t or b"").translate(_LOWER).split() for t in texts]
        for words in lists:
            words.append(b"")
        total = sum(map(len, lists))
        numbers = np.fromiter(
            map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, total
        )
        return numbers, np.cumsum([len(x) for x in lists])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.hashes, np.uint64).view(np.int64), np.array(self.shapes, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of learning documents: w (hash), shape, c; partial sums."""

    def sums(words: _Words, seen: np.ndarray) -> pa.RecordBatch:
        hashes, shapes = words.tables()
        at = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes[at]), pa.array(shapes[at], pa.int32()), pa.array(seen[at])],
            names=["w", "shape", "c"],
        )

    words, seen = _Words(), np.zeros(0, np.int64)
    for batch in batches:
        for texts in bytes_in_parts(batch.column("text"), _PORTION):
            if len(words.index) > words.LIMIT:
                yield sums(words, seen)
                words, seen = _Words(), np.zeros(0, np.int64)
            numbers = words.read(texts)[0]
            fresh = np.bincount(numbers, minlength=len(words.index))
            fresh[: len(seen)] += seen
            seen = fresh
    if seen.any():
        yield sums(words, seen)


def count_words(learning: DataFrame) -> DataFrame:
    """w, shape (-1: end of text) and c of every word."""
    parts = learning.select("text").mapInArrow(_count, "w long, shape int, c long")
    return parts.groupBy("w", "shape").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent words, or some fewer of those that share the last count.

    Found by counting words per level (an eighth of a power of two), then per count in
    the level that does not fit; of the words with the last count, those with the
    smallest hashes. Nothing is sorted, and the tables of levels and counts are small.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    total = 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        if total + row["n"] > most:
            break
        total += row["n"]
    else:
        return counts
    inside = counts.where(level == row["level"]).groupBy("c").agg(F.count("*").alias("n")).collect()
    for last in sorted(inside, key=lambda r: -r["c"]):
        if total + last["n"] > most:
            break
        total += last["n"]
    room = max(0.0, most - total - 4 * (most - total) ** 0.5)
    highest = int(-(2.0**63) + 2.0**64 * room / last["n"])
    return counts.where((F.col("c") > last["c"]) | (F.col("c") == last["c"]) & (F.col("w") < F.lit(highest)))


def _arrays(rows: DataFrame) -> dict[str, np.ndarray]:
    table = rows.toArrow().combine_chunks()
    found = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.argsort(found["w"], kind="stable")
    return {c: v[order] for c, v in found.items()}


def _find(sorted_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word, -1 if it is not there."""
    if not len(sorted_words):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return np.where(sorted_words[at] == words, at, -1)


_SEQUENCE = "doc_id long, th long, held_out boolean, seq binary, w long, k long"
_SEQUENCE_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("th", pa.int64()), ("held_out", pa.bool_()), ("seq", pa.binary()),
     ("w", pa.int64()), ("k", pa.int64())]
)
# Numbers of words that are not known: -1 - shape; the end of a text follows the shapes.
_END_NUMBER = -1 - SHAPES


def sequences(documents: DataFrame, known: np.ndarray) -> DataFrame:
    """Every text as numbers of its words (``seq``, 32 bits each, without its end), and a
    row for each other word in it (w, and how often: k; seq null)."""
    shipped = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, listed = _Words(), shipped.value
        for batch in batches:
            done = 0
            for texts in bytes_in_parts(batch.column("text"), _PORTION):
                n = len(texts)
                numbers, ends = words.read(texts)
                hashes, shapes = words.tables()
                at = _find(listed, hashes)
                codes = np.where(at >= 0, at, -1 - shapes).astype("<i4")
                codes[0] = _END_NUMBER
                sizes = np.diff(ends, prepend=0)
                row = np.repeat(np.arange(n), sizes)
                inner = np.ones(len(numbers), bool)
                inner[ends - 1] = False
                data = codes[numbers[inner]].tobytes()
                cuts = np.concatenate(([0], np.cumsum(sizes - 1))) * 4
                seqs = [data[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                other = np.flatnonzero(inner & (at[numbers] < 0))
                pair, times = np.unique(row[other] * np.int64(len(hashes)) + numbers[other], return_counts=True)
                at_row, number = np.divmod(pair, len(hashes))
                for rows, values in (
                    (np.arange(n), [pa.array(seqs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]),
                    (at_row, [pa.nulls(len(pair), pa.binary()), pa.array(hashes[number]), pa.array(times, pa.int64())]),
                ):
                    take = pa.array(rows + done)
                    columns = [batch.column(c).take(take) for c in ("doc_id", "th", "held_out")]
                    yield pa.RecordBatch.from_arrays([*columns, *values], schema=_SEQUENCE_ARROW)
                done += n

    docs = documents.select("doc_id", text_key().alias("th"), held_out().alias("held_out"), "text")
    return docs.mapInArrow(run, _SEQUENCE)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts of a batch, each text closed by its end; where each ends."""
    seqs = column.to_pylist()
    ends = np.cumsum([len(x) // 4 + 1 for x in seqs])
    out = np.empty(ends[-1] if len(ends) else 0, np.int32)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[ends - 1] = _END_NUMBER
    out[inner] = np.frombuffer(b"".join(seqs), "<i4")
    return out, ends


def _lookup(known: np.ndarray, unknown: np.ndarray, end) -> np.ndarray:
    """Values by word number: of known words, of shapes and of the end, found from behind."""
    return np.concatenate((known, [end], unknown[::-1]))


def _before(values: np.ndarray) -> np.ndarray:
    """What stands before each: a text starts after an end, and so does the next one."""
    return np.concatenate((values[-1:], values[:-1]))


def count_pairs(learning: DataFrame, lookup: np.ndarray, kinds: int) -> np.ndarray:
    """How often kind a stands before kind b, for few kinds: ``kinds`` squared sums a task."""
    shipped = learning.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = shipped.value, np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            kind = of[_numbers(batch.column("seq"))[0]].astype(np.int64)
            if len(kind):
                sums += np.bincount(_before(kind) * kinds + kind, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["code", "n"])

    parts = learning.select("seq").mapInArrow(run, "code int, n long")
    found = parts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(kinds * kinds)
    table[found["code"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(kinds, kinds)


def contexts(learning: DataFrame, lookup: np.ndarray, wanted: np.ndarray, kinds: int) -> DataFrame:
    """Classes next to each wanted word: word (number), code (class, after ones shifted), n."""
    spark = learning.sparkSession
    shipped = spark.sparkContext.broadcast((lookup, np.concatenate((wanted, np.zeros(SHAPES + 1, bool)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, asked = shipped.value
        codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            word, code = np.divmod(codes, 2 * kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(word, pa.int32()), pa.array(code, pa.int32()), pa.array(sums)], ["word", "code", "n"]
            )

        for batch in batches:
            numbers, _ = _numbers(batch.column("seq"))
            if not len(numbers):
                continue
            kind = of[numbers].astype(np.int64)
            at = np.flatnonzero(asked[numbers])
            left = numbers[at].astype(np.int64) * 2 * kinds
            after = np.concatenate((kind[1:], kind[:1]))  # a text ends, so its last word is an end
            codes, sums = _merged(codes, sums, [left + _before(kind)[at], left + kinds + after[at]])
            if len(codes) > 2_000_000:
                yield rows(codes, sums)
                codes, sums = codes[:0], sums[:0]
        if len(codes):
            yield rows(codes, sums)

    parts = learning.select("seq").mapInArrow(run, "word int, code int, n long")
    return parts.groupBy("word", "code").agg(F.sum("n").alias("n"))


def _merged(codes: np.ndarray, sums: np.ndarray, held: list[np.ndarray]):
    fresh, n = np.unique(np.concatenate(held), return_counts=True)
    both = np.concatenate((codes, fresh))
    codes, at = np.unique(both, return_inverse=True)
    return codes, np.bincount(at, np.concatenate((sums, n)), len(codes)).astype(np.int64)


def attached(found: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """word, k: the class that a word's neighbours make likeliest, if it is no shape's.

    The gain of a word that is rare beside its class is the derivative of the
    likelihood by its counts. ``own`` is the word's shape's class, which competes.
    """
    kinds = len(table)
    logs = np.log(table + 0.5)
    rows, columns = np.log(table.sum(axis=1) + 0.5), np.log(table.sum(axis=0) + 0.5)
    # Scores of a class by counts of classes before the word, then after it.
    by = np.concatenate((logs - columns[None, :], logs.T - rows[None, :]))
    listed = found.groupBy("word", "own").agg(F.collect_list(F.struct("code", "n")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("c")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            counts = np.zeros((batch.num_rows, 2 * kinds))
            counts[row, flat.field("code").to_numpy()] = flat.field("n").to_numpy()
            scores = counts @ by
            own = batch.column("own").to_numpy()
            best = np.argmax(scores[:, :classes], axis=1)
            every = np.arange(batch.num_rows)
            kept = scores[every, best] > scores[every, own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word").filter(pa.array(kept)), pa.array(best[kept], pa.int32())], ["word", "k"]
            )

    return listed.mapInArrow(run, "word int, k int")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def best_class(
    own: int, left: np.ndarray, right: np.ndarray, itself: float, table: np.ndarray, classes: int
) -> tuple[int, float]:
    """The class to which moving a word increases the likelihood most, and by how much.

    ``left`` and ``right`` count classes before and after the word, itself included;
    ``itself`` counts the word after itself; ``table`` counts class bigrams.
    """
    g = table.copy()
    g[:, own] -= left
    g[own, :] -= right
    g[own, own] += itself
    left, right = left.copy(), right.copy()
    left[own] -= itself
    right[own] -= itself
    # What follows a class, and precedes it, once the word stands next to it again.
    rows, columns = g.sum(axis=1) + left, g.sum(axis=0) + right
    before, after = left.sum() + itself, right.sum() + itself
    into, out = _xlogx(g + left[:, None]) - _xlogx(g), _xlogx(g + right[None, :]) - _xlogx(g)
    diagonal = np.diag(g)
    gain = into.sum(axis=0) + out.sum(axis=1)
    gain += _xlogx(diagonal + left + right + itself) - _xlogx(diagonal + left)
    gain -= _xlogx(diagonal + right) - _xlogx(diagonal)
    # Marginals: contexts of other classes do not change, that of the class grows.
    gain -= _xlogx(rows + after) - _xlogx(rows) + _xlogx(columns + before) - _xlogx(columns)
    best = int(np.argmax(gain[:classes]))
    return best, float(gain[best] - gain[own])


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, without what no assignment of classes changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def exchange(
    pairs: np.ndarray, n_words: int, classes: int = CLASSES, rounds: int = ROUNDS
) -> tuple[np.ndarray, list[float]]:
    """Class of every symbol, and the likelihood before and after each round.

    ``pairs`` counts symbols before symbols: words first, then shapes and the end, which
    keep classes of their own. Words start spread over the classes. They are looked at
    one after another, and every move changes the tables before the next word's turn.
    """
    of = np.concatenate((np.arange(n_words) % classes, classes + np.arange(len(pairs) - n_words)))
    total = classes + len(pairs) - n_words
    member = np.zeros((len(pairs), total))
    member[np.arange(len(pairs)), of] = 1
    after, before = pairs @ member, pairs.T @ member
    table = member.T @ after
    course = [likelihood(table)]
    for _ in range(rounds if n_words else 0):
        moved = False
        for w in range(n_words):
            own, itself = int(of[w]), pairs[w, w]
            best, gain = best_class(own, before[w], after[w], itself, table, classes)
            if best == own or gain <= 1e-6:
                continue
            moved = True
            left, right = before[w].copy(), after[w].copy()
            table[:, own] -= left
            table[own, :] -= right
            table[own, own] += itself
            left[own] -= itself
            right[own] -= itself
            table[:, best] += left
            table[best, :] += right
            table[best, best] += itself
            of[w] = best
            for sums, column in ((after, pairs[:, w]), (before, pairs[w])):
                sums[:, own] -= column
                sums[:, best] += column
        course.append(likelihood(table))
        if not moved:
            break
    return of, course


@dataclass
class Model:
    """Everything scoring needs, of bounded size."""

    known: dict[str, np.ndarray]  # w, shape, c of the most frequent words, by w
    of: np.ndarray  # class of each known word
    transitions: np.ndarray  # log10 p(class | class before)
    words: np.ndarray  # words of each class, counted
    distinct: np.ndarray  # different words of each class
    open: np.ndarray  # whether a class has room for unseen words
    train_tokens: int
    vocabulary: int
    course: list[float]  # likelihood of class bigrams: start, after each round, at the end

    @property
    def clustered(self) -> float:
        """Part of the learning words (ends aside) whose class was chosen."""
        classes = len(self.words) - SHAPES - 1
        inner = self.words[:-1].sum()
        return float(self.known["c"][self.of < classes].sum() / inner) if inner else 0.0


def fit(
    documents: DataFrame,
    core_words: int = CORE_WORDS,
    known_words: int = KNOWN_WORDS,
    classes: int = CLASSES,
    rounds: int = ROUNDS,
    min_count: int = MIN_COUNT,
) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all texts that are not held out, the table of their words, and the
    sequences of all texts."""
    importable(documents.sparkSession)
    spark = documents.sparkSession
    counts = stored(count_words(documents.where(~held_out())), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    inner = counts.where("shape >= 0")
    known = _arrays(frequent(inner, known_words))
    size = len(known["w"])
    written = stored(sequences(documents, known["w"]), "sequences")
    learning = written.where("seq IS NOT NULL AND NOT held_out")

    order = np.lexsort((known["w"], -known["c"]))[:core_words]
    shapes = np.arange(SHAPES)
    symbol = len(order) + known["shape"].astype(np.int64)
    symbol[order] = np.arange(len(order))
    symbols = len(order) + SHAPES + 1
    pairs = count_pairs(learning, _lookup(symbol, len(order) + shapes, symbols - 1), symbols)
    exchanged, course = exchange(pairs, len(order), classes, rounds)

    total = classes + SHAPES + 1
    member = np.zeros((symbols, total))
    member[np.arange(symbols), exchanged] = 1
    table = member.T @ pairs @ member
    of = exchanged[symbol]
    lookup = lambda of: _lookup(of, classes + shapes, total - 1)
    wanted = known["c"] >= min_count
    wanted[order] = False
    if wanted.any():
        own = spark.createDataFrame(
            pa.table({"word": np.flatnonzero(wanted).astype(np.int32), "own": of[wanted].astype(np.int32)})
        )
        found = contexts(learning, lookup(of), wanted, total).join(own, "word")
        # At most ``known_words`` rows of two numbers.
        chosen = attached(found, table, classes).toArrow()
        fresh = of.copy()
        fresh[chosen["word"].to_numpy()] = chosen["k"].to_numpy()
        again = count_pairs(learning, lookup(fresh), total)
        if likelihood(again) > likelihood(table):
            of, table = fresh, again
    course.append(likelihood(table))

    used = np.zeros(total, bool)
    used[classes:] = True
    used[of] = True
    share = (table.sum(axis=0) + used) / (table.sum() + used.sum())
    rows = table.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        transitions = np.log10((table + CLASS_PRIOR * share) / (rows + CLASS_PRIOR))
    # Different words of a class: known ones, and of a shape those that are not known.
    distinct = np.bincount(of, minlength=total).astype(float)
    for row in inner.groupBy("shape").agg(F.count("*").alias("n")).collect():
        distinct[classes + row["shape"]] += row["n"]
    np.subtract.at(distinct, classes + known["shape"][:size], 1)
    distinct[total - 1] = 1
    open_ = np.zeros(total, bool)
    open_[classes : total - 1] = True
    model = Model(known, of, transitions, table.sum(axis=0), distinct, open_, int(n), int(v), course)
    return model, counts, written


_SCORED = "doc_id long, th long, held_out boolean, n_tokens long, n_known long, base double, model double"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Sums of each text as far as its words are known by number."""
    classes = len(model.words) - SHAPES - 1
    shapes = classes + np.arange(SHAPES)
    end = classes + SHAPES
    base_bottom = np.log10(model.train_tokens + model.vocabulary + 1)
    bottom = np.log10(np.maximum(model.words + WORD_PRIOR * (model.distinct + model.open), 1e-9))
    c, none = model.known["c"], np.zeros(SHAPES)
    kinds = _lookup(model.of, shapes, end)
    base = _lookup(np.log10(c + 1.0), none, np.log10(model.words[end] + 1)) - base_bottom
    # The end is the only word of its class.
    emit = _lookup(np.log10(c + WORD_PRIOR) - bottom[model.of], -bottom[shapes], 0.0)
    seen = _lookup(np.ones(len(c)), none, float(model.words[end] > 0))
    for batch in batches:
        numbers, ends = _numbers(batch.column("seq"))
        n, sizes = batch.num_rows, np.diff(ends, prepend=0)
        row = np.repeat(np.arange(n), sizes)
        kind = kinds[numbers]
        steps = emit[numbers] + (model.transitions[_before(kind), kind] if len(kind) else 0.0)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(x) for x in ("doc_id", "th", "held_out")],
                pa.array(sizes, pa.int64()),
                pa.array(np.bincount(row, seen[numbers], n).astype(np.int64)),
                pa.array(np.bincount(row, base[numbers], n)),
                pa.array(np.bincount(row, steps, n)),
            ],
            names=[x.split()[0] for x in _SCORED.split(", ")],
        )


def score(written: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    One row per document of the written sequences; scores are log10 probabilities. A
    null text is empty and has only its end. Repeated rows each give a row; other
    columns are ignored.
    """
    shipped = written.sparkSession.sparkContext.broadcast(model)
    numbered = written.where("seq IS NOT NULL").select("doc_id", "th", "held_out", "seq")
    texts = stored(numbered.mapInArrow(lambda b: _score(b, shipped.value), _SCORED), "scored")
    found = written.where("w IS NOT NULL").select("doc_id", "th", "w", "k")
    count = F.coalesce(F.col("c"), F.lit(0))
    seen = found.join(counts.select("w", "c"), "w", "left").select(
        "doc_id",
        "th",
        F.when(count > 0, F.col("k")).otherwise(0).alias("n"),
        (F.col("k") * F.log10(count + 1)).alias("base"),
        (F.col("k") * F.log10(count + WORD_PRIOR)).alias("model"),
    )
    # Equal rows state their words once each: the marks tell how many rows there are.
    none = F.lit(0.0)
    sums = (
        seen.withColumn("mark", F.lit(0))
        .unionByName(
            texts.select(
                "doc_id",
                "th",
                F.lit(0).cast("long").alias("n"),
                none.alias("base"),
                none.alias("model"),
                F.lit(1).alias("mark"),
            )
        )
        .groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "th", F.isnull("doc_id").alias("no_id"))
        .agg(
            (F.sum("n") / F.sum("mark")).cast("long").alias("more_known"),
            (F.sum("base") / F.sum("mark")).alias("more_base"),
            (F.sum("model") / F.sum("mark")).alias("more_model"),
        )
    )
    out = (
        texts.withColumn("id", F.coalesce("doc_id", F.lit(0)))
        .withColumn("no_id", F.isnull("doc_id"))
        .join(sums, ["id", "th", "no_id"])
        .withColumn("score", F.col("model") + F.col("more_model"))
    )
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def score_all(documents: DataFrame, **options) -> DataFrame:
    """Learns from the documents that are not held out and scores all of them."""
    importable(documents.sparkSession)
    model, counts, written = fit(documents, **options)
    return score(written, model, counts)
