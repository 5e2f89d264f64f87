"""Each query against its definition, on rows with every awkward case."""

from __future__ import annotations

import hashlib
import math
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from brute import (
    base_spans,
    crc,
    fingerprint,
    fold,
    groups,
    ids,
    lowered,
    quality,
    repeats,
    targets,
    words,
)
from document_rows import CLASHING, rows
from pyspark.sql import functions as F

from ledgerloom.llm import (
    class_lm,
    language,
    mixing,
    neighbours,
    packing,
    pii,
    simhash,
    sql,
    substrings,
    token_files,
)
from ledgerloom.llm import quality as rules
from ledgerloom.llm.common import shared_root, stored

OPERATORS = {
    "pii": pii.digest,
    "substrings": substrings.digest,
    "simhash": simhash.digest,
    "mixing": mixing.digest,
    "quality": rules.digest,
    "tokens": lambda d: token_files.digest(token_files.write(d)),
    "lm": lambda d: class_lm.score_all(d, core_words=20, classes=4, rounds=2, min_count=2),
    "packing": packing.pack,
    "language": language.identify,
}


def table(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_documents, name):
    assert OPERATORS[name](no_documents).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_with_clashing_names(documents, name):
    extra = documents.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    assert rounded(OPERATORS[name](extra)) == rounded(OPERATORS[name](documents))


def rounded(df):
    """Sums of doubles come in any order."""
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


STAGES = {
    "quality": rules.accepted,
    "simhash": simhash.representatives,
    "pii": pii.redact,
    "mixing": mixing.mixed_documents,
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(documents, name):
    names = [*CLASHING, "id", "nameless", "row", "spans", "ordered", "redacted", "all", "number", "mine", "copy", "text.x"]
    values = [F.lit(i).alias(c) for i, c in enumerate(names)]
    found = STAGES[name](documents.select("*", *values))
    assert found.columns == [*documents.columns, *names]
    plain = STAGES[name](documents)
    assert Counter(tuple(r) for r in found.collect()) == Counter((*r, *range(len(names))) for r in plain.collect())


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_no_documents(no_documents, name):
    found = STAGES[name](no_documents)
    assert found.columns == no_documents.columns and found.count() == 0


def test_kept_by_definition(documents):
    """Ratios of the whole text and of its chunks against the band of their length."""
    def outside(data):
        ratio = len(data) / len(zstandard.ZstdCompressor(level=3).compress(data))
        _, low, high = max(b for b in rules.BANDS if b[0] <= len(data))
        return ratio, not low <= ratio <= high

    expected = Counter()
    for r in rows():
        data, ratio, kept = (r[1] or "").encode(), None, False
        if data:
            ratio, bad = outside(data)
            chunks = [data[i : i + 2048] for i in range(0, len(data), 2048)] if len(data) > 2048 else []
            wrong = sum(len(c) for c in chunks if outside(c)[1])
            kept = not bad and wrong / len(data) <= 0.3 and not quality(r[1])[-1]
        expected[(r[0], ratio and round(ratio, 6), kept)] += 1
    found = rules.digest(documents).select("doc_id", "ratio", "kept")
    assert table(found) == expected
    assert {k for _, _, k in expected} == {True, False}


def test_pii(documents):
    expected = Counter()
    for doc_id, text, *_ in rows():
        spans = base_spans(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        n = Counter(k for k, _, _ in spans)
        expected[(doc_id, n["email"], n["ip"], n["card"], n["phone"], digest)] += 1
    found = pii.digest(documents)
    assert table(found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == expected
    added = found.where("doc_id = 13").select("n_iban", "n_ssn").first()
    assert tuple(added) == (2, 1)  # 987-... has no valid area
    text = dict((r[0], r[1]) for r in rows())[13]
    values = pii.spans(documents).where("doc_id = 13").collect()
    assert all(text[r["start"] : r["end"]] == r["value"] for r in values)


def test_pii_patterns_stay_linear(spark):
    long = "a" * 200_000 + " " + "1" * 200_000 + " " + "x@" + "b." * 100_000 + " +1" + "(" * 100_000
    found = pii.digest(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert found["n_card"] == 0 and found["n_email"] == len([s for s in base_spans(long[-400_000:]) if s[0] == "email"])


def test_redaction(documents):
    out = {r["doc_id"]: r for r in pii.redact(documents).collect()}
    assert out[13]["text"].startswith("bank account <iban> or <iban>; ssn <ssn>, 987-65-4321")
    assert out[13]["n_chars"] == len(out[13]["text"])
    assert out[7]["text"] is None and out[0]["text"] == dict((r[0], r[1]) for r in rows())[0]


def test_account_numbers_before_capitals_and_numbers(spark):
    numbers = (
        "ES91 2100 0418 4502 0005 1332",
        "BE68539007547034",
        "AT61 1904 3002 3457 3201",
        "DE89 3704 0044 0532 0130 00",
    )
    after = ("", " BIC CAIXESBB", " 2024", " 2024 AND MORE CAPS", ".", " lower", " DE00 1234 5678")
    texts = [f"pay {n}{a}" for n in numbers for a in after]
    texts += [f"BE68 {numbers[3]}", f"XX12 ABCD {numbers[0]} BIC", "ES91 2100 0418 4502 0005 1333 BIC"]
    found = defaultdict(list)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.spans(frame).where("kind = 'iban'").collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["value"]
        found[r["doc_id"]].append(r["value"])
    expected = [[n] for n in numbers for _ in after] + [[numbers[3]], [numbers[0]], []]
    assert [found[i] for i in range(len(texts))] == expected
    out = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert out[1] == "pay <iban> BIC CAIXESBB"


def test_substrings(documents):
    pairs = [(r[0], r[1]) for r in rows()]
    assert table(substrings.digest(documents)) == Counter(repeats(pairs))
    assert table(substrings.digest(documents, 8, 3)) == Counter(repeats(pairs, 8))


@pytest.mark.parametrize("bucket_rows", [simhash.BUCKET_ROWS, 1])
def test_simhash(documents, bucket_rows):
    prints = [fingerprint(r[1]) for r in rows()]
    of = groups(prints)
    least = defaultdict(lambda: math.inf)
    for r, g in zip(rows(), of, strict=True):
        least[g] = min(least[g], math.inf if r[0] is None else r[0])
    expected = Counter(
        (r[0], f"{p:016x}", None if least[g] == math.inf else least[g])
        for r, p, g in zip(rows(), prints, of, strict=True)
    )
    found = simhash.groups(documents, bucket_rows=bucket_rows)
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    assert table(found.select("doc_id", hexadecimal, "component_id")) == expected


def test_simhash_links_of_near_fingerprints(spark):
    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(0, 1 << 62, 40)}
    for _ in range(300):  # chains and stars of flipped bits
        x = int(rng.choice(sorted(values)[:60]))
        values.add(x ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    prints = sorted(values)
    of = groups(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from ledgerloom.llm.components import components

    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for bucket_rows in (1000, 5):
        roots = dict(components(simhash.links(frame, 2, bucket_rows)).collect())
        found = [roots.get(s, s) for s in signed]
        assert len(set(zip(found, of, strict=True))) == len(set(of)) == len(set(found))


def test_simhash_representatives(documents):
    found = simhash.groups(documents).collect()
    kept = simhash.representatives(documents)
    assert kept.columns == documents.columns
    assert kept.count() == len({r["root"] for r in found})


def test_mixing(documents):
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    goal = targets(sizes)
    found = mixing.digest(documents).collect()
    assert len(found) == len(rows())
    taken = Counter()
    by_size = {s: goal[k] for k, s in sizes.items()}
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(by_size[r["source_size"]])
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in by_size.items())
    assert table(mixing.digest(documents.repartition(5))) == table(mixing.digest(documents))


def test_mixing_schedule_keeps_shares_everywhere(documents):
    plan = mixing.schedule(documents, block=8).toPandas()
    blocks = plan.groupby("slot").source_no.first().sort_index()
    share = blocks.value_counts(normalize=True)
    for start in range(0, len(blocks) - 200, 100):
        part = blocks.iloc[start : start + 200].value_counts(normalize=True)
        assert (part.reindex(share.index).fillna(0) - share).abs().max() < 0.05
    assert plan.groupby(["source_no", "r"]).taken.sum().max() == 8


def test_mixed_documents(documents):
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    total = out.select(F.sum(mixing.word_count())).first()[0]
    assert total == mixing.digest(documents).agg(F.sum("taken")).first()[0]


def test_quality(documents):
    expected = Counter((r[0], *quality(r[1])) for r in rows())
    found = rules.digest(documents)
    base = found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert table(base) == expected
    assert found.where("base_failed AND kept").count() == 0


def test_quality_bands_reject_noise_and_repetition():
    import zstandard

    compress = zstandard.ZstdCompressor(3).compress
    noise = np.random.default_rng(1).integers(33, 126, 20_000).astype(np.uint8).tobytes()
    assert not rules.compression(compress, noise)[2]
    assert not rules.compression(compress, b"all the same words again " * 400)[2]
    prose = rows()[10][1].encode()
    half = prose[:9000] + noise[:9000]
    assert rules.compression(compress, half)[1] > rules.BAD_CHUNKS


def test_token_files(documents):
    blocks = token_files.write(documents, block_ids=500)
    found = token_files.digest(blocks).orderBy("start").collect()
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [r[0] for r in ordered]
    lengths = Counter((r[0], len(ids(r[1], 2)), crc(ids(r[1], 2))) for r in rows())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == lengths
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.lookup(blocks, 10).first()["ids"] == ids(rows()[10][1], 2)


def test_lookup_reads_few_blocks(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    blocks = token_files.write(documents.repartition(4), block_ids=2000)
    found = token_files.lookup(blocks, 637)
    text = documents.where("doc_id = 637").first()["text"]
    assert found.first()["ids"] == ids(text, 2)
    plan = found._jdf.queryExecution().executedPlan()
    assert "LessThanOrEqual(least,637)" in plan.toString() and "GreaterThanOrEqual(greatest,637)" in plan.toString()
    assert blocks.where("least <= 637 AND greatest >= 637").count() == 1 < blocks.count()


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 31, 32])
def test_packed_bits_round_trip(bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = token_files.pack(values, bits)
    flags = "".join(f"{int(v):0{bits}b}"[::-1] for v in values).ljust(-(-1001 * bits // 8) * 8, "0")
    assert data == bytes(int(flags[i : i + 8][::-1], 2) for i in range(0, len(flags), 8))
    for start, count in ((0, 1001), (13, 5), (1000, 1), (400, 0)):
        assert (token_files.unpack(data, bits, start, count) == values[start : start + count]).all()


def test_word_encoder_equals_the_library(documents):
    import random

    from ledgerloom.llm.tokens import WordEncoder, vocabulary_path

    alphabet = [*"aAbZ'srééÉßŸ  \x0b\x1c\x85　İıſKΣσς1٣²½.,!?;:'-_<|>\n\té日👍🏽\x00"]
    alphabet += ["<|endoftext|>", "'re", "'LL", "don't", "ﬁ", "á", " "]
    rng = random.Random(5)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    encode = WordEncoder(vocabulary_path(), limit=200)  # forgets often
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        flat, bounds = encode.encode([t.encode() for t in part], 2)
        for i, t in enumerate(part):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == ids(t, 2)


def test_packing(documents):
    found = packing.pack(documents).collect()
    expected = Counter()
    for r in rows():
        all_ids = ids(r[1], 0)
        for i in range(0, len(all_ids), 2048):
            part = all_ids[i : i + 2048]
            expected[(r[0], i // 2048, i, len(part), crc(part))] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r["length"] for r in found) // 2048) + 1


def test_packing_plans_are_tight():
    rng = np.random.default_rng(0)
    for lengths in (
        np.clip(rng.lognormal(6, 1, 20_000), 1, 2048).astype(int),
        rng.integers(1, 2049, 20_000),
        np.array([2048, 2048, 1]),
    ):
        histogram = Counter(lengths.tolist())
        plans = [packing.Plan(histogram, groups=n) for n in packing.GROUPS]
        best = min(plans, key=lambda p: p.sequences)
        placed = Counter()
        fill = np.zeros(best.sequences, int)
        for length, _, count, sequence, per, _ in best.runs:
            placed[length] += count
            np.add.at(fill, sequence + np.arange(count) // per, length)
        assert placed == histogram and fill.max() <= 2048
        assert best.sequences <= 1.01 * lengths.sum() / 2048 + 1


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[50:90] = x[50]  # equal vectors: ties
    x[100:140] = x[100] + 0.01 * rng.standard_normal((40, 16))
    data = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    bad = [
        (500, None),
        (520, []),
        (540, [0.0] * 16),
        (560, [float("nan")] * 16),
        (580, [None] + [1.0] * 15),
        (600, [float("inf")] * 16),
        (620, [1.0] * 3),
        (None, [1.0] * 16),
        data[20],
    ]
    frame = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>")
    return frame.withColumn("score", F.lit(1)), np.float32(x).astype(float)


@pytest.mark.parametrize("chunk", [neighbours.CHUNK, 7])
def test_neighbours(spark, chunk):
    frame, x = vectors(spark)
    found = defaultdict(list)
    for r in neighbours.search(frame, chunk=chunk).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 400, 20))
    hits = 0
    for q, got in found.items():
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(400), -np.round(scores, 9))) if i != q][:20]
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert all(s == pytest.approx(scores[v], abs=1e-12) for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(order))
    assert hits / (20 * 20) >= 0.9
    assert {v for _, v, _ in found[60]} == set(range(50, 71)) - {60}


def dense_vectors(n: int = 1500, dense: int = 500, dimension: int = 32) -> np.ndarray:
    """Unit vectors, ``dense`` of them unequal near-copies of one."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, dimension))
    x[:dense] = x[0] + 1e-3 * rng.standard_normal((dense, dimension))
    return np.float32(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)


@pytest.mark.parametrize("chunk", [neighbours.CHUNK, 16])
def test_neighbours_outside_a_dense_group(spark, chunk):
    x = dense_vectors()
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"
    )
    found = defaultdict(set)
    for r in neighbours.search(frame, chunk=chunk).collect():
        found[r["query_id"]].add(r["vec_id"])
    outside = range(500, 1500, 20)
    assert all(len(found[q]) == 20 for q in range(0, 1500, 20))
    hits = 0
    for q in outside:
        order = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]
        hits += len(found[q] & set(order))
    assert hits / (20 * len(outside)) >= 0.95


def test_neighbour_radii_serve_every_scale():
    found = neighbours.radii(np.concatenate((np.full(600, 0.01), np.linspace(1, 1.4, 400))))
    assert found[:2] == [0.01, 1.4] and len(found) == 3


def test_projections_grow_with_the_logarithm():
    found = [neighbours.functions_for(n) for n in (1, 500, 50_000, 2**20, 2**24, 2**40)]
    assert found == [4, 4, 4, 5, 6, 8]


def test_no_query_among_the_vectors(spark):
    rows_ = [(20 * i + 1, [float(i), 1.0]) for i in range(30)]
    frame = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    assert neighbours.search(frame).count() == 0


def test_neighbours_compare_chunks_without_queries(spark):
    found = spark.createDataFrame(
        [(i, [1.0, float(i)], [i]) for i in range(9)], "rep long, embedding array<double>, ids array<long>"
    )
    nobody = found.select("rep", "embedding").where("rep < 0")
    assert neighbours._scanned(found, nobody, 2, 4).count() == 0
    assert neighbours._scanned(nobody, found.select("rep", "embedding"), 2, 4).count() == 0


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(none).count() == 0


LM = {"core_words": 20, "classes": 4, "rounds": 3, "min_count": 2}


@pytest.mark.parametrize("known", [1 << 19, 60, 0])
def test_class_lm(documents, known):
    """Base and score by definition, given the classes; words that are not known have their shape's."""
    model, counts, written = class_lm.fit(documents, known_words=known, **LM)
    found = class_lm.score(written, model, counts).collect()
    tokens = [[*words(lowered(r[1])), None] for r in rows()]
    held = [fold(r[0], 7) == 2 for r in rows()]
    seen = [t for t, h in zip(tokens, held, strict=True) if not h]
    times = Counter(w for t in seen for w in t)
    n, v = sum(times.values()), len(times)
    numbers = {h: i for i, h in enumerate(model.known["w"].tolist())}

    def kind(word):
        if word is None:
            return 4 + class_lm.SHAPES
        digest = np.uint64(xxhash.xxh3_64_intdigest(word.encode())).astype(np.int64)
        at = numbers.get(int(digest))
        return 4 + class_lm.shape(word.encode()) if at is None else int(model.of[at])

    pairs = Counter((kind(a), kind(b)) for t in seen for a, b in zip([None, *t[:-1]], t, strict=True))
    into, out = Counter(), Counter()
    for (a, b), c in pairs.items():
        out[a] += c
        into[b] += c
    used = {kind(w) for w in times} | set(range(4, 5 + class_lm.SHAPES))
    members = Counter(kind(w) for w in times)

    def step(a, b):
        share = (into[b] + 1) / (n + len(used))
        return (pairs[a, b] + class_lm.CLASS_PRIOR * share) / (out[a] + class_lm.CLASS_PRIOR)

    def emission(word):
        k = kind(word)
        if word is None:
            return 1.0
        room = members[k] + (k >= 4)
        return (times[word] + class_lm.WORD_PRIOR) / (into[k] + class_lm.WORD_PRIOR * room)

    expected = Counter()
    for r, t, h in zip(rows(), tokens, held, strict=True):
        base = sum(math.log10((times[w] + 1) / (n + v + 1)) for w in t)
        score = sum(
            math.log10(step(kind(a), kind(b)) * emission(b)) for a, b in zip([None, *t[:-1]], t, strict=True)
        )
        expected[(r[0], h, len(t), sum(times[w] > 0 for w in t), n, round(base, 6), round(score, 6))] += 1
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    got = Counter((*(r[c] for c in columns), round(r["base_score"], 6), round(r["score"], 6)) for r in found)
    assert got == expected
    if known == 0:
        assert model.clustered == 0.0 and not len(model.of)


def test_class_lm_probabilities_sum_to_one(documents):
    model, counts, _ = class_lm.fit(documents, **LM)
    rows_ = 10.0**model.transitions
    used = np.isfinite(model.transitions).all(axis=0)
    assert np.allclose(rows_[:, used].sum(axis=1), 1)
    mass = model.words + class_lm.WORD_PRIOR * (model.distinct + model.open)
    sums = np.zeros(len(mass))
    np.add.at(sums, model.of, model.known["c"] + class_lm.WORD_PRIOR)
    sums += class_lm.WORD_PRIOR * model.open
    inner = mass[:-1] > 0
    assert np.allclose(sums[:-1][inner], mass[:-1][inner])


def test_likelihood_never_falls_and_classes_stay_in_use(spark):
    """On the given texts: every round, and the step that attaches the other words."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, counts, written = class_lm.fit(documents)
    assert len(model.course) > 3
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.course, model.course[1:], strict=False))
    assert model.course[-1] > model.course[0]
    assert set(range(class_lm.CLASSES)) <= set(model.of.tolist())
    often = model.known["c"] >= class_lm.MIN_COUNT
    total = counts.where("shape >= 0").agg({"c": "sum"}).first()[0]
    # All but the few words that fit their shape's class best.
    assert model.clustered > 0.9 * model.known["c"][often].sum() / total
    held = class_lm.score(written, model, counts).where("held_out")
    mean = held.selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert mean[0] > mean[1]


@pytest.mark.parametrize("most", [0, 1, 7, 40, 100, 5000])
def test_the_most_frequent_words(spark, most):
    rng = np.random.default_rng(most)
    counts = [(int(w), int(c)) for w, c in zip(rng.integers(-(2**63), 2**63 - 1, 900), rng.zipf(1.3, 900) % 90 + 1, strict=True)]
    frame = spark.createDataFrame(counts, "w long, c long")
    found = sorted((r["c"] for r in class_lm.frequent(frame, most).collect()), reverse=True)
    expected = sorted((c for _, c in counts), reverse=True)[:most]
    assert found == expected[: len(found)]
    assert len(expected) - len(found) <= 4 * most**0.5 + 2 if most < 900 else len(found) == 900


def test_exchange_climbs():
    rng = np.random.default_rng(2)
    groups = np.arange(40) % 5
    pairs = rng.poisson(1 + 30.0 * (groups[None, :] == (groups[:, None] + 1) % 5)).astype(float)
    size = 40 + class_lm.SHAPES + 1
    table = np.zeros((size, size))
    table[:40, :40] = pairs
    of, course = class_lm.exchange(table, 40, 5, 20)
    assert all(b >= a for a, b in zip(course, course[1:], strict=False))
    assert len(set(of[:40].tolist())) == 5 and of[40:].tolist() == list(range(5, 5 + class_lm.SHAPES + 1))
    best = np.zeros((5, 5))
    np.add.at(best, (groups[:, None].repeat(40, 1), groups[None].repeat(40, 0)), pairs)
    assert course[-1] == pytest.approx(class_lm.likelihood(best), rel=0.02)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    n, k = 12, 3
    truth = rng.integers(0, 60, (n, n)).astype(float)
    of = np.arange(n) % k

    def likelihood(of):
        t = np.zeros((k, k))
        np.add.at(t, (of[:, None].repeat(n, 1), of[None].repeat(n, 0)), truth)
        f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1)), t

    start, t = likelihood(of)
    left = np.bincount(of, truth[:, 5], k)
    right = np.bincount(of, truth[5], k)
    best, gain = class_lm.best_class(of[5], left, right, truth[5, 5], t, k)
    trials = []
    for c in range(k):
        other = of.copy()
        other[5] = c
        trials.append(likelihood(other)[0])
    assert best == int(np.argmax(trials))
    assert gain == pytest.approx(max(trials) - start)


def grams(text):
    """Counts of buckets, n-gram by n-gram."""
    out, codes, after = Counter(), [32], False
    for c in (text or "").replace("\0", " ").lower():
        if c.isalpha():
            codes.append(ord(c))
        elif after:
            codes.append(32)
        after = c.isalpha()
    for n in range(1, 4):
        for i in range(len(codes) - n + 1):
            value = 0
            for c in codes[i : i + n]:
                value = (value * 0x9E3779B97F4A7C15 + c) % 2**64
            out[(value * (0xD1B54A32D192ED03 + 2 * (n - 1))) % 2**64 >> 52] += 1
    return out


def test_language_by_definition(documents):
    """Weights over all learning texts, cosines to every centroid, rejection by its radius."""
    model = language.fit(documents)
    learning = [r for r in rows() if fold(r[0], 4) != 2 and r[2] is not None and r[1] is not None]
    texts_with = Counter(b for r in learning for b in grams(r[1]))
    idf = [math.log((1 + len(learning)) / (1 + texts_with[b])) + 1 for b in range(language.BUCKETS)]
    assert np.allclose(model.idf, idf)
    expected = []
    for doc_id, text, *_ in rows():
        x = np.zeros(language.BUCKETS)
        for b, c in grams(text).items():
            x[b] = (1 + math.log(c)) * idf[b]
        cosines = model.centres @ (x / np.linalg.norm(x))
        best = int(np.argmax(cosines))
        if any(c.isalpha() for c in text or ""):
            score = float(np.clip(cosines[best], 0, 1))
            expected.append((doc_id, fold(doc_id, 4) == 2, model.languages[best], round(score, 9), score < model.radii[best]))
        else:
            expected.append((doc_id, fold(doc_id, 4) == 2, "und", 0.0, True))
    found = language.predict(documents, model).collect()
    close = Counter((r[0], r[1], r[2], round(r[3], 9)) for r in found)
    assert close == Counter(e[:4] for e in expected)
    # At the border of a radius, rounding decides.
    far = {(e[0], e[4]) for e in expected if not any(abs(e[3] - r) < 1e-9 for r in model.radii)}
    assert far <= {(r["doc_id"], r["rejected"]) for r in found}


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_language_counts_do_not_depend_on_neighbours(cuts):
    texts = [r[1] for r in rows()]
    whole = language.counts(texts)[0]
    parts = [language.counts(texts[i : i + cuts])[0] for i in range(0, len(texts), cuts)]
    assert (np.concatenate(parts) == whole).all()


def test_language(spark):
    from document_rows import prose

    kinds = {
        "x": ("ba", "bo", "bu", "bi"),
        "y": ("sch", "tz", "ung", "eit"),
        "z": ("ção", "nha", "lho", "ões"),
    }
    rng = np.random.default_rng(4)
    data = []
    for i in range(240):
        lang = "xyz"[i % 3]
        text = " ".join("".join(rng.choice(kinds[lang], 3)) for _ in range(1 + i % 40))
        data.append((i, text, lang if i % 11 else None))
    data += [(900, None, "x"), (901, "123 !?", "x"), (902, "", None), (None, prose(1, 5), "x")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.identify(frame).collect()}
    assert all(out[i]["held_out"] == (fold(i, 4) == 2) for i in out)
    held = [(out[i]["lang_pred"], "xyz"[i % 3]) for i in range(240) if out[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_without_labels(documents):
    out = language.identify(documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in out.collect()} == {"und"}


def test_sql_agrees_on_awkward_rows(spark, documents):
    numbers = [(500 + i, t, "en", "a", None) for i, t in enumerate(ACCOUNT_TEXTS + CONTEXT_TEXTS)]
    more = documents.unionByName(spark.createDataFrame(numbers, documents.schema))
    with duckdb.connect() as con:
        con.register("documents", more.toArrow())
        for name, operator in (
            ("op1_pii", pii.digest),
            ("op2_substring_dedup", substrings.digest),
            ("op4_mixing", mixing.digest),
        ):
            found = operator(more)
            theirs = con.sql(sql.statements()[name]).select(", ".join(found.columns)).fetchall()
            assert table(found) == Counter(theirs), name


ACCOUNT_TEXTS = [
    f"pay {n}{a}"
    for n in ("ES91 2100 0418 4502 0005 1332", "BE68539007547034", "AT61 1904 3002 3457 3201")
    for a in ("", " BIC CAIXESBB", " 2024", " 2024 AND MORE CAPS", ".", " lower", " DE00 1234 5678")
] + ["BE68 DE89 3704 0044 0532 0130 00", "XX12 ABCD ES91 2100 0418 4502 0005 1332 BIC"]
CONTEXT_TEXTS = [
    f"{w} 123-45-6789" for w in ("social", "antisocial", "my ssn is", "the SSN:", "ghosts", "socially", "(insurance)")
] + ["123-45-6789 security", "123-45-6789 insecurity", "x" * 60 + " ssn 123-45-6789", "123-45-6789, 123-45-6780 ssn"]


def test_context_words_stand_alone(spark):
    frame = spark.createDataFrame(list(enumerate(CONTEXT_TEXTS)), "doc_id long, text string")
    kept = {r["doc_id"] for r in pii.spans(frame).where("kind = 'ssn'").collect()}
    assert [i in kept for i in range(9)] == [True, False, True, True, False, False, True, True, False]
    assert {r["score"] for r in pii.spans(frame).where("kind = 'ssn'").collect()} == {0.7}


def test_many_matches_in_one_text(spark):
    """All kinds, in time that grows with the text and no faster."""
    n = 100_000
    parts = ["a{0}@b.org", "10.0.0.{1};", "4111 1111 1111 1111;", "+49 30 123456{1:02};", "DE89370400440532013000", "ssn 123-45-6789"]
    text = " ".join(parts[i % 6].format(i, i % 90) for i in range(n))
    frame = spark.createDataFrame([(1, text, 7), (2, None, 0)], "doc_id long, text string, n_chars long")
    start = time.monotonic()
    found = pii.digest(frame).orderBy("doc_id").collect()
    spans = [f"{k}:{a}:{b}" for k, a, b in base_spans(text)]
    assert found[0]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert found[0]["n_email"] == 16_667 and found[0]["n_iban"] == 16_666 and found[0]["n_ssn"] > 16_000
    out = pii.redact(frame).orderBy("doc_id").collect()
    assert time.monotonic() - start < 120
    assert out[0]["text"].count("<email>") == 16_667 and out[0]["n_chars"] == len(out[0]["text"])
    assert out[0]["text"].startswith("<email> <ip>; <card>; <phone>; <iban> ssn <ssn> <email>")
    assert tuple(out[1]) == (2, None, 0)


def test_stored_tables_lie_in_the_shared_folder(spark):
    out = stored(spark.range(3).toDF("x"), "few")
    assert out.count() == 3
    assert shared_root(spark).removeprefix("file:") in out.inputFiles()[0]
