"""The pipeline against the same stages by definition."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from brute import fingerprint, groups, ids, quality, words
from document_rows import SCHEMA, rows

from ledgerloom.llm import mixing, pii
from ledgerloom.llm import quality as rules


def test_stages(spark, tmp_path):
    source = tmp_path / "documents.parquet"
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(source))
    docs = spark.read.parquet(str(source))
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage{len(out)}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    accepted, distinct, clean, mixed, packed = out

    verdicts = [bool(v) for v in rules.measure([(r[1] or "").encode() for r in rows()])["kept"]]
    assert Counter(map(tuple, accepted)) == Counter(r for r, v in zip(rows(), verdicts, strict=True) if v)
    assert not any(v and quality(r[1])[-1] for r, v in zip(rows(), verdicts, strict=True))

    of = groups([fingerprint(r["text"]) for r in accepted])
    assert len(distinct) == len(set(of))
    assert set(map(tuple, distinct)) <= set(map(tuple, accepted))

    assert len(clean) == len(distinct)
    again = pii.digest(spark.createDataFrame(clean, SCHEMA))
    assert again.agg({"n_email": "sum", "n_card": "sum"}).first()[0] == 0

    taken = mixing.digest(spark.createDataFrame(clean, SCHEMA)).agg({"taken": "sum"}).first()[0]
    assert sum(len(words(r["text"])) for r in mixed) == taken
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}

    assert sum(r["length"] for r in packed) == sum(len(ids(r["text"], 0)) for r in mixed)


def test_run_over_the_smallest_scale(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.count() > 0
    assert found.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
