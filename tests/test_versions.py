"""Builds are seen whole or not at all."""

from __future__ import annotations

import datetime
import os

import pytest
from panel_rows import rows_of
from pyspark.sql import functions as F

from ledgerloom.operators import quality
from ledgerloom.plans import published, reporting
from ledgerloom.sources import sinks
from ledgerloom.sources.versions import CommitConflict, Versions
from ledgerloom.spec import PanelSpec


@pytest.fixture
def versions(spark, tmp_path):
    return Versions(spark, str(tmp_path))


def put(spark, folder, value):
    spark.range(value).coalesce(1).write.parquet(folder)


def test_nothing_is_seen_before_the_commit(spark, versions):
    with pytest.raises(LookupError):
        versions.folder()
    build = versions.begin()
    put(spark, build.folder, 3)
    assert versions.numbers() == []
    assert versions.commit(build) == 1
    assert spark.read.parquet(versions.folder()).count() == 3


def test_the_second_of_two_builds_is_refused(spark, versions):
    first, second = versions.begin(), versions.begin()
    for n, build in ((1, first), (2, second)):
        put(spark, build.folder, n)
    versions.commit(second)
    with pytest.raises(CommitConflict):
        versions.commit(first)
    assert spark.read.parquet(versions.folder()).count() == 2
    assert versions.append(first.folder) == 2
    assert list(versions.folders()) == [1, 2] and versions.folder(2) == first.folder


def test_a_number_taken_at_the_last_moment_is_refused(versions, monkeypatch):
    """Both builders look before either renames; the rename decides."""
    first, second = versions.begin(), versions.begin()
    monkeypatch.setattr(Versions, "latest", lambda self: 0)
    assert versions.commit(first) == 1
    with pytest.raises(CommitConflict):
        versions.commit(second)
    assert versions.folder(1) == first.folder
    assert [n for n in os.listdir(f"{versions.root}/_commits") if not n.endswith(".crc")] == ["000000000001"]


def test_only_what_nobody_needs_expires(spark, versions):
    for n in range(1, 5):
        build = versions.begin()
        put(spark, build.folder, n)
        versions.commit(build)
    running = versions.begin()
    put(spark, running.folder, 9)
    assert len(versions.expire(keep=2)) == 2
    assert versions.numbers() == [3, 4]
    assert len(os.listdir(f"{versions.root}/builds")) == 3
    assert versions.commit(running) == 5
    with pytest.raises(ValueError):
        versions.expire(keep=0)


def panel_of(make_panel, loans, balance=100.0):
    return make_panel(*[{"id": i, "time": t, "balance_time": balance} for i in range(loans) for t in (1, 2, 4)])


def test_readers_keep_the_last_build_when_the_next_one_fails(spark, make_panel, tmp_path):
    root = f"{tmp_path}/store"
    first = published.publish(panel_of(make_panel, 3), PanelSpec(), root)
    assert first.number == 1
    before = rows_of(first.tables["vw_portfolio_summary"], "period")
    # The loans are written, then the fact's balances cannot be.
    failing = panel_of(make_panel, 5).withColumn(
        "balance_time", F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("balance_time"))
    )
    with pytest.raises(Exception, match="lost"):
        published.publish(failing, PanelSpec(), root)
    halfway = [d for d in os.listdir(f"{root}/builds") if not os.path.exists(f"{root}/builds/{d}/tables/manifest")]
    assert len(halfway) == 1 and os.path.exists(f"{root}/builds/{halfway[0]}/tables")
    again = published.open_published(spark, root)
    assert again.number == 1
    assert rows_of(again.tables["vw_portfolio_summary"], "period") == before
    assert again.tables["dim_loan"].count() == 3

    second = published.publish(panel_of(make_panel, 5), PanelSpec(), root, keep=1)
    assert second.number == 2 and Versions(spark, root).numbers() == [2]
    assert published.open_published(spark, root).tables["dim_loan"].count() == 5


def test_open_readers_see_one_build(spark, make_panel, tmp_path):
    root = f"{tmp_path}/store"
    old = published.publish(panel_of(make_panel, 2), PanelSpec(), root)
    names = old.create_views()
    assert set(names) == {*reporting.REPORTS, *published.TABLES, "manifest"}
    published.publish(panel_of(make_panel, 4), PanelSpec(), root)
    query = "SELECT count(*) AS n FROM fact_loan_quarter JOIN dim_loan USING (loan_id)"
    assert spark.sql(query).first()["n"] == 8
    published.open_published(spark, root).create_views()
    assert spark.sql(query).first()["n"] == 16
    counts = dict(map(tuple, published.open_published(spark, root).tables["manifest"].collect()))
    assert counts["fact_loan_quarter"] == 16 and counts["dim_loan"] == 4


def test_a_failed_append_leaves_the_register(spark, small, tmp_path):
    path = f"{tmp_path}/register"
    assert sinks.read_register(spark, path).count() == 0
    stamp = datetime.datetime(2024, 1, 1)
    findings = quality.register_rows(small.store.rules(), "4-quality", stamp)
    sinks.append_register(findings, path)
    before = rows_of(sinks.read_register(spark, path), "rule_name")
    failing = findings.withColumn(
        "affected_rows", F.when(F.col("rule_name") > "m", F.raise_error(F.lit("lost"))).otherwise(F.lit(1)).cast("long")
    )
    with pytest.raises(Exception, match="lost"):
        sinks.append_register(failing, path)
    assert rows_of(sinks.read_register(spark, path), "rule_name") == before
    # The same run again replaces itself, another is added.
    sinks.append_register(findings.withColumn("affected_rows", F.lit(7).cast("long")), path)
    sinks.append_register(quality.register_rows(small.store.rules(), "4-quality", stamp.replace(day=2)), path)
    found = rows_of(sinks.read_register(spark, path), "run_timestamp", "rule_name")
    assert len(found) == 20 and [r["affected_rows"] for r in found[:10]] == [7] * 10
    assert [r["affected_rows"] for r in found[10:]] == [r["affected_rows"] for r in before]
