from __future__ import annotations

import datetime
import os

import pytest
from panel_rows import DEFAULTS, rows_of
from pyspark.sql import functions as F

from ledgerloom.operators import quality
from ledgerloom.plans.cycle import run_cycle
from ledgerloom.sources import landing, sinks
from ledgerloom.spec import PANEL_SCHEMA, PanelSpec

NAMES = PANEL_SCHEMA.names


def write_csv(folder, *rows, names=NAMES, name="a.csv"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(",".join(names) + "\n")
        for row in rows:
            f.write((row if isinstance(row, str) else line(row, names)) + "\n")
    return str(folder)


def line(row, names=NAMES):
    values = {**DEFAULTS, **row}
    return ",".join("" if values[c] is None else str(values[c]) for c in names)


def problems(landed):
    return sorted((r["id"], r["column_name"], r["value"], r["reason"]) for r in landed.rejected.collect())


@pytest.mark.parametrize(
    ("column", "value", "reason"),
    [
        ("time", "3.5", landing.NOT_WHOLE),
        ("time", "1e-3", landing.NOT_WHOLE),
        ("time", "9223372036854775808", landing.OUT_OF_RANGE),
        ("time", "-1e40", landing.OUT_OF_RANGE),
        ("time", "two", landing.NOT_A_NUMBER),
        ("status_time", "NaN", landing.NOT_A_NUMBER),
        ("balance_time", "n/a", landing.NOT_A_NUMBER),
        ("balance_time", "1,5", landing.MALFORMED),
        ("balance_time", '"1,5"', landing.NOT_A_NUMBER),
        ("balance_time", "5d", landing.NOT_A_NUMBER),
        ("balance_time", "Infinity", landing.NOT_A_NUMBER),
        ("balance_time", "1e999", landing.OUT_OF_RANGE),
        ("balance_time", "0x10", landing.NOT_A_NUMBER),
    ],
)
def test_reasons(spark, tmp_path, column, value, reason):
    source = write_csv(tmp_path / "in", {"id": 1}, {"id": 2, column: value}, {"id": 3})
    landed = landing.land_csv(spark, source, f"{tmp_path}/out")
    assert [r["id"] for r in rows_of(landed.accepted, "id")] == [1, 3]
    expected = (None, None) if reason == landing.MALFORMED else (column, value.strip('"'))
    assert problems(landed) == [("2", *expected, reason)]
    assert landed.counts["rows"] == landed.counts["rows_read"] == 3
    assert landed.counts["rows_rejected"] == 1
    assert landed.counts[f"cells_{reason.replace(' ', '_')}"] == 1


@pytest.mark.parametrize(
    ("column", "text", "value"),
    [
        ("time", " 3 ", 3),
        ("time", "3.0", 3),
        ("time", "3e2", 300),
        ("time", "+7", 7),
        ("time", "9223372036854775807", 2**63 - 1),
        ("time", "-9223372036854775808", -(2**63)),
        ("time", "  ", None),
        ("balance_time", ".5", 0.5),
        ("balance_time", "1E3", 1000.0),
        ("balance_time", "", None),
    ],
)
def test_cells_that_fit(spark, tmp_path, column, text, value):
    landed = landing.land_csv(spark, write_csv(tmp_path / "in", {column: text}), f"{tmp_path}/out")
    assert rows_of(landed.accepted) == [{**DEFAULTS, column: value}]
    assert problems(landed) == [] and landed.counts["rows_rejected"] == 0


def test_every_bad_cell_of_a_row_is_reported(spark, tmp_path):
    source = write_csv(tmp_path / "in", {"id": 8, "time": "x", "balance_time": "y", "FICO_orig_time": "1.5"})
    landed = landing.land_csv(spark, source, f"{tmp_path}/out")
    assert problems(landed) == [
        ("8", "FICO_orig_time", "1.5", landing.NOT_WHOLE),
        ("8", "balance_time", "y", landing.NOT_A_NUMBER),
        ("8", "time", "x", landing.NOT_A_NUMBER),
    ]
    assert landed.counts["rows_rejected"] == 1 and landed.counts["cells_not_a_number"] == 2


def test_malformed_records_keep_their_line_and_file(spark, tmp_path):
    short, long = line({"id": 5}).rsplit(",", 3)[0], line({"id": 6}) + ",9"
    source = write_csv(tmp_path / "in", {"id": 4}, short, long)
    landed = landing.land_csv(spark, source, f"{tmp_path}/out")
    found = {r["record"]: r for r in landed.rejected.collect()}
    assert set(found) == {short, long}
    assert {r["reason"] for r in found.values()} == {landing.MALFORMED}
    assert all(r["file"].endswith("/in/a.csv") for r in found.values())
    assert [r["id"] for r in rows_of(landed.accepted)] == [4]


def test_columns_are_taken_by_name_and_others_dropped(spark, tmp_path):
    names = [*reversed(NAMES), "remark"]
    source = write_csv(tmp_path / "in", {"id": 3, "remark": "no number"}, names=names)
    landed = landing.land_csv(spark, source, f"{tmp_path}/out")
    assert landed.accepted.columns == NAMES
    assert rows_of(landed.accepted) == [{**DEFAULTS, "id": 3}] and problems(landed) == []


def test_sources_that_cannot_be_named_are_errors(spark, tmp_path):
    lacking = write_csv(tmp_path / "lacking", {"id": 1}, names=NAMES[1:])
    with pytest.raises(ValueError, match="id"):
        landing.land_csv(spark, lacking, f"{tmp_path}/out1")
    mixed = write_csv(tmp_path / "mixed", {"id": 1})
    write_csv(tmp_path / "mixed", {"id": 2}, names=list(reversed(NAMES)), name="b.csv")
    with pytest.raises(Exception, match="header"):
        landing.land_csv(spark, mixed, f"{tmp_path}/out2")


@pytest.mark.parametrize(
    ("column", "text", "value"),
    [
        ("time", "999999999999999999", 10**18 - 1),
        ("time", "0000000000000000000007", 7),
        ("time", "-1000000000000000000", -(10**18)),
        ("time", " -12 ", -12),
        ("balance_time", " 1.25e-99 ", 1.25e-99),
        ("balance_time", "123456789012345678901234567890", 123456789012345678901234567890.0),
        ("balance_time", "1e308", 1e308),
        ("balance_time", "7.", 7.0),
    ],
)
def test_cells_beyond_the_plain_patterns(spark, tmp_path, column, text, value):
    landed = landing.land_csv(spark, write_csv(tmp_path / "in", {column: text}), f"{tmp_path}/out")
    assert rows_of(landed.accepted) == [{**DEFAULTS, column: value}] and problems(landed) == []


@pytest.mark.parametrize("text", ["\t5", "5\t", "5 x", "+", "1e", "5L"])
def test_cells_that_only_a_cast_would_take(spark, tmp_path, text):
    for column in ("time", "balance_time"):
        source = write_csv(tmp_path / column, {"id": 2, column: text})
        landed = landing.land_csv(spark, source, f"{tmp_path}/out-{column}")
        assert problems(landed) == [("2", column, text, landing.NOT_A_NUMBER)]


def test_reasons_are_sought_only_for_cells_without_a_value(spark):
    raw = spark.range(1).select(*[F.lit("1").alias(c) for c in [*NAMES, "_record", "_file"]])
    plan = landing.judged(raw)._jdf.queryExecution().analyzed().toString()
    problems_line = next(x for x in plan.splitlines() if "filter(array(" in x)
    guards = [f"WHEN (isnull(_value_{c}#" for c in NAMES]
    assert all(guard in problems_line for guard in guards)


def test_the_landing_runs_as_compiled_methods(spark, tmp_path, monkeypatch):
    limits = []

    def noted(*args):
        limits.append(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))
        return sinks.counted(*args)

    monkeypatch.setattr(landing, "counted", noted)
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    landing.land_csv(spark, write_csv(tmp_path / "in", {"id": 1}), f"{tmp_path}/out")
    assert limits == ["8000"] and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_an_empty_source(spark, tmp_path):
    landed = landing.land_csv(spark, write_csv(tmp_path / "in"), f"{tmp_path}/out")
    assert landed.accepted.count() == landed.rejected.count() == 0
    assert set(landed.counts.values()) == {0}


def test_a_landing_can_be_read_again(spark, tmp_path):
    source = write_csv(tmp_path / "in", {"id": 1}, {"id": 2, "time": "x"})
    landed = landing.land_csv(spark, source, f"{tmp_path}/out")
    accepted, rejected = landing.read_landing(spark, f"{tmp_path}/out")
    assert rows_of(accepted) == rows_of(landed.accepted)
    assert rows_of(rejected) == rows_of(landed.rejected)


def test_rejected_rows_enter_the_register(spark, tmp_path):
    source = write_csv(
        tmp_path / "in",
        *[{"id": i, "time": t} for i in (1, 2) for t in (1, 2, 3)],
        {"id": 3, "time": "x", "balance_time": "y"},
        {"id": 3, "time": "2.5"},
        line({"id": 3}) + ",",
    )
    landed = landing.land_csv(spark, source, f"{tmp_path}/landed")
    run_cycle(landed, PanelSpec(), f"{tmp_path}/out", datetime.datetime(2024, 1, 31))
    register = sinks.read_register(spark, f"{tmp_path}/out/dq_results")
    row = register.where("rule_name = 'rejected_source_row'").first()
    assert (row["phase"], row["severity"], row["status"], row["affected_rows"]) == ("1-ingest", "HIGH", "FAIL", 3)
    assert row["detail"] == (
        "Source rows left out: 1 malformed record, 2 not a number, 1 not a whole number, 0 out of range"
    )
    assert quality.latest_run(register, "1-ingest").count() == 5
    assert sinks.read_register(spark, f"{tmp_path}/out/dq_results").count() == 15
    exported = f"{tmp_path}/out/run=20240131T000000/export/rejected_source_rows"
    back = spark.read.option("header", True).csv(exported)
    assert back.count() == 4
