from __future__ import annotations

import random
import struct
from dataclasses import replace

import pytest
from panel_rows import rows_of
from pyspark.sql import functions as F

from ledgerloom.functions import ordered
from ledgerloom.operators import prepare, quality
from ledgerloom.plans.reporting import REPORTS
from ledgerloom.plans.warehouse import lazy_warehouse
from ledgerloom.sources.panel import conform, schema_profile, verify_columns
from ledgerloom.spec import PanelSpec

SPEC = PanelSpec()


def test_missing_column_raises_and_extra_column_is_dropped(make_panel):
    panel = make_panel({})
    with pytest.raises(ValueError, match="balance_time"):
        verify_columns(panel.drop("balance_time"))
    assert "extra" not in conform(panel.withColumn("extra", F.lit(1))).columns


def test_schema_profile_counts_out_of_range_values(make_panel):
    panel = make_panel(
        {"status_time": 3},
        {"id": 2, "FICO_orig_time": 200, "time": 4},
        {"id": 2, "balance_time": -1.0, "FICO_orig_time": None, "status_time": None},
    )
    assert rows_of(schema_profile(panel)) == [
        {
            "rows": 3,
            "entities": 2,
            "first_period": 1,
            "last_period": 4,
            "bad_status": 1,
            "bad_score": 1,
            "negative_balance": 1,
        }
    ]


def test_dedupe_keeps_lowest_balance_with_nulls_last(make_panel):
    kept = prepare.dedupe(
        make_panel(
            {"balance_time": 90.0, "LTV_time": 1.0},
            {"balance_time": 80.0, "LTV_time": 2.0},
            {"time": 2, "balance_time": None},
            {"time": 2, "balance_time": 70.0},
            {"time": 3, "balance_time": 60.0, "LTV_time": 9.0},
            {"time": 3, "balance_time": 60.0, "LTV_time": 8.0},
            {"time": 4, "balance_time": None},
        )
    )
    got = [(r["period"], r["balance_time"], r["LTV_time"]) for r in rows_of(kept, "period")]
    assert [(p, None if b is None else float(b), v) for p, b, v in got] == [
        (1, 80.0, 2.0),
        (2, 70.0, 80.0),
        (3, 60.0, 8.0),
        (4, None, 80.0),
    ]


def test_attributes_take_the_earliest_value_and_skip_nulls(make_panel):
    attributes = prepare.entity_attributes(
        make_panel(
            {"time": 5, "orig_time": -14},
            {"time": 3, "orig_time": 18, "FICO_orig_time": None},
            {"time": 4, "orig_time": 18, "FICO_orig_time": 640},
            {"id": 2, "time": 1, "orig_time": 7, "balance_time": 50.0},
            {"id": 2, "time": 1, "orig_time": 6, "balance_time": 40.0},
            {"id": 3, "FICO_orig_time": None},
        )
    )
    got = {
        r["id"]: (r["orig_time"], r["FICO_orig_time"], r["is_inconsistent"])
        for r in attributes.collect()
    }
    # Entity 1: orig_time and score differ. Entity 2: lower balance wins.
    assert got == {1: (18, 640, True), 2: (6, 700, True), 3: (1, None, False)}


def test_dim_decodes_attributes(make_warehouse):
    w = make_warehouse(
        {"id": 1, "REtype_SF_orig_time": 1, "REtype_PU_orig_time": 1, "orig_time": 14},
        {"id": 2, "REtype_SF_orig_time": 0, "REtype_PU_orig_time": 1, "REtype_CO_orig_time": 1},
        {"id": 3, "REtype_SF_orig_time": 0, "REtype_CO_orig_time": 1, "investor_orig_time": 1},
        {"id": 4, "REtype_SF_orig_time": None, "investor_orig_time": None, "orig_time": 0},
    )
    got = [
        (
            r["property_type"],
            r["occupancy"],
            r["observed_from_origination"],
            r["focus_cohort"],
            r["original_term_quarters"],
        )
        for r in rows_of(w.dim_loan, "loan_id")
    ]
    assert got == [
        ("Single family", "Owner occupied", True, "Benign cohort", 107),
        ("Planned urban", "Owner occupied", True, None, 120),
        ("Condominium", "Investor", True, None, 120),
        ("Other / not stated", "Owner occupied", False, None, 121),
    ]


def test_gap_fill_repeats_the_last_report_and_flags_it(make_warehouse):
    w = make_warehouse(
        {"time": 1, "balance_time": 100.0, "uer_time": 3.0},
        {"time": 2, "balance_time": 90.0, "LTV_time": None},
        {"time": 5, "balance_time": None, "LTV_time": 70.0},
        {"id": 2, "time": 4, "uer_time": 9.0},
    )
    got = [
        (r["period"], r["current_balance"], r["current_ltv"], r["is_forward_filled"])
        for r in rows_of(w.fact_loan_quarter.where("loan_id = 1"), "period")
    ]
    # A reported row with a NULL measure takes the last value but is no gap.
    assert got == [
        (1, 100.0, 80.0, False),
        (2, 90.0, 80.0, False),
        (3, 90.0, 80.0, True),
        (4, 90.0, 80.0, True),
        (5, 90.0, 70.0, False),
    ]
    # Covariates belong to the period; period 3 was reported by nobody.
    macro = {
        r["period"]: r["unemployment_rate"]
        for r in w.fact_loan_quarter.where("loan_id = 1").collect()
    }
    assert macro == {1: 3.0, 2: 5.0, 3: None, 4: 9.0, 5: 5.0}
    assert w.fact.where("loan_id = 2").count() == 1


def test_rows_without_a_key_leave_the_panel(make_warehouse):
    w = make_warehouse(
        {"time": 1, "balance_time": None},
        {"time": None, "balance_time": 5.0},
        {"id": None, "time": 1},
    )
    got = [(r["loan_id"], r["period"], r["current_balance"]) for r in w.fact.collect()]
    assert got == [(1, 1, None)]


def test_link_columns_follow_fact_rows(make_warehouse):
    w = make_warehouse(
        {"time": 1, "balance_time": 100.0},
        {"time": 2, "balance_time": 90.0},
        {"time": 4, "balance_time": 95.0, "status_time": 1},
    )
    got = [
        (
            r["period"],
            None if r["prior_balance"] is None else float(r["prior_balance"]),
            r["prior_status"],
            r["moves_next"],
            r["next_status"] if r["moves_next"] else None,
            r["default_period"],
        )
        for r in rows_of(w.fact, "period")
    ]
    assert got == [
        (1, None, None, True, 0, 4),
        (2, 100.0, 0, False, None, 4),
        (3, 90.0, 0, False, None, 4),
        (4, 90.0, 0, False, None, 4),
    ]


def test_event_is_the_first_default(make_warehouse):
    w = make_warehouse(
        {"time": 1},
        {"time": 2, "status_time": 1, "balance_time": 60.0, "LTV_time": 120.0},
        {"time": 4, "status_time": 1, "balance_time": 50.0},
        {"id": 2, "time": 1, "status_time": 2},
    )
    (event,) = rows_of(w.fact_credit_event)
    assert (event["loan_id"], event["default_period"], event["exposure_at_default"]) == (1, 2, 60.0)
    assert event["ltv_band_at_default"] == "6. >100"
    assert event["quarters_on_book_at_default"] == 1


def test_dim_date_survives_a_missing_calendar(make_warehouse):
    w = make_warehouse({"time": 1}, {"time": 3}, spec=PanelSpec(calendar_anchor=None))
    assert rows_of(w.periods, "period") == [
        {"period": p, "reporting_quarter": f"P{p}", "year": None, "quarter": None}
        for p in (1, 2, 3)
    ]


def _random_rows(seed: int) -> list[dict]:
    rng = random.Random(seed)
    rows = []
    for entity in range(1, 13):
        for _ in range(rng.randint(1, 14)):
            rows.append(
                {
                    "id": entity,
                    "time": rng.randint(-6, 40),
                    "balance_time": rng.choice([None, *[float(rng.randint(1, 9)) for _ in range(4)]]),
                    "LTV_time": rng.choice([None, 50.0, 101.5]),
                    "status_time": rng.choice([None, 0, 0, 0, 1, 2]),
                    "default_time": rng.choice([None, 0, 1]),
                }
            )
    return rows


@pytest.mark.parametrize("seed", [4, 5])
def test_fact_equals_brute_force(make_warehouse, seed):
    """Gap fill and links against a plain loop over each entity's periods."""
    rows = _random_rows(seed)
    measures = ("balance_time", "LTV_time", "status_time", "default_time")
    expected = []
    for entity in sorted({r["id"] for r in rows}):
        by_time: dict[int, dict] = {}
        for r in (r for r in rows if r["id"] == entity):
            key = [(r[m] is None, r[m] or 0) for m in measures]
            best = by_time.get(r["time"])
            if best is None or key < [(best[m] is None, best[m] or 0) for m in measures]:
                by_time[r["time"]] = r
        carried = dict.fromkeys(measures)
        prior = (None, None)
        for t in range(min(by_time), max(by_time) + 1):
            if t in by_time:
                for m in measures:
                    if by_time[t][m] is not None:
                        carried[m] = by_time[t][m]
            expected.append(
                (entity, t, t not in by_time, *(carried[m] for m in measures), *prior,
                 t in by_time and t + 1 in by_time)
            )
            prior = (carried["balance_time"], carried["status_time"])
    fact = make_warehouse(*rows).fact.select(
        "loan_id",
        "period",
        "is_forward_filled",
        F.col("current_balance").cast("double"),
        "current_ltv",
        "status_code",
        "default_time",
        F.col("prior_balance").cast("double"),
        "prior_status",
        "moves_next",
    )
    assert [tuple(r) for r in fact.orderBy("loan_id", "period").collect()] == expected


def test_source_values_are_not_rounded(make_warehouse):
    w = make_warehouse(
        {"time": 1, "balance_time": -0.004, "LTV_time": 33.91009},
        {"time": 2, "balance_time": 12.345, "balance_orig_time": 0.001},
        {"time": 3, "balance_time": 12.345678901},
    )
    facts = rows_of(w.fact_loan_quarter, "period")
    assert [r["current_balance"] for r in facts] == [-0.004, 12.345, 12.345678901]
    assert facts[0]["current_ltv"] == 33.91009
    assert rows_of(w.dim_loan)[0]["original_balance"] == 200.0


def test_a_sum_that_does_not_fit_is_an_error(make_warehouse):
    w = make_warehouse({"balance_time": 1e25})
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        REPORTS["vw_portfolio_summary"](w).collect()


EDGES = [
    float("-inf"), -1.7976931348623157e308, -1e300, -1e15, -2.0, -1.0, -0.1, -1e-300, -2.3e-308, -5e-324,
    0.0, 5e-324, 1e-323, 2.2250738585072009e-308, 2.2250738585072014e-308, 1e-300, 0.1, 0.5, 0.9999999999999999, 1.0,
    1.0000000000000002, 1.9999999999999998, 2.0, 3.0, 8.0, 7.999999999999999, 12.345, 1e15, 1e22, 8.98846567431158e307,
    1e300, 1.7976931348623157e308, float("inf"),
]


def test_ranks_of_doubles_count_their_bits(spark):
    """The rank is the double's 64 bits as a signed magnitude."""
    rng = random.Random(3)
    some = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)]
    values = [v for v in [*EDGES, *some] if v == v]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    ranks = {r["i"]: r["k"] for r in df.select("i", ordered.double_rank(F.col("v")).alias("k")).collect()}
    for i, v in enumerate(values):
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert ranks[i] == (-bits if v < 0 else bits), v
    odd = spark.createDataFrame([(float("nan"),), (None,), (-0.0,)], "v double")
    assert [r[0] for r in odd.select(ordered.double_rank(F.col("v"))).collect()] == [
        (2047 << 52) + 2,
        (2047 << 52) + 4,
        0,
    ]


def test_packed_orders_sort_like_tuples(spark):
    """Any long, and any double, NaN and infinities included."""
    times = [None, -(2**63), -(2**62), -(10**10), -3, 0, 7, 10**10, 2**62, 2**63 - 1]
    balances = [*sorted(EDGES[::2]), float("nan"), None]
    rows = [(t, b) for t in times for b in balances]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t long, b double")
    packed = ordered.packed_report(F.col("t"), F.col("b"))
    got = df.select("i", packed.alias("p")).orderBy("p", "i").collect()
    assert [r["i"] for r in got] == list(range(len(rows)))
    assert len({r["p"] for r in got}) == len(rows)


def test_earliest_value_of_extreme_reports(make_panel):
    """Beyond ten digits of a period and 10**15 of a balance the order still counts."""
    w = prepare.entity_attributes(
        make_panel(
            {"id": 1, "time": 2**63 - 1, "balance_time": 1.0, "FICO_orig_time": 1},
            {"id": 1, "time": 2**63 - 2, "balance_time": 1.0, "FICO_orig_time": 2},
            {"id": 2, "time": 5, "balance_time": 1e300, "FICO_orig_time": 1},
            {"id": 2, "time": 5, "balance_time": 1e299, "FICO_orig_time": 2},
            {"id": 3, "time": 5, "balance_time": float("nan"), "FICO_orig_time": 1},
            {"id": 3, "time": 5, "balance_time": float("inf"), "FICO_orig_time": 2},
            {"id": 4, "time": 5, "balance_time": -1e16, "FICO_orig_time": 1},
            {"id": 4, "time": 5, "balance_time": -2e16, "FICO_orig_time": 2},
        )
    )
    assert [r["FICO_orig_time"] for r in rows_of(w, "id")] == [2, 2, 2, 2]


@pytest.mark.parametrize("gap", [prepare.STRETCH - 1, prepare.STRETCH, 2 * prepare.STRETCH + 1])
def test_gaps_around_a_stretch(make_warehouse, gap):
    w = make_warehouse({"time": 3, "balance_time": 1.0}, {"time": 4 + gap, "balance_time": 2.0})
    found = rows_of(w.fact.select("period", "is_forward_filled", "gap_periods", "current_balance"), "period")
    assert [r["period"] for r in found] == list(range(3, 5 + gap))
    assert [r["is_forward_filled"] for r in found] == [False, *[True] * gap, False]
    assert [r["gap_periods"] for r in found] == [gap, *[None] * gap, 0]
    assert [r["current_balance"] for r in found] == [*[1.0] * (gap + 1), 2.0]


def test_a_gap_of_five_million_periods(make_panel):
    """No array holds more than a stretch and the starts of stretches."""
    n = 5_000_000
    linked = prepare.linked_rows(prepare.dedupe(make_panel({"time": 1}, {"time": n + 2}, {"id": 2, "time": 1})))
    filled = prepare.gap_filled(linked)
    assert filled.agg(F.count("*"), F.sum("period"), F.count_if("is_forward_filled")).first()[:] == (
        n + 3,
        (n + 2) * (n + 3) // 2 + 1,
        n,
    )


def test_a_gap_before_the_last_possible_period(make_panel):
    last = 2**63 - 1
    linked = prepare.linked_rows(prepare.dedupe(make_panel({"time": last - 5000}, {"time": last})))
    assert prepare.gap_filled(linked).agg(F.count("*"), F.max("period")).first()[:] == (5001, last)


def test_long_gaps_are_a_finding_and_stay_filled(make_warehouse):
    spec = replace(PanelSpec(), long_gap=3)
    w = make_warehouse(
        {"id": 1, "time": 1}, {"id": 1, "time": 5}, {"id": 1, "time": 10}, {"id": 2, "time": 1}, {"id": 2, "time": 99},
        spec=spec,
    )
    finding = quality.long_gap_finding(w.fact, spec).first().asDict()
    assert finding == {
        "rule_name": "implausible_panel_gap",
        "severity": "MEDIUM",
        "status": "FAIL",
        "affected_rows": 2,
        "detail": "Gaps of more than 3 periods; filled like any other",
    }
    assert w.fact.where("loan_id = 2").count() == 99
