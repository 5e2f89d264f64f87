from __future__ import annotations

from panel_rows import rows_of

from ledgerloom.operators import insights, profiling
from ledgerloom.spec import PanelSpec


def test_missing_values_cover_every_column(make_panel):
    found = {
        r["column_name"]: (r["data_type"], r["missing"])
        for r in profiling.missing_values(
            make_panel({"LTV_time": None}, {"LTV_time": None, "FICO_orig_time": None})
        ).collect()
    }
    assert len(found) == 23
    assert found["LTV_time"] == ("double", 2)
    assert found["FICO_orig_time"] == ("bigint", 1)
    assert found["id"] == ("bigint", 0)


def test_common_terms_break_ties_by_term(make_panel):
    panel = make_panel(
        {"mat_time": 121}, {"mat_time": 121}, {"mat_time": 61}, {"mat_time": 81}, {"mat_time": None}
    )
    terms = profiling.common_terms(panel, top=2).collect()
    assert [(r["term"], r["rows"]) for r in terms] == [(120, 2), (60, 1)]


def test_final_status_ignores_later_nulls(make_panel):
    panel = make_panel(
        {"id": 1, "time": 1, "status_time": 1},
        {"id": 1, "time": 2, "status_time": None},
        {"id": 2, "time": 2, "status_time": 2},
        {"id": 2, "time": 1, "status_time": 0},
        {"id": 3},
    )
    got = rows_of(profiling.final_status(panel), "final_status")
    assert [(r["final_status"], r["entities"], r["pct_of_entities"]) for r in got] == [
        (0, 1, 33.3),
        (1, 1, 33.3),
        (2, 1, 33.3),
    ]


def test_peaks_take_the_earliest_period(make_panel):
    panel = make_panel(
        {"time": 1, "uer_time": 4.0, "hpi_time": 9.0},
        {"time": 2, "uer_time": 6.0, "hpi_time": 8.0},
        {"time": 3, "uer_time": 6.0, "hpi_time": 7.0},
    )
    got = {r["measure"]: (r["peak_period"], r["peak_value"]) for r in profiling.macro_peaks(panel).collect()}
    assert got["unemployment_rate"] == (2, 6.0)
    assert got["house_price_index"] == (1, 9.0)


def test_duplicates_and_gaps_count_raw_rows(make_panel):
    panel = make_panel(
        {"id": 1, "time": 1},
        {"id": 1, "time": 1},
        {"id": 2, "time": 1},
        {"id": 2, "time": 3},
        {"id": 3, "time": 1},
        {"id": 4, "time": 1},
        {"id": 4, "time": 1},
        {"id": 4, "time": 3},
    )
    # Entity 4: a copy hides its gap, since rows are compared with the span.
    assert rows_of(profiling.duplicates_and_gaps(panel)) == [
        {"duplicate_rows": 2, "entities_with_gaps": 2}
    ]


def test_default_by_vintage_needs_enough_entities(make_panel):
    panel = make_panel(
        {"id": 1, "orig_time": 3, "status_time": 1},
        {"id": 2, "orig_time": 3},
        {"id": 3, "orig_time": 4},
        {"id": 4, "orig_time": 0},
    )
    got = rows_of(profiling.default_by_vintage(panel, min_entities=2))
    assert got == [{"orig_time": 3, "entities": 2, "default_pct": 50.0}]


def test_segment_mix_filter_touches_one_dimension(small):
    segments = small.report("vw_segment_performance")
    mix = insights.segment_mix(segments, period=9, score_bands=["1. <620"])
    scores = mix.where("segment_type = 'Credit score band'").collect()
    assert [r["segment_value"] for r in scores] == ["1. <620"]
    others = "period = 9 and segment_type <> 'Credit score band'"
    assert mix.where(others).count() == segments.where(others).count()


def test_headline_of_a_chosen_period(small):
    summary, movement = small.report("vw_portfolio_summary"), small.report("vw_provision_movement")
    assert [r["period"] for r in insights.headline(summary, movement, 3).collect()] == [3]
    assert [r["period"] for r in insights.headline(summary, movement).collect()] == [28]


def test_focus_vintage_labels():
    assert insights.focus_vintages(PanelSpec()) == ["2003Q3", "2006Q4"]
    assert insights.focus_vintages(PanelSpec(calendar_anchor=None)) == ["P14", "P27"]


def test_ends_of_extreme_periods_and_values(make_panel):
    """Any long keeps its order as a period and its value as a status; a missing period is first."""
    panel = make_panel(
        {"id": 1, "time": 2**63 - 1, "orig_time": 5, "status_time": 2**62},
        {"id": 1, "time": 2**63 - 2, "orig_time": -(2**63), "status_time": 1},
        {"id": 2, "time": -(2**63), "orig_time": 7, "status_time": 1},
        {"id": 2, "time": None, "orig_time": 8, "status_time": 2},
        {"id": 3, "time": 4, "orig_time": 9, "status_time": 1},
        {"id": 3, "time": 4, "orig_time": 3, "status_time": 2},
        {"id": 3, "time": 5, "orig_time": None, "status_time": None},
    )
    ends = rows_of(profiling._entity_ends(panel), "id")
    assert [(r["orig_time"], r["final_status"]) for r in ends] == [(-(2**63), 2**62), (8, 1), (3, 2)]
