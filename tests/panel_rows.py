"""Rows for the panel tests; fixtures are in conftest.py."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"

DEFAULTS = {
    "id": 1,
    "time": 1,
    "orig_time": 1,
    "first_time": 1,
    "mat_time": 121,
    "balance_time": 100.0,
    "LTV_time": 80.0,
    "interest_rate_time": 5.0,
    "hpi_time": 100.0,
    "gdp_time": 2.0,
    "uer_time": 5.0,
    "REtype_CO_orig_time": 0,
    "REtype_PU_orig_time": 0,
    "REtype_SF_orig_time": 1,
    "investor_orig_time": 0,
    "balance_orig_time": 200.0,
    "FICO_orig_time": 700,
    "LTV_orig_time": 75.0,
    "Interest_Rate_orig_time": 5.0,
    "hpi_orig_time": 100.0,
    "default_time": 0,
    "payoff_time": 0,
    "status_time": 0,
}


def rows_of(df, *order):
    """Rows as dictionaries, in a stable order."""
    return [row.asDict() for row in (df.orderBy(*order) if order else df).collect()]
