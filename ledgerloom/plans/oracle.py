"""The registered queries as DuckDB SQL, for checking results.

Written apart from the Spark operators and, where there is a choice, by another
route: gaps are filled column by column over a spine, transitions come from a
self-join, segments from grouping sets, probabilities from entity joins.
"""

from __future__ import annotations

import re

from ledgerloom.operators.prepare import ATTRIBUTES
from ledgerloom.spec import INGEST_SEVERITY, LTV_BANDS, PANEL_SCHEMA, RULE_SEVERITY, SCORE_BANDS

# Numbers such as 1e2 and 3e-1 are DOUBLE literals in DuckDB; 100.0 and 0.3 would be DECIMAL.


def _band(value: str, bands) -> str:
    arms = " ".join(f"WHEN {value} >= {a} AND {value} <= {b} THEN '{n}'" for a, b, n in bands)
    return f"CASE {arms} ELSE '9. Unknown' END"


def _quarter(period: str) -> str:
    return f"concat((7979 + {period}) // 4, 'Q', (7979 + {period}) % 4 + 1)"


def _bucket(code: str) -> str:
    return (
        f"CASE {code} WHEN 0 THEN '1. Active' WHEN 1 THEN '2. Default' "
        f"WHEN 2 THEN '3. Payoff' ELSE '9. Unknown' END"
    )


def _round(value: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"round(({value}) * {scale}) / {scale}"


def _pct(part: str, total: str) -> str:
    return f"1e2 * CAST({part} AS DOUBLE) / nullif(CAST({total} AS DOUBLE), 0)"


def _money(value: str) -> str:
    arms = " ".join(
        f"WHEN abs({value}) >= {size} THEN '$' || printf('%.2f', ({value}) / {size}) || '{unit}'"
        for unit, size in (("bn", "1e9"), ("m", "1e6"), ("k", "1e3"))
    )
    return f"CASE WHEN {value} IS NULL THEN 'n/a' {arms} ELSE '$' || printf('%.0f', {value}) END"


BASE = {
    "shipped": """
  SELECT customer * 64 + CASE WHEN t < 1 + customer % 12 THEN 0
           ELSE 1 + (t - 1 - customer % 12) // (5 + customer % 20) END AS id,
         t, l_linenumber, l_extendedprice, l_discount, l_tax, c_nationkey, c_mktsegment
  FROM (SELECT *, o_custkey AS customer,
               CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS BIGINT) AS t
        FROM lineitem, orders, customer
        WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey)""",
    "presence": "SELECT id, min(t) AS mn, max(t) AS mx FROM shipped GROUP BY id",
    "placed": """
  SELECT *, mn - id % 5 AS start_t, 4e1 + (id * 37 % 800) / 1e1 AS ltv0,
         3e0 + (id % 40) / 1e1 AS rate0,
         CASE WHEN (id + t * 5) % 103 = 0 THEN NULL
              WHEN (id + t * 11) % 307 = 0 THEN 7
              WHEN id % 41 = 0 AND t = mn + 1 THEN 1
              WHEN t < mx OR id % 10 >= 7 THEN 0 WHEN id % 10 < 3 THEN 1 ELSE 2 END AS st
  FROM shipped JOIN presence USING (id)""",
    "panel": """
  SELECT id, t AS "time",
         start_t + CASE WHEN id % 50 = 0 AND l_linenumber >= 4 THEN 1 ELSE 0 END AS orig_time,
         mn AS first_time, start_t + 120 AS mat_time,
         CASE WHEN (id + t) % 97 = 0 THEN NULL WHEN (id * 7 + t) % 211 = 0 THEN -4e-3
              WHEN id % 25 = 0 THEN 5e4 + id % 1000
              ELSE l_extendedprice + l_linenumber / 1e3 END AS balance_time,
         CASE WHEN (id + t * 2) % 89 <> 0
              THEN ltv0 * (7e-1 + l_discount * 6e0) + (id % 7) / 1e5 END AS LTV_time,
         CASE WHEN (id + t * 3) % 101 <> 0 THEN rate0 + l_tax * 1e1 END AS interest_rate_time,
         1e2 + 3e0 * t - 1e-1 * t * t AS hpi_time,
         2e0 - (t % 5) * 3e-1 AS gdp_time,
         4e0 + (t % 7) * 5e-1 AS uer_time,
         CAST(c_mktsegment = 'MACHINERY' AS BIGINT) AS REtype_CO_orig_time,
         CAST(c_mktsegment = 'HOUSEHOLD' AS BIGINT) AS REtype_PU_orig_time,
         CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS REtype_SF_orig_time,
         CAST(c_nationkey % 5 = 0 AS BIGINT) AS investor_orig_time,
         CASE WHEN t <= mn OR id % 5 <> 0 OR l_linenumber <> 3
              THEN CAST(100000 + id * 7919 % 400000 AS DOUBLE) END AS balance_orig_time,
         CASE WHEN id % 29 = 0 OR id % 23 = 0 AND l_linenumber = 1 THEN NULL
              WHEN id % 61 = 0 THEN 950 ELSE 500 + id * 53 % 350 END AS FICO_orig_time,
         CASE WHEN id % 31 <> 0 THEN ltv0 END AS LTV_orig_time,
         CASE WHEN id % 37 <> 0 OR l_linenumber <> 2 THEN rate0 END AS Interest_Rate_orig_time,
         1e2 + 3e0 * start_t - 1e-1 * start_t * start_t AS hpi_orig_time,
         CAST(st = 1 AS BIGINT) AS default_time, CAST(st = 2 AS BIGINT) AS payoff_time,
         CAST(st AS BIGINT) AS status_time
  FROM placed""",
    # --- the panel through CSV with unreadable cells ---
    "spoilt": """
  SELECT *, (id * 13 + "time") % 157 = 0 AS cut, (id + "time") % 131 = 0 AS no_balance,
         (id * 3 + "time") % 137 = 0 AS no_score, (id * 5 + "time") % 139 = 0 AS half_period,
         (id * 7 + "time") % 149 = 0 AS vast_ltv, (id * 11 + "time") % 151 = 0 AS vast_id
  FROM panel""",
    "judged": """
  SELECT *, cut OR no_balance OR no_score OR half_period OR vast_ltv OR vast_id AS is_out,
         if(vast_id, '9223372036854775808', id::VARCHAR) AS id_text,
         "time" || if(half_period, '.5', '') AS time_text
  FROM spoilt""",
    "refused": """
  SELECT id_text, time_text, NULL AS column_name, NULL AS value, 'malformed record' AS reason
  FROM judged WHERE cut
  UNION ALL SELECT id_text, time_text, 'balance_time', 'n/a', 'not a number'
  FROM judged WHERE no_balance AND NOT cut
  UNION ALL SELECT id_text, time_text, 'FICO_orig_time', '7oo', 'not a number'
  FROM judged WHERE no_score AND NOT cut
  UNION ALL SELECT id_text, time_text, 'time', time_text, 'not a whole number'
  FROM judged WHERE half_period AND NOT cut
  UNION ALL SELECT id_text, time_text, 'LTV_time', '1e999', 'out of range'
  FROM judged WHERE vast_ltv AND NOT cut
  UNION ALL SELECT id_text, time_text, 'id', id_text, 'out of range'
  FROM judged WHERE vast_id AND NOT cut""",
    "kept": """
  SELECT DISTINCT ON (id, "time") id AS loan_id, "time" AS period,
         balance_time AS balance, LTV_time AS ltv,
         interest_rate_time AS rate, status_time AS status, default_time, payoff_time
  FROM panel
  ORDER BY id, "time", balance_time NULLS LAST, LTV_time NULLS LAST,
           interest_rate_time NULLS LAST, status_time NULLS LAST""",
    "earliest": """
  SELECT id, """
    + ", ".join(
        f'first({c} ORDER BY "time", balance_time NULLS LAST, {c}) '
        f"FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ATTRIBUTES
    )
    + """,
         count(DISTINCT orig_time) > 1 OR count(DISTINCT FICO_orig_time) > 1
           OR count(DISTINCT LTV_orig_time) > 1 OR count(DISTINCT balance_orig_time) > 1
           AS is_inconsistent
  FROM panel GROUP BY id""",
    "loan": f"""
  SELECT id AS loan_id, orig_time, first_time, mat_time,
         mat_time - orig_time AS original_term_quarters,
         {_quarter("orig_time")} AS origination_vintage,
         FICO_orig_time AS credit_score, LTV_orig_time AS original_ltv,
         balance_orig_time AS original_balance,
         Interest_Rate_orig_time AS original_interest_rate,
         if(REtype_SF_orig_time = 1, 'Single family',
            if(REtype_PU_orig_time = 1, 'Planned urban',
               if(REtype_CO_orig_time = 1, 'Condominium', 'Other / not stated'))) AS property_type,
         if(investor_orig_time = 1, 'Investor', 'Owner occupied') AS occupancy,
         {_band("FICO_orig_time", SCORE_BANDS)} AS credit_score_band,
         {_band("CAST(LTV_orig_time AS INTEGER)", LTV_BANDS)} AS ltv_band,
         orig_time >= 1 AS observed_from_origination,
         CASE orig_time WHEN 2 THEN 'Benign cohort' WHEN 8 THEN 'Stressed cohort' END
           AS focus_cohort,
         is_inconsistent
  FROM earliest""",
    "macro": """
  SELECT "time" AS period, max(hpi_time) AS house_price_index, max(gdp_time) AS gdp_growth,
         max(uer_time) AS unemployment_rate
  FROM panel GROUP BY "time" """,
    "spine": """
  SELECT loan_id, unnest(range(min(period), max(period) + 1)) AS period
  FROM kept GROUP BY loan_id""",
    "filled": """
  SELECT spine.loan_id, spine.period, kept.period IS NULL AS is_forward_filled, """
    + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER w AS {c}"
        for c in ("balance", "ltv", "rate", "status", "default_time", "payoff_time")
    )
    + """
  FROM spine LEFT JOIN kept ON spine.loan_id = kept.loan_id AND spine.period = kept.period
  WINDOW w AS (PARTITION BY spine.loan_id ORDER BY spine.period ROWS UNBOUNDED PRECEDING)""",
    "fact": f"""
  SELECT loan_id, period, {_quarter("period")} AS reporting_quarter,
         period - orig_time AS quarters_on_book, balance AS current_balance,
         ltv AS current_ltv, {_band("CAST(ltv AS INTEGER)", LTV_BANDS)} AS current_ltv_band,
         rate AS current_interest_rate, status AS status_code,
         {_bucket("status")} AS status_bucket, default_time, payoff_time, is_forward_filled,
         house_price_index, gdp_growth, unemployment_rate, origination_vintage,
         credit_score_band, ltv_band, property_type, occupancy, focus_cohort,
         observed_from_origination
  FROM filled JOIN loan USING (loan_id) LEFT JOIN macro USING (period)""",
    "event": """
  SELECT f.loan_id, f.period AS default_period, f.reporting_quarter AS default_quarter,
         f.quarters_on_book AS quarters_on_book_at_default,
         f.current_balance AS exposure_at_default, f.current_ltv AS ltv_at_default,
         f.current_ltv_band AS ltv_band_at_default, l.original_balance, l.credit_score,
         l.credit_score_band, l.ltv_band, l.origination_vintage, l.property_type, l.occupancy,
         l.focus_cohort, f.house_price_index, f.unemployment_rate
  FROM fact f JOIN loan l USING (loan_id)
  WHERE f.status_code = 1
    AND NOT EXISTS (SELECT 1 FROM fact e WHERE e.loan_id = f.loan_id AND e.status_code = 1
                    AND e.period < f.period)""",
    "dates": f"""
  SELECT DISTINCT period, reporting_quarter,
         CAST((7979 + period) // 4 AS INTEGER) AS year,
         CAST((7979 + period) % 4 + 1 AS INTEGER) AS quarter
  FROM fact""",
    # --- reports ---
    "sized": """
  SELECT period, reporting_quarter,
         CAST(sum(CASE WHEN status_code = 0 THEN current_balance::DECIMAL(28,4) END) AS DOUBLE) AS active_balance,
         count(CASE WHEN status_code = 0 THEN 1 END) AS active_loans,
         count(CASE WHEN status_code = 1 THEN 1 END) AS defaults,
         CAST(sum(CASE WHEN status_code = 1 THEN current_balance::DECIMAL(28,4) END) AS DOUBLE)
           AS defaulted_balance,
         count(CASE WHEN status_code = 2 THEN 1 END) AS payoffs,
         CAST(sum(CASE WHEN status_code = 2 THEN current_balance::DECIMAL(28,4) END) AS DOUBLE)
           AS paid_off_balance,
         count(CASE WHEN is_forward_filled THEN 1 END) AS forward_filled_rows,
         max(unemployment_rate) AS unemployment_rate, max(house_price_index) AS house_price_index
  FROM fact GROUP BY ALL""",
    "sized_prior": """
  SELECT *, lag(active_balance) OVER w AS prior_active_balance, lag(active_loans) OVER w AS pl
  FROM sized WINDOW w AS (ORDER BY period)""",
    "summary": f"""
  SELECT period, reporting_quarter, active_balance, active_loans,
         active_balance / nullif(active_loans, 0) AS average_balance, defaults,
         defaulted_balance, payoffs, paid_off_balance, forward_filled_rows, unemployment_rate,
         house_price_index, prior_active_balance,
         active_balance - prior_active_balance AS balance_movement,
         1e2 * (active_balance / nullif(prior_active_balance, 0) - 1) AS balance_growth_pct,
         {_pct("defaults", "pl")} AS quarterly_default_rate_pct
  FROM sized_prior""",
    "cells": """
  SELECT CASE WHEN GROUPING(credit_score_band) = 0 THEN 'Credit score band'
              WHEN GROUPING(ltv_band) = 0 THEN 'LTV band (at origination)'
              WHEN GROUPING(property_type) = 0 THEN 'Property type'
              WHEN GROUPING(occupancy) = 0 THEN 'Occupancy'
              ELSE 'Origination vintage' END AS segment_type,
         coalesce(credit_score_band, ltv_band, property_type, occupancy, origination_vintage)
           AS segment_value,
         period, reporting_quarter,
         sum(CASE WHEN status_code = 0 THEN current_balance::DECIMAL(28,4) END) AS active_exact,
         count(CASE WHEN status_code = 0 THEN 1 END) AS active_loans,
         count(CASE WHEN status_code = 1 THEN 1 END) AS defaults,
         CAST(sum(CASE WHEN status_code = 1 THEN current_balance::DECIMAL(28,4) END) AS DOUBLE)
           AS defaulted_balance
  FROM fact
  GROUP BY GROUPING SETS ((period, reporting_quarter, credit_score_band),
    (period, reporting_quarter, ltv_band), (period, reporting_quarter, property_type),
    (period, reporting_quarter, occupancy), (period, reporting_quarter, origination_vintage))""",
    "cells_prior": """
  SELECT *, CAST(active_exact AS DOUBLE) AS active_balance,
         CAST(sum(active_exact) OVER (PARTITION BY segment_type, period) AS DOUBLE) AS whole,
         lag(CAST(active_exact AS DOUBLE)) OVER w AS prior_active_balance,
         lag(active_loans) OVER w AS pl
  FROM cells WINDOW w AS (PARTITION BY segment_type, segment_value ORDER BY period)""",
    "segments": f"""
  SELECT segment_type, segment_value, period, reporting_quarter, active_balance, active_loans,
         defaults, defaulted_balance, active_balance / nullif(active_loans, 0) AS average_balance,
         {_pct("active_balance", "whole")} AS pct_of_portfolio_balance, prior_active_balance,
         1e2 * (active_balance / nullif(prior_active_balance, 0) - 1) AS balance_growth_pct,
         {_pct("defaults", "pl")} AS quarterly_default_rate_pct
  FROM cells_prior""",
    "mixed": """
  SELECT CASE WHEN GROUPING(credit_score_band) = 0 THEN 'Credit score band'
              WHEN GROUPING(ltv_band) = 0 THEN 'LTV band (at origination)'
              WHEN GROUPING(origination_vintage) = 0 THEN 'Origination vintage'
              ELSE 'Portfolio' END AS segment_type,
         coalesce(credit_score_band, ltv_band, origination_vintage, 'Total') AS segment_value,
         period, reporting_quarter, status_bucket, count(*) AS loans,
         sum(current_balance::DECIMAL(28,4)) AS exact
  FROM fact
  GROUP BY GROUPING SETS ((period, reporting_quarter, status_bucket),
    (period, reporting_quarter, status_bucket, credit_score_band),
    (period, reporting_quarter, status_bucket, ltv_band),
    (period, reporting_quarter, status_bucket, origination_vintage))""",
    "mix": f"""
  SELECT segment_type, segment_value, period, reporting_quarter, status_bucket, loans,
         CAST(exact AS DOUBLE) AS balance,
         {_pct("loans", "sum(loans) OVER w")} AS pct_of_segment_loans,
         {_pct("exact", "sum(exact) OVER w")} AS pct_of_segment_balance
  FROM mixed WINDOW w AS (PARTITION BY segment_type, segment_value, period)""",
    "moves": """
  SELECT a.period AS from_period, a.reporting_quarter AS from_quarter,
         a.status_bucket AS from_status, b.status_bucket AS to_status,
         count(*) AS loans_moved, sum(a.current_balance::DECIMAL(28,4)) AS exact
  FROM fact a JOIN fact b ON a.loan_id = b.loan_id AND b.period - a.period = 1
  WHERE NOT (a.is_forward_filled OR b.is_forward_filled) GROUP BY ALL""",
    "rolls": f"""
  SELECT from_period, from_quarter, from_status, to_status, loans_moved,
         CAST(exact AS DOUBLE) AS balance_moved,
         {_pct("loans_moved", "sum(loans_moved) OVER w")} AS roll_rate_pct_by_count,
         {_pct("exact", "sum(exact) OVER w")} AS roll_rate_pct_by_balance
  FROM moves WINDOW w AS (PARTITION BY from_period, from_status)""",
    "cohort": """
  SELECT origination_vintage, count(*) AS cohort_loans, sum(original_balance::DECIMAL(28,4)) AS lent
  FROM loan WHERE observed_from_origination GROUP BY ALL""",
    "aged": """
  SELECT origination_vintage, f.quarters_on_book, count(DISTINCT f.loan_id) AS loans_observed,
         count(DISTINCT CASE WHEN f.period = e.default_period THEN f.loan_id END) AS failed,
         sum(CASE WHEN f.period = e.default_period THEN e.original_balance::DECIMAL(28,4) ELSE 0 END) AS lost
  FROM fact f LEFT JOIN (SELECT loan_id, default_period, original_balance FROM event) e
    USING (loan_id)
  WHERE observed_from_origination AND f.quarters_on_book >= 0 GROUP BY ALL""",
    "curves": f"""
  SELECT origination_vintage, quarters_on_book, cohort_loans,
         CAST(lent AS DOUBLE) AS cohort_original_balance, loans_observed,
         {_pct("loans_observed", "cohort_loans")} AS pct_cohort_still_observed,
         failed AS defaults_in_quarter,
         CAST(sum(failed) OVER w AS BIGINT) AS cumulative_defaults,
         {_pct("sum(failed) OVER w", "cohort_loans")} AS cumulative_default_rate_pct,
         {_pct("sum(lost) OVER w", "lent")} AS cumulative_default_rate_by_balance_pct
  FROM aged JOIN cohort USING (origination_vintage)
  WINDOW w AS (PARTITION BY origination_vintage ORDER BY quarters_on_book
               ROWS UNBOUNDED PRECEDING)""",
    "losses": f"""
  SELECT CASE WHEN GROUPING(credit_score_band) = 0 THEN 'Credit score band'
              WHEN GROUPING(ltv_band) = 0 THEN 'LTV band (at origination)'
              WHEN GROUPING(property_type) = 0 THEN 'Property type'
              WHEN GROUPING(occupancy) = 0 THEN 'Occupancy'
              WHEN GROUPING(origination_vintage) = 0 THEN 'Origination vintage'
              ELSE 'Portfolio' END AS segment_type,
         coalesce(credit_score_band, ltv_band, property_type, occupancy, origination_vintage,
                  'Total') AS segment_value,
         count(*) AS defaults,
         CAST(sum(exposure_at_default::DECIMAL(28,4)) AS DOUBLE) AS total_exposure_at_default,
         CAST(sum(exposure_at_default::DECIMAL(28,4)) AS DOUBLE) / count(exposure_at_default)
           AS avg_exposure_at_default,
         CAST(sum(CAST(ltv_at_default AS DECIMAL(28,6))) AS DOUBLE) / count(ltv_at_default)
           AS avg_ltv_at_default,
         {_pct("count(CASE WHEN ltv_at_default > 100 THEN 1 END)", "count(*)")}
           AS pct_underwater_at_default,
         CAST(sum(quarters_on_book_at_default) AS DOUBLE) / count(quarters_on_book_at_default)
           AS avg_quarters_on_book_at_default,
         {_pct("sum(exposure_at_default::DECIMAL(28,4))", "sum(original_balance::DECIMAL(28,4))")} AS exposure_as_pct_of_original,
         CAST(NULL AS DOUBLE) AS loss_severity_pct
  FROM event
  GROUP BY GROUPING SETS ((), (credit_score_band), (ltv_band), (property_type), (occupancy),
                          (origination_vintage))""",
    "staged": """
  SELECT period, reporting_quarter, credit_score_band, current_balance,
         if(status_code = 1, 'Stage 3', if(coalesce(current_ltv, 0) > 100, 'Stage 2', 'Stage 1'))
           AS ifrs9_stage
  FROM fact""",
    "life": """
  SELECT credit_score_band,
         CAST(count(e.loan_id) AS DOUBLE) / nullif(count(*), 0) AS pd_lifetime
  FROM loan LEFT JOIN (SELECT loan_id FROM event) e USING (loan_id) GROUP BY ALL""",
    "year_ahead": """
  SELECT f.credit_score_band,
         CAST(sum(CASE WHEN e.default_period - f.period <= 4 THEN 1 ELSE 0 END) AS DOUBLE)
           / nullif(count(*), 0) AS pd_12m
  FROM fact f LEFT JOIN event e ON e.loan_id = f.loan_id
  WHERE f.status_code = 0 GROUP BY ALL""",
    "stage_cells": """
  SELECT period, reporting_quarter, ifrs9_stage, credit_score_band, count(*) AS loans,
         sum(current_balance::DECIMAL(28,4)) AS exact
  FROM staged GROUP BY ALL""",
    "provisions": f"""
  SELECT period, reporting_quarter, ifrs9_stage, credit_score_band, loans, exact,
         CAST(exact AS DOUBLE) AS exposure,
         if(ifrs9_stage = 'Stage 1', pd_12m, if(ifrs9_stage = 'Stage 2', pd_lifetime, 1e0))
           AS probability_of_default,
         3e-1 AS loss_given_default_assumed,
         CAST(exact AS DOUBLE) * probability_of_default * 3e-1 AS provision,
         {_pct("provision", "exact")} AS coverage_ratio_pct
  FROM stage_cells LEFT JOIN life USING (credit_score_band)
    LEFT JOIN year_ahead USING (credit_score_band)""",
    "closings": """
  SELECT period, reporting_quarter, CAST(sum(exact) AS DOUBLE) AS exposure,
         list_reduce(list(provision ORDER BY ifrs9_stage, credit_score_band)
                       FILTER (WHERE provision IS NOT NULL),
                     lambda x, y: x + y) AS closing_provision
  FROM provisions GROUP BY ALL""",
    "openings": """
  SELECT *, coalesce(lag(closing_provision) OVER (ORDER BY period), 0) AS opening_provision
  FROM closings""",
    "movement": f"""
  SELECT period, reporting_quarter, opening_provision,
         if(closing_provision > opening_provision, closing_provision - opening_provision, 0e0)
           AS increase,
         if(closing_provision < opening_provision, opening_provision - closing_provision, 0e0)
           AS decrease,
         closing_provision, closing_provision - opening_provision AS net_movement, exposure,
         {_pct("closing_provision", "exposure")} AS coverage_ratio_pct,
         round(opening_provision + increase - decrease - closing_provision, 6)
           AS reconciliation_error
  FROM openings""",
    # --- quality ---
    "stepped": """
  SELECT *, lag(current_balance) OVER w AS pb, lag(status_code) OVER w AS ps
  FROM fact WINDOW w AS (PARTITION BY loan_id ORDER BY period)""",
    "differences": """
  SELECT segment_type, c.period, CAST(sum(active_exact) - any_value(total) AS DOUBLE) AS d
  FROM cells c
  JOIN (SELECT period, sum(current_balance::DECIMAL(28,4)) AS total FROM fact WHERE status_code = 0
        GROUP BY period) p ON p.period = c.period
  GROUP BY ALL""",
    "counted": """
  SELECT 'duplicate_loan_period' AS rule_name, count(*) AS affected_rows
  FROM (SELECT 1 FROM fact GROUP BY loan_id, period HAVING count(*) > 1)
  UNION ALL SELECT 'negative_balance', count(*) FROM fact WHERE current_balance < 0
  UNION ALL SELECT 'balance_increased_on_amortising_loan', count(*) FROM stepped
    WHERE current_balance - pb > 1 AND status_code = 0
  UNION ALL SELECT 'row_dated_before_origination', count(*) FROM fact WHERE quarters_on_book < 0
  UNION ALL SELECT 'loan_left_terminal_status', count(*) FROM stepped
    WHERE (ps = 1 OR ps = 2) AND status_code != ps
  UNION ALL SELECT 'missing_credit_score', count(*) - count(credit_score) FROM loan
  UNION ALL SELECT 'missing_property_type', count(*) FROM loan
    WHERE coalesce(property_type, 'Other / not stated') = 'Other / not stated'
  UNION ALL SELECT 'invalid_status_code', count(*) FROM fact
    WHERE status_code < 0 OR status_code > 2
  UNION ALL SELECT 'segment_balance_reconciliation', count(*) FROM differences
    WHERE abs(d) > 0.01
  UNION ALL SELECT 'reporting_period_continuity',
    CAST(count(*) IS DISTINCT FROM max(period) - min(period) + 1 AS BIGINT) FROM dates""",
    # --- the published tables with faults ---
    "fact_bad": """
  SELECT f.* FROM fact f, range(3) AS r(n)
  WHERE period <> 12
    AND n <= if((loan_id * 7 + period) % 113 = 0, 1, 0) + if((loan_id * 7 + period) % 226 = 0, 1, 0)""",
    "stepped_bad": """
  SELECT *, lag(current_balance) OVER w AS pb, lag(status_code) OVER w AS ps
  FROM fact_bad WINDOW w AS (PARTITION BY loan_id ORDER BY period)""",
    "differences_bad": """
  SELECT segment_type, period, d + if(segment_type = 'Occupancy' AND period % 9 = 4,
           1000 * (SELECT count(*) FROM cells c WHERE c.segment_type = 'Occupancy'
                   AND c.period = differences.period AND c.active_exact IS NOT NULL), 0) AS d
  FROM differences""",
    "dates_bad": "SELECT * FROM dates WHERE period <> 12",
    # --- other assumptions ---
    "staged_other": """
  SELECT period, reporting_quarter, credit_score_band, current_balance,
         if(status_code = 1, 'Stage 3', if(coalesce(current_ltv, 0) > 90, 'Stage 2', 'Stage 1'))
           AS ifrs9_stage
  FROM fact""",
    "year_ahead_other": """
  SELECT f.credit_score_band,
         CAST(sum(CASE WHEN e.default_period - f.period <= 8 THEN 1 ELSE 0 END) AS DOUBLE)
           / nullif(count(*), 0) AS pd_12m
  FROM fact f LEFT JOIN event e ON e.loan_id = f.loan_id
  WHERE f.status_code = 0 GROUP BY ALL""",
    "rules": "SELECT rule_name, CASE rule_name "
    + " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in RULE_SEVERITY.items())
    + """ END AS severity, if(affected_rows = 0, 'PASS', 'FAIL') AS status, affected_rows
  FROM counted""",
    "found": """
  SELECT 'duplicate_loan_period' AS rule_name,
         (SELECT count(*) FROM panel) - (SELECT count(*) FROM kept) AS affected_rows,
         'Duplicate loan-period rows in source; kept the lower balance of each pair' AS detail
  UNION ALL SELECT 'inconsistent_origination_attributes', count(*),
    'Loans whose origination attributes vary across their own rows; the value at the earliest '
    || 'period is used' FROM loan WHERE is_inconsistent
  UNION ALL SELECT 'panel_period_gap', count(*),
    concat('Missing mid-panel periods forward-filled across ', count(DISTINCT loan_id),
           ' loans; rows marked is_forward_filled') FROM filled WHERE is_forward_filled""",
    "findings": "SELECT rule_name, CASE rule_name "
    + " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in INGEST_SEVERITY.items())
    + """ END AS severity, if(affected_rows = 0, 'PASS', 'FAIL') AS status, affected_rows, detail
  FROM found""",
    "register": """
  SELECT unnest([TIMESTAMP '2024-01-31 06:00:00', TIMESTAMP '2024-04-30 06:00:00'])
           AS run_timestamp, '1-ingest' AS phase, rule_name, severity, status, affected_rows, detail
  FROM findings
  UNION ALL
  SELECT unnest([TIMESTAMP '2024-01-31 06:30:00', TIMESTAMP '2024-04-30 06:30:00']),
         '4-quality', rule_name, severity, status, affected_rows, '' FROM rules""",
    "failing": """
  SELECT rule_name, severity, affected_rows FROM register
  WHERE phase = '4-quality' AND status = 'FAIL'
    AND run_timestamp = TIMESTAMP '2024-04-30 06:30:00'""",
    # --- commentary ---
    "compared": """
  SELECT cur.*, pre.period IS NOT NULL AS has_prior_period,
         pre.quarterly_default_rate_pct AS prior_default_rate_pct,
         coalesce(cur.quarterly_default_rate_pct, 0) - pre.quarterly_default_rate_pct
           AS default_rate_move_pp
  FROM summary cur LEFT JOIN summary pre ON pre.period = cur.period - 1""",
    "facts": """
  SELECT c.period, c.reporting_quarter, active_balance, active_loans, average_balance,
         prior_active_balance, balance_growth_pct,
         coalesce(abs(balance_growth_pct) >= 1, false) AS growth_is_notable,
         CASE WHEN balance_growth_pct > 0 THEN 'rose'
              WHEN balance_growth_pct <= 0 THEN 'fell' END AS balance_direction,
         quarterly_default_rate_pct, has_prior_period, prior_default_rate_pct,
         default_rate_move_pp,
         coalesce(abs(default_rate_move_pp) >= 0.25, false) AS default_rate_is_notable,
         payoffs, paid_off_balance, defaults, defaulted_balance, unemployment_rate,
         house_price_index, opening_provision, closing_provision, increase, decrease, exposure,
         coverage_ratio_pct,
         if(increase > 0, 'charge', if(decrease > 0, 'release', 'unchanged'))
           AS provision_direction
  FROM compared c JOIN movement m ON m.period = c.period""",
    "growers": f"""
  SELECT DISTINCT ON (s.period) s.period, s.segment_type, s.segment_value, s.balance_growth_pct,
         {_pct("s.active_balance - s.prior_active_balance", "p.prior_active_balance")}
           AS contribution_pp
  FROM segments s JOIN summary p USING (period)
  WHERE s.balance_growth_pct IS NOT NULL AND s.active_loans > 50
  ORDER BY s.period, if(coalesce(p.balance_growth_pct, 0) < 0, 1, -1) * s.balance_growth_pct,
           s.segment_type, s.segment_value""",
    "worst": """
  SELECT DISTINCT ON (period) period, segment_type, segment_value, quarterly_default_rate_pct
  FROM segments WHERE quarterly_default_rate_pct IS NOT NULL AND active_loans > 50
  ORDER BY period, quarterly_default_rate_pct DESC, segment_type, segment_value""",
    "stage2": f"""
  SELECT period, {_pct("sum(if(ifrs9_stage = 'Stage 2', exact, NULL))", "sum(exact)")}
           AS stage2_share_pct
  FROM stage_cells GROUP BY period""",
    "failed_lines": """
  SELECT CASE WHEN count(*) = 0 THEN ['All data quality rules passed on the most recent run.']
         ELSE list_concat(
           [concat(count(*), ' rule(s) failed on the most recent run. Nothing has been cleaned.')],
           list(format('  - {} ({}): {:,} rows', rule_name, severity, affected_rows)
                ORDER BY affected_rows DESC, rule_name)) END AS l
  FROM failing""",
    "pages": f"""
  SELECT f.period, f.reporting_quarter, list_filter(list_concat([
    'PORTFOLIO COMMENTARY', repeat('=', 70),
    concat('Reporting quarter : ', f.reporting_quarter, ' (period ', f.period, ')'),
    'Basis             : rule-based, generated from the reporting views.',
    '                    Provision figures are ILLUSTRATIVE, not an',
    '                    accounting allowance.', '',
    'PORTFOLIO BALANCE', repeat('-', 70),
    concat('Active balance stood at ', {_money("active_balance")}, ' across ',
           format('{{:,}}', active_loans), ' loans, an average of ',
           {_money("average_balance")}, ' per loan.'),
    CASE WHEN growth_is_notable
         THEN concat('The book ', balance_direction, ' ',
                     printf('%.1f', abs(f.balance_growth_pct)), '% on the quarter, from ',
                     {_money("prior_active_balance")}, '.')
         ELSE 'Balance was broadly flat on the quarter.' END,
    CASE WHEN growth_is_notable AND g.period IS NOT NULL
         THEN concat('The largest single contributor was ', lower(g.segment_type), ' ''',
                     g.segment_value, ''', which ',
                     if(g.balance_growth_pct > 0, 'rose', 'fell'), ' ',
                     printf('%.1f', abs(g.balance_growth_pct)), '%.') END,
    concat(format('{{:,}}', payoffs), ' loans paid off (', {_money("paid_off_balance")}, ') and ',
           format('{{:,}}', defaults), ' defaulted (', {_money("defaulted_balance")}, ').'),
    '',
    'CREDIT PERFORMANCE', repeat('-', 70),
    concat('The quarterly default rate was ',
           printf('%.2f', coalesce(f.quarterly_default_rate_pct, 0)),
           '% of loans active at the prior quarter end.'),
    CASE WHEN default_rate_is_notable
         THEN concat('That is ', printf('%.2f', abs(default_rate_move_pp)),
                     ' percentage points ', if(default_rate_move_pp > 0, 'higher', 'lower'),
                     ' than the prior quarter''s ', printf('%.2f', prior_default_rate_pct), '%.')
         WHEN has_prior_period THEN 'The default rate was broadly stable on the quarter.' END,
    CASE WHEN default_rate_is_notable AND w.quarterly_default_rate_pct <> 0
         THEN concat('The highest default rate this quarter was in ', lower(w.segment_type), ' ''',
                     w.segment_value, ''' at ', printf('%.2f', w.quarterly_default_rate_pct),
                     '%.') END,
    concat('Unemployment stood at ', printf('%.1f', unemployment_rate),
           '% and the house price index at ', printf('%.1f', house_price_index), '.'),
    'NOTE: this dataset carries no delinquency buckets, so no 30+ or 90+',
    'arrears rate can be reported.', '',
    'PROVISION MOVEMENT (ILLUSTRATIVE)', repeat('-', 70),
    concat('Provision closed at ', {_money("closing_provision")}, ' against exposure of ',
           {_money("f.exposure")}, ', a coverage ratio of ', printf('%.2f', coverage_ratio_pct),
           '%.'),
    CASE provision_direction
         WHEN 'charge' THEN concat('The quarter carried a charge of ', {_money("increase")},
                                   ' (opening ', {_money("opening_provision")}, ').')
         WHEN 'release' THEN concat('The quarter carried a release of ', {_money("decrease")},
                                    ' (opening ', {_money("opening_provision")}, ').')
         ELSE 'Provision was unchanged on the quarter.' END,
    concat('Stage 2 accounted for ', printf('%.1f', coalesce(stage2_share_pct, 0)),
           '% of exposure, staged on negative equity.'), '',
    'DATA QUALITY', repeat('-', 70)], (SELECT l FROM failed_lines),
    ['', repeat('=', 70),
    'End of commentary. Every figure above is a value from a reporting view;',
    'no narrative has been inferred beyond the configured thresholds.']),
    lambda x: x IS NOT NULL) AS lines
  FROM facts f LEFT JOIN growers g ON g.period = f.period
    LEFT JOIN worst w ON w.period = f.period LEFT JOIN stage2 s2 ON s2.period = f.period""",
}



def _instead(body: str, *names: str, suffix: str) -> str:
    """A body that reads other relations in the place of ``names``."""
    return re.sub(rf"\b({'|'.join(names)})\b", rf"\1{suffix}", body)


BASE |= {
    "counted_bad": _instead(
        BASE["counted"], "fact", "stepped", "differences", "dates", suffix="_bad"
    ),
    "stage_cells_other": _instead(BASE["stage_cells"], "staged", suffix="_other"),
    "provisions_other": _instead(
        BASE["provisions"], "stage_cells", "year_ahead", suffix="_other"
    ).replace("3e-1", "45e-2"),
    "closings_other": _instead(BASE["closings"], "provisions", suffix="_other"),
    "openings_other": _instead(BASE["openings"], "closings", suffix="_other"),
    "movement_other": _instead(BASE["movement"], "openings", suffix="_other"),
}

_VALUES = """loan_id, period, balance AS balance_time, ltv AS LTV_time,
  rate AS interest_rate_time, status AS status_time, default_time, payoff_time"""
_ENDS = """(SELECT id, first(orig_time ORDER BY "time", orig_time) AS orig_time,
  last(status_time ORDER BY "time", status_time) FILTER (WHERE status_time IS NOT NULL)
    AS final_status FROM panel GROUP BY id)"""
_BY_AGE = """max(CASE WHEN origination_vintage = '{}'
  THEN cumulative_default_rate_by_balance_pct END)"""
_BENIGN, _STRESSED = _BY_AGE.format("1995Q2"), _BY_AGE.format("1996Q4")
_SUMMED = {
    "vw_portfolio_summary": "summary",
    "vw_segment_performance": "segments",
    "vw_delinquency": "mix",
    "vw_roll_rates": "rolls",
    "vw_vintage_performance": "curves",
    "vw_loss_recovery": "losses",
    "vw_provision": "provisions",
    "vw_provision_movement": "movement",
    "dim_loan": "loan",
    "fact_loan_quarter": "fact",
    "fact_credit_event": "event",
    "dim_date": "dates",
    "dq_results": "register",
}

BODIES = {
    "src_panel": "SELECT * FROM panel",
    "src_landed": f"SELECT {', '.join(f'"{c}"' for c in PANEL_SCHEMA.names)} FROM judged WHERE NOT is_out",
    "src_rejected": """SELECT id_text AS id, time_text AS "time", column_name, value, reason
  FROM refused""",
    "dq_rejected": """SELECT 'rejected_source_row' AS rule_name, 'HIGH' AS severity,
  if(rows = 0, 'PASS', 'FAIL') AS status, rows AS affected_rows,
  concat('Source rows left out: ', a, ' malformed record, ', b, ' not a number, ', c,
         ' not a whole number, ', d, ' out of range') AS detail
  FROM (SELECT count(*) AS rows FROM judged WHERE is_out),
       (SELECT count(*) FILTER (reason = 'malformed record') AS a,
               count(*) FILTER (reason = 'not a number') AS b,
               count(*) FILTER (reason = 'not a whole number') AS c,
               count(*) FILTER (reason = 'out of range') AS d FROM refused)""",
    "schema_profile": """SELECT count(*) AS rows, count(DISTINCT id) AS entities,
  min("time") AS first_period, max("time") AS last_period,
  count(CASE WHEN status_time < 0 OR status_time > 2 THEN 1 END) AS bad_status,
  count(CASE WHEN FICO_orig_time < 300 OR FICO_orig_time > 900 THEN 1 END) AS bad_score,
  count(CASE WHEN balance_time < 0 THEN 1 END) AS negative_balance FROM panel""",
    "dq_register": "SELECT * FROM register",
    "manifest_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS object, count(*) AS rows FROM {table}"
        for name, table in _SUMMED.items()
    ),
    "panel_dedupe": f"SELECT {_VALUES} FROM kept",
    "ingest_findings": "SELECT * FROM findings",
    "dq_long_gaps": """SELECT 'implausible_panel_gap' AS rule_name, 'MEDIUM' AS severity,
  if(n = 0, 'PASS', 'FAIL') AS status, n AS affected_rows,
  'Gaps of more than 6 periods; filled like any other' AS detail
  FROM (SELECT count(*) AS n
        FROM (SELECT lead(period) OVER (PARTITION BY loan_id ORDER BY period) - period - 1 AS missing
              FROM kept) WHERE missing > 6)""",
    "dim_entity": "SELECT * EXCLUDE (is_inconsistent) FROM loan",
    "band_distribution": """SELECT 'credit_score_band' AS band_type, credit_score_band AS band,
  count(*) AS rows FROM loan GROUP BY ALL
  UNION ALL SELECT 'ltv_band', ltv_band, count(*) FROM loan GROUP BY ALL
  UNION ALL SELECT 'current_ltv_band', current_ltv_band, count(*) FROM fact GROUP BY ALL""",
    "dim_period": "SELECT * FROM dates",
    "dim_period_macro": "SELECT * FROM macro",
    "panel_gapfill": f"SELECT {_VALUES}, is_forward_filled FROM filled",
    "fact_panel": "SELECT * FROM fact",
    "fact_event": "SELECT * FROM event",
    "period_continuity": """SELECT min(period) AS first_period, max(period) AS last_period,
  count(*) AS present, max(period) - min(period) + 1 AS expected,
  first(reporting_quarter ORDER BY period) AS first_quarter,
  last(reporting_quarter ORDER BY period) AS last_quarter FROM dates""",
    "focus_cohort_summary": f"""SELECT focus_cohort, origination_vintage, count(*) AS loans,
  {_round("CAST(sum(credit_score) AS DOUBLE) / count(credit_score)", 0)} AS avg_score,
  {_round("CAST(sum(CAST(original_ltv AS DECIMAL(28,6))) AS DOUBLE) / count(original_ltv)", 1)}
    AS avg_ltv,
  {_round(_pct("count(e.loan_id)", "count(*)"), 1)} AS lifetime_default_pct
  FROM loan LEFT JOIN (SELECT loan_id FROM event) e USING (loan_id)
  WHERE focus_cohort IS NOT NULL GROUP BY ALL""",
    "focus_exposure": f"""SELECT origination_vintage, count(*) AS defaults,
  {_round("CAST(sum(exposure_at_default::DECIMAL(28,4)) AS DOUBLE) / 1e6", 1)} AS exposure_at_default_m,
  {_round("CAST(sum(CAST(ltv_at_default AS DECIMAL(28,6))) AS DOUBLE) / count(ltv_at_default)", 1)}
    AS avg_ltv_at_default,
  {_round("CAST(sum(quarters_on_book_at_default) AS DOUBLE) / count(*)", 1)} AS avg_qob_at_default
  FROM event WHERE focus_cohort IS NOT NULL GROUP BY ALL""",
    "dq_latest_ingest": "SELECT * FROM findings",
    "portfolio_summary": "SELECT * FROM summary",
    "segment_performance": "SELECT * FROM segments",
    "status_mix": "SELECT * FROM mix",
    "roll_rates": "SELECT * FROM rolls",
    "roll_rates_selfjoin": "SELECT * FROM rolls",
    "vintage_curves": "SELECT * FROM curves",
    "loss_exposure": "SELECT * FROM losses",
    "stage_distribution": """SELECT period, reporting_quarter, ifrs9_stage, count(*) AS loans,
  CAST(sum(current_balance::DECIMAL(28,4)) AS DOUBLE) AS exposure FROM staged GROUP BY ALL""",
    "pd_lifetime": "SELECT * FROM life",
    "pd_horizon": "SELECT * FROM year_ahead",
    "provision": "SELECT * EXCLUDE (exact) FROM provisions",
    "provision_movement": "SELECT * FROM movement",
    "dq_rules": "SELECT * FROM rules",
    "dq_reconciliation": """SELECT segment_type, max(abs(d)) AS max_abs_difference
  FROM differences GROUP BY ALL""",
    "dq_score": f"""SELECT {_pct("sum(if(status = 'PASS', w, 0))", "sum(w)")} AS score,
  count(CASE WHEN status = 'PASS' THEN 1 END) AS rules_passed, count(*) AS rules,
  CAST(sum(affected_rows) AS BIGINT) AS affected_rows
  FROM (SELECT *, if(severity = 'HIGH', 3, if(severity = 'MEDIUM', 2, 1)) AS w FROM rules)""",
    "dq_history": """SELECT phase, status, count(*) AS rules,
  CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM register GROUP BY ALL""",
    "dq_latest_run": """SELECT rule_name, severity, status, affected_rows FROM register
  WHERE phase = '4-quality' AND run_timestamp = TIMESTAMP '2024-04-30 06:30:00'""",
    "dq_latest": "SELECT * FROM failing",
    "faulty_rules": BASE["rules"].replace("FROM counted", "FROM counted_bad"),
    "faulty_keys": """SELECT loan_id, period, count(*) AS copies FROM fact_bad
  GROUP BY ALL HAVING count(*) > 1""",
    "faulty_reconciliation": """SELECT segment_type, max(abs(d)) AS max_abs_difference
  FROM differences_bad GROUP BY ALL""",
    "bucketed_roll_rates": "SELECT * FROM rolls",
    "bucketed_duplicates": """SELECT count(*) AS duplicate_loan_period
  FROM (SELECT 1 FROM fact GROUP BY loan_id, period HAVING count(*) > 1)""",
    "bucketed_exposure": """SELECT f.period, l.property_type, l.original_term_quarters, count(*) AS loans,
  CAST(sum(current_balance::DECIMAL(28,4)) AS DOUBLE) AS balance
  FROM fact f JOIN loan l USING (loan_id) GROUP BY ALL""",
    "sql_provision": """SELECT * EXCLUDE (exact) FROM provisions
  UNION ALL SELECT * EXCLUDE (exact) FROM provisions_other""",
    "sql_movement": "SELECT * FROM movement_other",
    "sql_stage2": f"""SELECT ltv, period,
  {_pct("sum(current_balance::DECIMAL(28,4)) FILTER (status_code <> 1 AND current_ltv > ltv)",
        "sum(current_balance::DECIMAL(28,4))")} AS stage2_share_pct
  FROM (SELECT period, current_balance, current_ltv, coalesce(status_code, 9) AS status_code FROM fact),
       (VALUES (8e1), (1e2)) AS t(ltv) GROUP BY ALL""",
    "sql_movers": """SELECT DISTINCT ON (period) period, segment_type, segment_value,
  quarterly_default_rate_pct
  FROM segments WHERE quarterly_default_rate_pct IS NOT NULL AND active_loans > 10
  ORDER BY period, quarterly_default_rate_pct DESC, segment_type, segment_value""",
    "sql_segments": """SELECT period, segment_type, segment_value, active_balance, active_loans,
  pct_of_portfolio_balance, quarterly_default_rate_pct FROM segments
  WHERE segment_type = 'Credit score band' AND segment_value IN ('1. <620', '6. 780+')""",
    "sql_vintages": """SELECT origination_vintage, quarters_on_book, pct_cohort_still_observed,
  cumulative_default_rate_pct, cumulative_default_rate_by_balance_pct FROM curves
  WHERE origination_vintage IN ('1995Q2', '1996Q4') AND pct_cohort_still_observed >= 50""",
    "movement_facts": "SELECT * FROM facts",
    "top_mover_growth": "SELECT * FROM growers",
    "top_mover_default": "SELECT * FROM worst",
    "stage2_share": "SELECT * FROM stage2",
    "commentary_lines": """SELECT period, reporting_quarter,
  CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line_no, unnest(lines) AS text
  FROM pages""",
    "commentary_files": "SELECT reporting_quarter, unnest(lines) AS text FROM pages",
    "export_segments": "SELECT * FROM segments",
    "slicer_values": """SELECT DISTINCT 'origination_vintage' AS slicer,
  origination_vintage AS value FROM loan
  UNION ALL SELECT DISTINCT 'credit_score_band', credit_score_band FROM loan""",
    "headline_kpis": f"""SELECT s.period, s.reporting_quarter, active_balance,
  {_money("active_balance")} AS active_balance_text, balance_growth_pct, active_loans,
  coalesce(quarterly_default_rate_pct, 0) AS quarterly_default_rate_pct, defaults,
  coverage_ratio_pct
  FROM summary s LEFT JOIN movement m ON m.period = s.period
  WHERE s.period = (SELECT max(period) FROM summary)""",
    "segment_mix": """SELECT period, segment_type, segment_value, active_balance, active_loans,
  pct_of_portfolio_balance, quarterly_default_rate_pct FROM segments
  WHERE segment_type <> 'Credit score band' OR segment_value IN ('1. <620', '6. 780+')""",
    "status_pivot": """SELECT period, reporting_quarter,
  max(CASE status_bucket WHEN '1. Active' THEN balance END) AS balance_active,
  max(CASE status_bucket WHEN '2. Default' THEN balance END) AS balance_default,
  max(CASE status_bucket WHEN '3. Payoff' THEN balance END) AS balance_payoff,
  max(CASE status_bucket WHEN '9. Unknown' THEN balance END) AS balance_unknown
  FROM mix WHERE segment_type = 'Portfolio' GROUP BY ALL""",
    "roll_matrix": """SELECT from_period, from_status,
  max(CASE to_status WHEN '1. Active' THEN roll_rate_pct_by_count END) AS to_active,
  max(CASE to_status WHEN '2. Default' THEN roll_rate_pct_by_count END) AS to_default,
  max(CASE to_status WHEN '3. Payoff' THEN roll_rate_pct_by_count END) AS to_payoff,
  max(CASE to_status WHEN '9. Unknown' THEN roll_rate_pct_by_count END) AS to_unknown
  FROM rolls GROUP BY ALL""",
    "vintage_pivot": f"""SELECT quarters_on_book, {_BENIGN} AS vintage_1995q2,
  {_STRESSED} AS vintage_1996q4 FROM curves
  WHERE origination_vintage IN ('1995Q2', '1996Q4') AND pct_cohort_still_observed >= 50
  GROUP BY ALL""",
    "profile_shape": f"""SELECT count(*) AS rows, count(DISTINCT id) AS entities,
  {_round("CAST(count(*) AS DOUBLE) / count(DISTINCT id)", 1)} AS rows_per_entity FROM panel""",
    "profile_nulls": " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, '{kind}' AS data_type, "
        f'count(*) - count("{name}") AS missing FROM panel'
        for name, kind in ((f.name, f.dataType.simpleString()) for f in PANEL_SCHEMA)
    ),
    "profile_term": """SELECT mat_time - orig_time AS term, count(*) AS rows FROM panel
  GROUP BY ALL ORDER BY rows DESC, term LIMIT 8""",
    "profile_status": """SELECT status_time, count(*) AS rows,
  CASE status_time WHEN 0 THEN '1. Active' WHEN 1 THEN '2. Default' WHEN 2 THEN '3. Payoff' END
    AS label FROM panel WHERE status_time IS NOT NULL GROUP BY ALL""",
    "profile_final_status": f"""SELECT final_status, count(*) AS entities,
  {_round(_pct("count(*)", "sum(count(*)) OVER ()"), 1)} AS pct_of_entities
  FROM {_ENDS} WHERE final_status IS NOT NULL GROUP BY final_status""",
    "profile_macro_means": 'SELECT "time" AS period, '
    + ", ".join(
        _round(f"CAST(sum(CAST({c} AS DECIMAL(18,6))) AS DOUBLE) / count({c})", 2) + f" AS {name}"
        for c, name in (
            ("uer_time", "unemployment_rate"),
            ("hpi_time", "house_price_index"),
            ("gdp_time", "gdp_growth"),
        )
    )
    + ' FROM panel GROUP BY "time"',
    "profile_macro_peaks": " UNION ALL ".join(
        f"""SELECT '{name}' AS measure,
  first(period ORDER BY v DESC, period) AS peak_period, max(v) AS peak_value
  FROM (SELECT "time" AS period, {_round(
      f"CAST(sum(CAST({c} AS DECIMAL(18,6))) AS DOUBLE) / count({c})", 2)} AS v
        FROM panel GROUP BY "time")"""
        for c, name in (
            ("uer_time", "unemployment_rate"),
            ("hpi_time", "house_price_index"),
            ("gdp_time", "gdp_growth"),
        )
    ),
    "profile_vintage_default": f"""SELECT orig_time, count(*) AS entities,
  {_round(_pct("count(CASE WHEN final_status = 1 THEN 1 END)", "count(*)"), 1)} AS default_pct
  FROM {_ENDS} WHERE orig_time BETWEEN 1 AND 60 GROUP BY orig_time HAVING count(*) >= 20""",
    "profile_dupes_gaps": """SELECT (SELECT count(*) FROM panel) - (SELECT count(*) FROM kept)
    AS duplicate_rows,
  (SELECT count(*) FROM (SELECT id FROM panel GROUP BY id
     HAVING count(*) <> max("time") - min("time") + 1)) AS entities_with_gaps""",
    "insight_band_cohort": f"""SELECT credit_score_band, focus_cohort, count(*) AS loans,
  {_round(_pct("count(e.loan_id)", "count(*)"), 1)} AS lifetime_default_pct
  FROM loan LEFT JOIN (SELECT loan_id FROM event) e USING (loan_id)
  WHERE focus_cohort IS NOT NULL GROUP BY ALL""",
    "insight_collateral": f"""SELECT segment_value AS orig_ltv_band, defaults,
  {_round("avg_ltv_at_default", 1)} AS avg_ltv_at_default,
  {_round("pct_underwater_at_default", 1)} AS pct_underwater
  FROM losses WHERE segment_type = 'LTV band (at origination)'""",
    "insight_equal_age": f"""SELECT quarters_on_book, {_round("a", 1)} AS benign_pct,
  {_round("b", 1)} AS stressed_pct, {_round("b / nullif(a, 0)", 1)} AS ratio
  FROM (SELECT quarters_on_book, {_BENIGN} AS a, {_STRESSED} AS b FROM curves
        WHERE origination_vintage IN ('1995Q2', '1996Q4') AND quarters_on_book <= 32
        GROUP BY quarters_on_book)""",
    "insight_time_to_default": f"""SELECT e.origination_vintage, count(*) AS defaults,
  {_round("median(quarters_on_book_at_default)", 1)} AS median_age,
  {_round("CAST(sum(quarters_on_book_at_default) AS DOUBLE) / count(*)", 1)} AS mean_age,
  {_round("any_value(early)", 1)} AS early_loss_pct,
  {_round("1e2 * any_value(early) / nullif(any_value(final), 0)", 0)} AS early_share_of_loss_pct
  FROM event e JOIN (
    SELECT origination_vintage, max(cumulative_default_rate_by_balance_pct) AS final,
           max(CASE WHEN quarters_on_book <= 8 THEN cumulative_default_rate_by_balance_pct END)
             AS early
    FROM curves GROUP BY ALL) c USING (origination_vintage)
  WHERE focus_cohort IS NOT NULL GROUP BY ALL""",
    "insight_balance_rise": f"""SELECT CASE WHEN y BETWEEN 1993 AND 1994 THEN '1993-1994'
  WHEN y BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN y BETWEEN 1997 AND 2001 THEN '1997-2001'
  ELSE 'other' END AS vintage_group, count(*) AS active_rows,
  count(CASE WHEN current_balance - pb > 1 THEN 1 END) AS rise_rows,
  {_round(_pct("count(CASE WHEN current_balance - pb > 1 THEN 1 END)", "count(*)"), 1)}
    AS pct_rows_with_rise
  FROM (SELECT *, CAST(left(origination_vintage, 4) AS INTEGER) AS y FROM stepped
        WHERE status_code = 0) GROUP BY 1""",
}


def statements() -> dict[str, str]:
    """Query name to a complete statement over the source tables."""
    return {name: f"WITH {_needed(body)}\n{body}" for name, body in BODIES.items()}


def _needed(body: str) -> str:
    """The common table expressions a body uses, in definition order."""
    wanted: set[str] = set()
    texts = [body]
    while texts:
        words = set(texts.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in BASE.keys() & words - wanted:
            wanted.add(name)
            texts.append(BASE[name])
    return ",\n".join(f"{name} AS ({BASE[name]}\n)" for name in BASE if name in wanted)
