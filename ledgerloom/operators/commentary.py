"""Rule-based commentary for every period, as one job.

Facts and the movers behind them are tables; sentences are column expressions
over them. Every figure in a line is a value of a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import fixed_point, grouped, money_text, moved, percent
from ledgerloom.spec import PanelSpec

# Wording of the report. ``{name}`` is filled per period.
RULE = "=" * 70
LINE = "-" * 70
TITLE = "PORTFOLIO COMMENTARY"
HEADER = (
    "Reporting quarter : {quarter} (period {period})",
    "Generated         : {generated}",
    "Basis             : rule-based, generated from the reporting views.",
    "                    Provision figures are ILLUSTRATIVE, not an",
    "                    accounting allowance.",
)
BALANCE_HEADING = "PORTFOLIO BALANCE"
STOOD = "Active balance stood at {balance} across {loans} loans, an average of {average} per loan."
BOOK_MOVED = "The book {moved} {growth}% on the quarter, from {prior}."
BOOK_FLAT = "Balance was broadly flat on the quarter."
CONTRIBUTOR = "The largest single contributor was {type} '{value}', which {moved} {growth}%."
EXITS = "{payoffs} loans paid off ({paid}) and {defaults} defaulted ({defaulted})."
CREDIT_HEADING = "CREDIT PERFORMANCE"
RATE = "The quarterly default rate was {rate}% of loans active at the prior quarter end."
RATE_MOVED = "That is {move} percentage points {direction} than the prior quarter's {prior}%."
RATE_STABLE = "The default rate was broadly stable on the quarter."
WORST = "The highest default rate this quarter was in {type} '{value}' at {rate}%."
MACRO = "Unemployment stood at {unemployment}% and the house price index at {index}."
NO_ARREARS = (
    "NOTE: this dataset carries no delinquency buckets, so no 30+ or 90+",
    "arrears rate can be reported.",
)
PROVISION_HEADING = "PROVISION MOVEMENT (ILLUSTRATIVE)"
CLOSED = "Provision closed at {closing} against exposure of {exposure}, a coverage ratio of {coverage}%."
CHARGE = "The quarter carried a charge of {amount} (opening {opening})."
RELEASE = "The quarter carried a release of {amount} (opening {opening})."
UNCHANGED = "Provision was unchanged on the quarter."
STAGE_2_LINE = "Stage 2 accounted for {share}% of exposure, staged on negative equity."
QUALITY_HEADING = "DATA QUALITY"
ALL_PASSED = "All data quality rules passed on the most recent run."
FAILED = "{count} rule(s) failed on the most recent run. Nothing has been cleaned."
FAILED_RULE = "  - {rule} ({severity}): {rows} rows"
CLOSING = (
    "End of commentary. Every figure above is a value from a reporting view;",
    "no narrative has been inferred beyond the configured thresholds.",
)


def movement_facts(portfolio: DataFrame, movement: DataFrame, spec: PanelSpec) -> DataFrame:
    """Current against prior figures and threshold flags, one row per period.

    The prior default rate is that of exactly the period before.
    """
    in_order = Window.orderBy("period")
    rate = F.coalesce(F.col("quarterly_default_rate_pct"), F.lit(0.0))
    adjacent = F.lag("period").over(in_order) == F.col("period") - 1
    compared = portfolio.withColumns(
        {
            "has_prior_period": F.coalesce(adjacent, F.lit(False)),
            "prior_default_rate_pct": F.when(
                adjacent, F.lag("quarterly_default_rate_pct").over(in_order)
            ),
        }
    ).withColumn("default_rate_move_pp", rate - F.col("prior_default_rate_pct"))
    growth = F.col("balance_growth_pct")
    provisions = movement.select(
        "period",
        "opening_provision",
        "closing_provision",
        "increase",
        "decrease",
        "exposure",
        "coverage_ratio_pct",
        F.when(F.col("increase") > 0, "charge")
        .when(F.col("decrease") > 0, "release")
        .otherwise("unchanged")
        .alias("provision_direction"),
    )
    return compared.select(
        "period",
        "reporting_quarter",
        "active_balance",
        "active_loans",
        "average_balance",
        "prior_active_balance",
        "balance_growth_pct",
        F.coalesce(F.abs(growth) >= spec.growth_threshold_pct, F.lit(False)).alias(
            "growth_is_notable"
        ),
        F.when(growth.isNotNull(), moved(growth)).alias("balance_direction"),
        "quarterly_default_rate_pct",
        "has_prior_period",
        "prior_default_rate_pct",
        "default_rate_move_pp",
        F.coalesce(
            F.abs("default_rate_move_pp") >= spec.default_rate_threshold_pp, F.lit(False)
        ).alias("default_rate_is_notable"),
        "payoffs",
        "paid_off_balance",
        "defaults",
        "defaulted_balance",
        "unemployment_rate",
        "house_price_index",
    ).join(provisions, "period")


def top_mover_growth(segments: DataFrame, portfolio: DataFrame, spec: PanelSpec) -> DataFrame:
    """Segment that grew most, or shrank most when the portfolio shrank.

    Ranked on its own growth. ``contribution_pp`` adds how much of the
    portfolio's growth it explains.
    """
    book = portfolio.select(
        "period",
        F.col("balance_growth_pct").alias("portfolio_growth_pct"),
        F.col("prior_active_balance").alias("portfolio_prior_balance"),
    )
    shrinking = F.coalesce(F.col("portfolio_growth_pct") < 0, F.lit(False))
    growth = F.col("balance_growth_pct")
    change = F.col("active_balance") - F.col("prior_active_balance")
    ranked = _candidates(segments, "balance_growth_pct", spec).join(book, "period")
    return _first_per_period(ranked, F.when(shrinking, growth).otherwise(-growth)).select(
        "period",
        "segment_type",
        "segment_value",
        "balance_growth_pct",
        percent(change, F.col("portfolio_prior_balance")).alias("contribution_pp"),
    )


def top_mover_default(segments: DataFrame, spec: PanelSpec) -> DataFrame:
    """Segment with the highest default rate of each period."""
    ranked = _candidates(segments, "quarterly_default_rate_pct", spec)
    return _first_per_period(ranked, -F.col("quarterly_default_rate_pct")).select(
        "period", "segment_type", "segment_value", "quarterly_default_rate_pct"
    )


def _candidates(segments: DataFrame, measure: str, spec: PanelSpec) -> DataFrame:
    return segments.where(
        F.col(measure).isNotNull() & (F.col("active_loans") > spec.mover_min_active)
    )


def _first_per_period(ranked: DataFrame, order: Column) -> DataFrame:
    by_order = Window.partitionBy("period").orderBy(order, "segment_type", "segment_value")
    return ranked.withColumn("place", F.row_number().over(by_order)).where(F.col("place") == 1)


def _text(template: str, **values: Column) -> Column:
    """Template with each ``{name}`` replaced by a string column."""
    parts = []
    rest = template
    while rest:
        before, opened, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not opened:
            break
        name, _, rest = after.partition("}")
        parts.append(values[name].cast("string"))
    return F.concat(*parts)


def commentary_lines(
    facts: DataFrame,
    growth_movers: DataFrame,
    default_movers: DataFrame,
    stage2: DataFrame,
    failing: DataFrame,
    generated: str | None = None,
    period: int | None = None,
) -> DataFrame:
    """(period, reporting_quarter, line_no, text) for all periods or one.

    ``failing`` is the list of failed rules, at most one row per rule; it enters
    every period as a scalar subquery. Without ``generated`` that line is left
    out, so that output does not depend on the clock.
    """
    growth_movers = growth_movers.select(
        "period",
        F.struct("segment_type", "segment_value", "balance_growth_pct").alias("grower"),
    )
    default_movers = default_movers.select(
        "period",
        F.struct("segment_type", "segment_value", "quarterly_default_rate_pct").alias("worst"),
    )
    rows = (
        facts.join(growth_movers, "period", "left")
        .join(default_movers, "period", "left")
        .join(stage2, "period", "left")
    )
    if period is not None:
        rows = rows.where(F.col("period") == period)
    # Sentences that do not apply are NULL and drop out before numbering.
    told = F.filter(
        F.array(*_header(generated), *_balance(), *_credit(), *_provision()),
        lambda text: text.isNotNull(),
    )
    lines = F.concat(
        told,
        F.array(F.lit(QUALITY_HEADING), F.lit(LINE)),
        _quality_lines(failing),
        F.array(F.lit(""), F.lit(RULE), *[F.lit(text) for text in CLOSING]),
    )
    return rows.select(
        "period", "reporting_quarter", F.posexplode(lines).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no") + 1)


def _header(generated: str | None) -> list[Column]:
    quarter, stamp, *basis = HEADER
    return [
        F.lit(TITLE),
        F.lit(RULE),
        _text(quarter, quarter=F.col("reporting_quarter"), period=F.col("period")),
        F.lit(None if generated is None else stamp.replace("{generated}", generated)).cast("string"),
        *[F.lit(text) for text in basis],
        F.lit(""),
    ]


def _balance() -> list[Column]:
    growth = F.col("balance_growth_pct")
    grower = F.col("grower")
    notable = F.col("growth_is_notable")
    moved_text = _text(
        BOOK_MOVED,
        moved=moved(growth),
        growth=fixed_point(F.abs(growth), 1),
        prior=money_text(F.col("prior_active_balance")),
    )
    contributor = _text(
        CONTRIBUTOR,
        type=F.lower(grower["segment_type"]),
        value=grower["segment_value"],
        moved=moved(grower["balance_growth_pct"]),
        growth=fixed_point(F.abs(grower["balance_growth_pct"]), 1),
    )
    return [
        F.lit(BALANCE_HEADING),
        F.lit(LINE),
        _text(
            STOOD,
            balance=money_text(F.col("active_balance")),
            loans=grouped(F.col("active_loans")),
            average=money_text(F.col("average_balance")),
        ),
        F.when(notable, moved_text).otherwise(BOOK_FLAT),
        F.when(notable & grower.isNotNull(), contributor),
        _text(
            EXITS,
            payoffs=grouped(F.col("payoffs")),
            paid=money_text(F.col("paid_off_balance")),
            defaults=grouped(F.col("defaults")),
            defaulted=money_text(F.col("defaulted_balance")),
        ),
        F.lit(""),
    ]


def _credit() -> list[Column]:
    rate = F.coalesce(F.col("quarterly_default_rate_pct"), F.lit(0.0))
    move = F.col("default_rate_move_pp")
    notable = F.col("default_rate_is_notable")
    worst = F.col("worst")
    worst_rate = worst["quarterly_default_rate_pct"]
    moved_text = _text(
        RATE_MOVED,
        move=fixed_point(F.abs(move), 2),
        direction=F.when(move > 0, "higher").otherwise("lower"),
        prior=fixed_point(F.col("prior_default_rate_pct"), 2),
    )
    return [
        F.lit(CREDIT_HEADING),
        F.lit(LINE),
        _text(RATE, rate=fixed_point(rate, 2)),
        F.when(notable, moved_text).when(F.col("has_prior_period"), RATE_STABLE),
        F.when(
            notable & (worst_rate != 0),
            _text(
                WORST,
                type=F.lower(worst["segment_type"]),
                value=worst["segment_value"],
                rate=fixed_point(worst_rate, 2),
            ),
        ),
        _text(
            MACRO,
            unemployment=_or_missing(fixed_point(F.col("unemployment_rate"), 1)),
            index=_or_missing(fixed_point(F.col("house_price_index"), 1)),
        ),
        *[F.lit(text) for text in NO_ARREARS],
        F.lit(""),
    ]


def _provision() -> list[Column]:
    opening = money_text(F.col("opening_provision"))
    direction = F.col("provision_direction")
    return [
        F.lit(PROVISION_HEADING),
        F.lit(LINE),
        _text(
            CLOSED,
            closing=money_text(F.col("closing_provision")),
            exposure=money_text(F.col("exposure")),
            coverage=_or_missing(fixed_point(F.col("coverage_ratio_pct"), 2)),
        ),
        F.when(
            direction == "charge",
            _text(CHARGE, amount=money_text(F.col("increase")), opening=opening),
        )
        .when(
            direction == "release",
            _text(RELEASE, amount=money_text(F.col("decrease")), opening=opening),
        )
        .otherwise(UNCHANGED),
        _text(
            STAGE_2_LINE,
            share=fixed_point(F.coalesce(F.col("stage2_share_pct"), F.lit(0.0)), 1),
        ),
        F.lit(""),
    ]


def _or_missing(text: Column) -> Column:
    return F.coalesce(text, F.lit("n/a"))


def _quality_lines(failing: DataFrame) -> Column:
    ranked = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("affected_rows")).alias("order"), "rule_name", "severity", "affected_rows"
            )
        )
    )
    listed = F.transform(
        ranked,
        lambda rule: _text(
            FAILED_RULE,
            rule=rule["rule_name"],
            severity=rule["severity"],
            rows=grouped(rule["affected_rows"]),
        ),
    )
    return (
        failing.agg(
            F.when(F.count("*") == 0, F.array(F.lit(ALL_PASSED)))
            .otherwise(F.concat(F.array(_text(FAILED, count=F.count("*"))), listed))
            .alias("lines")
        )
        .scalar()
    )
