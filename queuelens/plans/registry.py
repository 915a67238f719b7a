"""Every operator under its query name, applied to a :class:`Workspace`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.operators import clean as c
from queuelens.operators import inference as i
from queuelens.operators import marts as r
from queuelens.operators import materiality as m
from queuelens.operators import metrics as k
from queuelens.operators import mixture as x
from queuelens.operators import months as mo
from queuelens.operators import quality as q
from queuelens.operators import segments as s
from queuelens.operators import validation as v
from queuelens.plans.workspace import Workspace
from queuelens.sources.files import (
    cells,
    read_clean_csv,
    read_clean_tickets,
    slug,
    write_clean,
    write_cuts,
)

Query = Callable[[Workspace], DataFrame]


def _normalize_channel(ws: Workspace) -> DataFrame:
    raw_channel = F.col("channel").alias("raw_channel")
    return c.normalize_channel(
        ws.distinct_rows.select("ticket_id", "channel", raw_channel), ws.profile
    )


def _normalize_category(ws: Workspace) -> DataFrame:
    raw_category = F.col("category").alias("raw_category")
    return c.normalize_category(
        ws.distinct_rows.select("ticket_id", "category", raw_category), ws.profile
    )


def _parse_mixed_timestamps(ws: Workspace) -> DataFrame:
    rows = ws.distinct_rows.select("ticket_id", "created_at", "resolved_at")
    return c.parse_timestamps(rows, ws.profile)


def _blank_to_null_and_score(ws: Workspace) -> DataFrame:
    rows = ws.distinct_rows.select("ticket_id", "agent_id", "satisfaction_score")
    return c.type_agent_and_score(rows)


def _typed(ws: Workspace) -> DataFrame:
    return c.type_rows(ws.distinct_rows, ws.profile)


def _enrich_agents(ws: Workspace) -> DataFrame:
    rows = _typed(ws).select("ticket_id", "category", "agent_id")
    return c.enrich_agents(rows, ws.agents, ws.agent_slots)


def _resolution_time(ws: Workspace) -> DataFrame:
    return c.add_resolution_time(_typed(ws), ws.profile).select(
        "ticket_id",
        "category",
        "created_at",
        "resolved_at",
        "is_resolved",
        "resolution_hours",
        "is_negative_duration",
        "is_extreme_duration",
        "is_future_resolution",
    )


def _open_age(ws: Workspace) -> DataFrame:
    return c.add_open_age(_typed(ws), ws.profile).select(
        "ticket_id", "category", "created_at", "resolved_at", "open_age_days"
    )


def _attribution_and_survey_flags(ws: Workspace) -> DataFrame:
    rows = _typed(ws).select(
        "ticket_id", "category", "created_at", "agent_id", "satisfaction_score"
    )
    enriched = c.enrich_agents(rows, ws.agents, ws.agent_slots)
    return c.add_attribution_and_survey_flags(enriched, ws.profile).select(
        "ticket_id",
        "category",
        "created_before_hire",
        "missing_agent",
        "has_satisfaction",
        "is_bottom_box",
        "is_partial_month",
    )


def _write_clean(ws: Workspace) -> DataFrame:
    """Both exports, side by side, as read back: the Parquet rows and the CSV cells as text."""
    written = write_clean(ws.clean_plan(), f"{ws.folder}/export")
    table = read_clean_tickets(ws.spark, written["parquet"])
    text = read_clean_csv(ws.spark, written["csv"])
    return table.withColumn("export", F.lit("parquet")).union(
        text.withColumn("export", F.lit("csv"))
    )


def _segment_slice(dimension: str) -> Query:
    def run(ws: Workspace) -> DataFrame:
        return s.segment_slice(ws.segments, dimension)

    return run


def _by_priority(ws: Workspace) -> DataFrame:
    return s.by_priority(ws.segments, ws.profile)


def _by_team(ws: Workspace) -> DataFrame:
    return s.by_team(ws.segments)


def _uniformity_spread(ws: Workspace) -> DataFrame:
    chosen = F.col("dimension").isin(*s.UNIFORMITY_DIMENSIONS)
    return s.uniformity_spread(ws.segments.filter(chosen))


# Titles of the saved reports, and the query behind each.
CUT_TITLES = {
    "By category": "by_category",
    "By channel": "by_channel",
    "By brand": "by_brand",
    "By priority": "by_priority",
    "By team": "by_team",
    "Monthly trend": "monthly_trend",
    "Agent low-score spread": "agent_low_score_spread",
    "Resolution vs satisfaction correlation": "resolution_satisfaction_corr",
    "Backlog age by priority": "backlog_age_by_priority",
    "Backlog by creation month": "backlog_by_creation_month",
    "Arrival pattern by weekday": "arrivals_by_weekday",
    "Duplicates": "mat_duplicates",
    "Date format misparsed": "mat_date_misparsed",
    "Date format rows dropped": "mat_date_rows_dropped",
    "Mean vs median": "mat_mean_vs_median",
    "Missing satisfaction as bad score": "mat_missing_as_bad",
    "Category and channel not normalised": "mat_not_normalised",
    "Survivorship": "mat_survivorship",
    "Bill to Billing evidence": "mat_bill_billing",
    "Pre-hire tickets diagnosed": "mat_pre_hire",
    "Satisfaction scale deconvolution": "scale_deconvolution",
    "Satisfaction methodology swing": "methodology_swing",
    "Backlog age profile": "backlog_age_profile",
    "Speed by denominator": "speed_by_denominator",
}


def cuts(ws: Workspace) -> dict[str, DataFrame]:
    """Every titled report as a plan; the segment reports read one shared table."""
    return {title: QUERIES[name](ws) for title, name in CUT_TITLES.items()}


def _write_cuts(ws: Workspace) -> DataFrame:
    """Every filled cell of the saved reports, as read back from the files."""
    plans = cuts(ws)
    written = write_cuts(plans, f"{ws.folder}/tables")
    names = {slug(title): plan.columns for title, plan in plans.items()}
    return cells(ws.spark, {slug(title): path for title, path in written.items()}, names)


# Queries by the step of an analysis they belong to.
GROUPS: dict[str, dict[str, Query]] = {
    "cleaning": {
        "ingest_raw_tickets": lambda ws: ws.raw,
        "dedup_exact": lambda ws: c.dedup_exact(ws.raw),
        "agents_dim": lambda ws: ws.agents,
        "normalize_channel": _normalize_channel,
        "normalize_category": _normalize_category,
        "parse_mixed_timestamps": _parse_mixed_timestamps,
        "blank_to_null_and_score": _blank_to_null_and_score,
        "id_conflicts": lambda ws: c.id_conflicts(ws.distinct_rows),
        "enrich_agents": _enrich_agents,
        "resolution_time": _resolution_time,
        "open_age": _open_age,
        "attribution_and_survey_flags": _attribution_and_survey_flags,
        "clean_tickets": lambda ws: c.clean_tickets(ws.raw, ws.agents, ws.profile),
        "write_clean": _write_clean,
    },
    "report": {
        "qa_row_counts": lambda ws: q.qa_row_counts(ws.copies, ws.tickets),
        "qa_distinct_before_after": lambda ws: q.qa_distinct_before_after(
            ws.distinct_rows, ws.tickets
        ),
        "qa_value_counts_channel": lambda ws: q.qa_value_counts(ws.tickets, "channel"),
        "qa_value_counts_category": lambda ws: q.qa_value_counts(ws.tickets, "category"),
        "qa_flag_counts": lambda ws: q.qa_flag_counts(ws.tickets),
        "qa_unparsed_created": lambda ws: q.qa_unparsed_created(ws.tickets),
        "qa_resolution_summary": lambda ws: q.qa_resolution_summary(ws.period_counts),
        "qa_open_age_summary": lambda ws: q.qa_open_age_summary(ws.period_counts, ws.profile),
    },
    "metrics": {
        "headline_kpis": lambda ws: k.headline_kpis(ws.period_counts, ws.profile),
        "scale_evidence_monthly": lambda ws: mo.scale_evidence_monthly(ws.month_cube, ws.profile),
        "score_histogram": lambda ws: k.score_histogram(ws.tickets),
        "resolution_distribution": lambda ws: k.resolution_distribution(ws.period_counts, ws.profile),
        "backlog_age_profile": lambda ws: k.backlog_age_profile(ws.period_counts, ws.profile),
        "speed_by_denominator": lambda ws: k.speed_by_denominator(ws.period_counts, ws.profile),
    },
    "segments": {
        "segment_metrics": lambda ws: s.segment_metrics(ws.tickets, ws.profile),
        "by_category": _segment_slice("category"),
        "by_channel": _segment_slice("channel"),
        "by_brand": _segment_slice("brand"),
        "by_priority": _by_priority,
        "by_team": _by_team,
        "uniformity_spread": _uniformity_spread,
        "monthly_trend": lambda ws: s.monthly_trend(ws.month_cube),
        "backlog_by_creation_month": lambda ws: s.backlog_by_creation_month(ws.month_cube),
        "arrivals_by_weekday": lambda ws: s.arrivals_by_weekday(ws.month_cube),
        "backlog_age_by_priority": lambda ws: k.backlog_age_by_priority(ws.period_counts, ws.profile),
        "backlog_age_summary": lambda ws: k.backlog_age_summary(ws.period_counts, ws.profile),
        "agent_low_score_spread": lambda ws: s.agent_low_score_spread(ws.tickets, ws.profile),
        "resolution_satisfaction_corr": lambda ws: s.resolution_satisfaction_corr(ws.tickets),
    },
    "checks": {
        "check_reconciliation": lambda ws: v.check_reconciliation(
            ws.copies, ws.tickets, ws.control_totals
        ),
        "check_no_negatives": lambda ws: v.check_no_negatives(ws.period_counts),
        "response_rate_by_segment": lambda ws: v.response_rate_by_segment(ws.tickets),
        "check_domains": lambda ws: v.check_domains(ws.tickets, ws.profile),
        "check_window_bounds": lambda ws: v.check_window_bounds(ws.tickets),
        "response_rate_by_speed": lambda ws: v.response_rate_by_speed(ws.period_counts, ws.profile),
        "response_rate_by_month": lambda ws: v.response_rate_by_month(ws.month_cube),
        "check_future_timestamps": lambda ws: v.check_future_timestamps(ws.tickets, ws.profile),
        "activity_on_both_clocks": lambda ws: v.activity_on_both_clocks(ws.month_cube),
        "check_duration_gap": lambda ws: v.check_duration_gap(ws.period_counts, ws.profile),
    },
    "materiality": {
        "mat_duplicates": lambda ws: m.mat_duplicates(ws.copies, ws.tickets),
        "mat_date_misparsed": lambda ws: m.mat_date_misparsed(
            ws.month_first_counts, ws.tickets, ws.profile
        ),
        "mat_date_rows_dropped": lambda ws: m.mat_date_rows_dropped(
            ws.distinct_rows, ws.tickets, ws.profile
        ),
        "mat_mean_vs_median": lambda ws: m.mat_mean_vs_median(ws.period_counts),
        "mat_missing_as_bad": lambda ws: m.mat_missing_as_bad(ws.period_counts),
        "mat_not_normalised": lambda ws: m.mat_not_normalised(ws.copies, ws.tickets, ws.profile),
        "mat_survivorship": lambda ws: m.mat_survivorship(ws.period_counts, ws.profile),
        "mat_bill_billing": lambda ws: m.mat_bill_billing(ws.distinct_rows, ws.tickets, ws.profile),
        "mat_pre_hire": lambda ws: m.mat_pre_hire(ws.tickets, ws.agents),
    },
    "mixture": {
        "scale_deconvolution": lambda ws: x.scale_deconvolution(ws.tickets, ws.profile),
        "scale_population_split": lambda ws: x.scale_population_split(ws.tickets, ws.profile),
        "methodology_swing": lambda ws: x.methodology_swing(ws.tickets, ws.profile),
        "methodology_gap": lambda ws: x.methodology_gap(ws.tickets, ws.profile),
        "scale_detector_by_dimension": lambda ws: x.scale_detector_by_dimension(
            ws.tickets, ws.profile
        ),
    },
    "inference": {
        "chi2_low_score_by_dim": lambda ws: i.chi2_low_score_by_dim(ws.tickets, ws.profile),
        "chi2_scale_by_dim": lambda ws: i.chi2_scale_by_dim(ws.tickets, ws.profile),
        "kruskal_resolution_by_priority": lambda ws: i.kruskal_resolution_by_priority(
            ws.tickets, ws.profile
        ),
        "two_prop_z_cells": lambda ws: i.two_prop_z_cells(ws.tickets, ws.profile),
        "gof_upper_scores": lambda ws: i.gof_upper_scores(ws.tickets, ws.profile),
        "gof_lower_scores": lambda ws: i.gof_lower_scores(ws.tickets, ws.profile),
        "gof_full_mixture": lambda ws: i.gof_full_mixture(ws.tickets, ws.profile),
    },
    "figures": {
        "mart_score_cliff": lambda ws: r.mart_score_cliff(ws.tickets, ws.profile),
        "mart_bins": lambda ws: r.mart_bins(ws.period_counts, ws.profile),
        "mart_trend_labels": lambda ws: r.mart_trend_labels(ws.month_cube),
        "mart_swing_ranked": lambda ws: r.mart_swing_ranked(ws.tickets, ws.profile),
        "mart_scale_cutover": lambda ws: r.mart_scale_cutover(ws.month_cube, ws.profile),
        "mart_dashboard_tiles": lambda ws: r.mart_dashboard_tiles(ws.period_counts, ws.profile),
        "mart_priority_panel": lambda ws: r.mart_priority_panel(ws.period_counts, ws.profile),
    },
    "saved reports": {
        "write_cuts": _write_cuts,
    },
}

QUERIES: dict[str, Query] = {
    name: query for group in GROUPS.values() for name, query in group.items()
}
