"""SG1 to SG7, T1 to T3, S1 and S2: metrics by segment, by month, by weekday, by agent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.numeric import pct, ratio, round_to, safe_corr, severity_rank
from queuelens.operators.clean import valid_resolution
from queuelens.operators.metrics import pick, ticket_counts, ticket_values
from queuelens.operators.months import by_month
from queuelens.plans.shapes import (
    group_by_each,
    grouped_histogram,
    select_quantiles,
    side_by_side,
    total,
    weighted_quantile,
)
from queuelens.profile import TicketProfile

SEGMENT_DIMENSIONS = ("category", "channel", "brand", "priority", "team")
UNIFORMITY_DIMENSIONS = ("category", "channel", "brand", "priority")
ALL_TICKETS = "ALL"
# Agents are ranked by rate inside buckets of so many percentage points.
POINTS_PER_RATE_BUCKET = 0.25


def _hours_only() -> dict[str, Column]:
    return {"hours": ticket_values()["hours"]}


def segment_metrics(
    tickets: DataFrame,
    profile: TicketProfile,
    dimensions: Sequence[str] = SEGMENT_DIMENSIONS,
) -> DataFrame:
    """SG1: six measures for every (dimension, segment), from one scan."""
    segments = {
        name: F.coalesce(name, F.lit(profile.no_team_label)) if name == "team" else F.col(name)
        for name in dimensions
    }
    return grouped_histogram(
        tickets,
        [],
        _hours_only(),
        pick(ticket_counts(profile), "open", "resolved", "answered", "scored", "low"),
        [
            total("n").alias("volume"),
            pct(total("open"), total("n")).alias("backlog_percentage"),
            round_to(weighted_quantile("hours", 0.5), 2).alias("median_hrs"),
            round_to(weighted_quantile("hours", 0.9), 1).alias("p90_hrs"),
            pct(total("answered"), total("resolved")).alias("response_rate_percentage"),
            pct(total("low"), total("scored")).alias("low_score_percentage"),
        ],
        segments,
    )


def segment_slice(metrics: DataFrame, dimension: str) -> DataFrame:
    """SG2 to SG4 and SG6: one dimension of SG1, largest segment first."""
    return (
        metrics.filter(F.col("dimension") == dimension)
        .drop("dimension")
        .orderBy(F.desc("volume"), F.asc_nulls_last("segment"))
    )


def by_team(metrics: DataFrame) -> DataFrame:
    """SG6: the team slice, three measures."""
    return segment_slice(metrics, "team").select(
        "segment", "volume", "median_hrs", "low_score_percentage"
    )


def by_priority(metrics: DataFrame, profile: TicketProfile) -> DataFrame:
    """SG5: the priority slice, most severe first."""
    rank = severity_rank(F.col("segment"), profile.priorities_by_severity)
    return (
        metrics.filter(F.col("dimension") == "priority")
        .drop("dimension")
        .orderBy(rank.asc_nulls_last())
    )


def uniformity_spread(metrics: DataFrame) -> DataFrame:
    """SG7: range of the low-score rate within each dimension."""
    low = F.col("low_score_percentage")
    return metrics.groupBy("dimension").agg(
        F.min(low).alias("min_percentage"),
        F.max(low).alias("max_percentage"),
        round_to(F.max(low) - F.min(low), 1).alias("spread_points"),
    )


def monthly_trend(cube: DataFrame) -> DataFrame:
    """Volume, median hours and low-score rate per full month."""
    months = by_month(cube).groupBy("month").agg(
        total("n").alias("volume"),
        round_to(weighted_quantile("hours", 0.5), 2).alias("median_hrs"),
        pct(total("low"), total("scored")).alias("low_score_percentage"),
    )
    return months.orderBy("month")


def backlog_by_creation_month(cube: DataFrame) -> DataFrame:
    """What each monthly cohort left open."""
    months = by_month(cube).groupBy("month").agg(
        total("n").alias("created"),
        total("open").alias("still_open"),
        pct(total("open"), total("n")).alias("pct_still_open"),
    )
    return months.orderBy("month")


def arrivals_by_weekday(cube: DataFrame) -> DataFrame:
    """Volume and median hours per weekday, Sunday first."""
    days = cube.filter(F.col("reading") == "weekday").groupBy("day_of_week", "day_name").agg(
        total("n").alias("volume"),
        round_to(weighted_quantile("hours", 0.5), 2).alias("median_hrs"),
    )
    return days.orderBy(F.asc_nulls_last("day_of_week"))


def agent_low_score_spread(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Spread of the low-score rate over agents with enough scored tickets."""
    scored = F.count_if("has_satisfaction")
    rates = (
        tickets.filter(F.col("agent_id").isNotNull())
        .groupBy("agent_id")
        .agg(
            scored.alias("scored"),
            ratio(F.lit(100.0) * F.count_if("is_bottom_box"), scored).alias("rate"),
        )
        .filter(F.col("scored") >= profile.min_scored_per_agent)
        .groupBy("rate")
        .agg(F.count("*").alias("n"))
    )
    spread = rates.agg(
        total("n").alias("agents"), F.min("rate").alias("least"), F.max("rate").alias("most")
    )
    quartiles = select_quantiles(
        rates, "rate", {"q25": 0.25, "median": 0.5, "q75": 0.75}, POINTS_PER_RATE_BUCKET
    )
    return side_by_side(spread, quartiles).select(
        "agents",
        round_to(F.col("least"), 1).alias("min_percentage"),
        round_to(F.col("q25"), 1).alias("q25_percentage"),
        round_to(F.col("median"), 1).alias("median_percentage"),
        round_to(F.col("q75"), 1).alias("q75_percentage"),
        round_to(F.col("most"), 1).alias("max_percentage"),
    )


def resolution_satisfaction_corr(tickets: DataFrame) -> DataFrame:
    """Pearson correlation of hours and score, overall and per priority."""
    answered = tickets.filter(valid_resolution() & F.col("has_satisfaction"))
    corr = safe_corr(F.col("resolution_hours"), F.col("satisfaction_score"))
    return (
        group_by_each(
            answered,
            {ALL_TICKETS: F.lit(ALL_TICKETS), "priority": F.col("priority")},
            [F.count("*").alias("n"), corr.alias("corr")],
        )
        .select(
            F.col("segment").alias("priority"),
            "n",
            round_to(F.col("corr"), 3).alias("corr_res_sat"),
        )
        .orderBy(F.asc_nulls_last("priority"))
    )
