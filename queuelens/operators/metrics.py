"""K1 to K6, B1 and B2: headline figures, distributions and backlog age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.functions.numeric import bucketize, pct, round_to, severity_rank
from queuelens.operators.clean import valid_resolution
from queuelens.plans.shapes import (
    TICKETS,
    grouped_histogram,
    tickets_in,
    total,
    unpivot_row,
    weighted_quantile,
    whole_table,
)
from queuelens.profile import TicketProfile


# What reports on the whole period or on priorities read of a ticket.
PERIOD_COLUMNS = (
    "priority",
    "is_resolved",
    "is_negative_duration",
    "is_extreme_duration",
    "resolution_hours",
    "open_age_days",
    "has_satisfaction",
    "is_bottom_box",
)


def period_counts(tickets: DataFrame) -> DataFrame:
    """Tickets by all of ``PERIOD_COLUMNS``: durations are minutes and ages days, so the
    calendar bounds the rows, and one scan serves many reports."""
    return tickets.groupBy(*PERIOD_COLUMNS).agg(F.count("*").alias(TICKETS))


def ticket_values() -> dict[str, Column]:
    """The two quantities quantiles are taken of; a row has at most one of them."""
    return {
        "hours": F.when(valid_resolution(), F.col("resolution_hours")),
        "age": F.when(~F.col("is_resolved"), F.col("open_age_days")),
    }


def ticket_counts(profile: TicketProfile) -> dict[str, Column]:
    """Conditions behind the percentages."""
    resolved, age = F.col("is_resolved"), F.col("open_age_days")
    return {
        "resolved": resolved,
        "open": ~resolved,
        "fast": valid_resolution() & (F.col("resolution_hours") <= profile.fast_hours),
        "stale": ~resolved & (age >= profile.stale_days),
        "fresh": ~resolved & (age < profile.fresh_days),
        "answered": resolved & F.col("has_satisfaction"),
        "scored": F.col("has_satisfaction"),
        "low": F.col("is_bottom_box"),
    }


def pick(conditions: dict[str, Column], *names: str) -> dict[str, Column]:
    return {name: conditions[name] for name in names}


def headline_kpis(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """K1: thirteen whole-period measures in one row."""
    counts = ticket_counts(profile)
    counts.pop("fresh")
    row = whole_table(
        tickets,
        ticket_values(),
        counts,
        {"p50": ("hours", 0.5), "p90": ("hours", 0.9), "age_p50": ("age", 0.5)},
    )
    everything = F.col("n")
    return row.select(
        everything.alias("total_tickets"),
        F.col("resolved").alias("resolved_tickets"),
        F.col("open").alias("open_tickets"),
        pct(F.col("open"), everything).alias("backlog_percentage"),
        round_to(F.col("p50"), 2).alias("median_res_hours"),
        round_to(F.col("p90"), 1).alias("p90_res_hours"),
        pct(F.col("fast"), everything).alias("pct_all_resolved_24h"),
        pct(F.col("fast"), F.col("resolved")).alias("pct_resolved_only_24h"),
        round_to(F.col("age_p50")).alias("median_open_age_days"),
        F.col("stale").alias("open_over_180d"),
        F.col("answered").alias("surveyed_tickets"),
        pct(F.col("answered"), F.col("resolved")).alias("response_rate_percentage"),
        pct(F.col("low"), F.col("scored")).alias("low_score_percentage"),
    )


def above_short_scale(profile: TicketProfile) -> Column:
    """A score only the long scale can produce."""
    return F.col("satisfaction_score") > profile.short_scale_max


def score_frequencies(tickets: DataFrame) -> DataFrame:
    """K3 without its order."""
    return (
        tickets.filter("has_satisfaction")
        .groupBy("satisfaction_score")
        .agg(F.count("*").alias("n"))
    )


def score_histogram(tickets: DataFrame) -> DataFrame:
    """K3: tickets per score."""
    return score_frequencies(tickets).orderBy("satisfaction_score")


def duration_bins(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """K4 without its order."""
    label = bucketize(F.col("resolution_hours"), profile.resolution_bins)
    return (
        tickets.filter(valid_resolution())
        .groupBy(label.alias("resolution_bucket"))
        .agg(tickets_in(tickets).alias("n"))
    )


def resolution_distribution(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """K4: valid resolutions per duration bin."""
    return duration_bins(tickets, profile).orderBy("resolution_bucket")


def backlog_bins(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """K5 without its order.

    The window runs over the bins, of which there are as many as labels.
    """
    label = bucketize(F.col("open_age_days"), profile.backlog_age_bins)
    bins = (
        tickets.filter(~F.col("is_resolved"))
        .groupBy(label.alias("age_bucket"))
        .agg(tickets_in(tickets).alias("open_tickets"))
    )
    backlog = F.sum("open_tickets").over(Window.partitionBy())
    return bins.withColumn("pct_of_backlog", pct(F.col("open_tickets"), backlog))


def backlog_age_profile(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """K5: open tickets per age bin with each bin's share."""
    return backlog_bins(tickets, profile).orderBy("age_bucket")


def speed_by_denominator(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """K6: one numerator over two denominators."""
    counts = ticket_counts(profile)
    row = tickets.agg(
        tickets_in(tickets, counts["fast"]).alias("fast"),
        tickets_in(tickets, counts["resolved"]).alias("resolved"),
        tickets_in(tickets).alias("everything"),
    )
    populations = {"resolved tickets only": "resolved", "ALL tickets (honest)": "everything"}
    return unpivot_row(
        row,
        ["population", "denominator", "pct_within_24h"],
        [
            {
                "population": F.lit(label),
                "denominator": F.col(name),
                "pct_within_24h": pct(F.col("fast"), F.col(name)),
            }
            for label, name in populations.items()
        ],
    )


def backlog_age_by_priority(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """B1: how long open work has waited per priority, next to the usual closing time."""
    out = grouped_histogram(
        tickets,
        ["priority"],
        ticket_values(),
        pick(ticket_counts(profile), "open", "stale"),
        [
            total("open").alias("open_tickets"),
            round_to(weighted_quantile("age", 0.5)).alias("median_age_days"),
            F.max("age").alias("max_age_days"),
            total("stale").alias("open_over_180d"),
            round_to(weighted_quantile("hours", 0.5), 2).alias("median_close_hours"),
        ],
    )
    rank = severity_rank(F.col("priority"), profile.priorities_by_severity)
    return out.orderBy(rank.asc_nulls_last())


def backlog_age_summary(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """B2: size and age of the backlog in one row."""
    row = whole_table(
        tickets,
        ticket_values(),
        pick(ticket_counts(profile), "open", "stale", "fresh"),
        {"age_p50": ("age", 0.5), "p50": ("hours", 0.5)},
        [F.max("age").alias("max_age_days")],
    )
    return row.select(
        F.col("open").alias("open_tickets"),
        round_to(F.col("age_p50")).alias("median_age_days"),
        "max_age_days",
        F.col("stale").alias("over_180_days"),
        pct(F.col("stale"), F.col("open")).alias("over_180_percentage"),
        F.col("fresh").alias("under_7_days"),
        pct(F.col("fresh"), F.col("open")).alias("under_7_percentage"),
        round_to(F.col("p50"), 1).alias("median_close_hours"),
    )
