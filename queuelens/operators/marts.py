"""The tables behind the figures, ready for any plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuelens.functions.numeric import pct, round_to, severity_rank
from queuelens.operators.metrics import (
    backlog_bins,
    duration_bins,
    headline_kpis,
    score_histogram,
    ticket_values,
)
from queuelens.operators.mixture import swing_readings
from queuelens.operators.months import by_month, monthly_scale_share
from queuelens.operators.segments import ALL_TICKETS
from queuelens.plans.shapes import (
    grouped_histogram,
    total,
    unpivot_row,
    weighted_quantile,
)
from queuelens.profile import TicketProfile

HIGHLIGHTED_VARIANT = "J"
CUTOVER_PERCENTAGE = 50.0


def mart_score_cliff(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """The score histogram with the scale each score can belong to."""
    short = F.col("satisfaction_score") <= profile.short_scale_max
    return score_histogram(tickets).withColumn(
        "scale_class",
        F.when(short, F.lit("1-5 range (ambiguous scale)")).otherwise(
            F.lit("6-10 (1-10 scale only)")
        ),
    )


def mart_bins(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """R2: both binned distributions with the bin order split from its label."""
    resolution = duration_bins(tickets, profile).select(
        F.lit("resolution").alias("distribution"),
        F.col("resolution_bucket").alias("bin"),
        "n",
        F.lit(None).cast("double").alias("percentage"),
    )
    backlog = backlog_bins(tickets, profile).select(
        F.lit("backlog age").alias("distribution"),
        F.col("age_bucket").alias("bin"),
        F.col("open_tickets").alias("n"),
        F.col("pct_of_backlog").alias("percentage"),
    )
    parts = F.split("bin", ": ")
    return (
        resolution.unionByName(backlog)
        .select(
            "distribution",
            parts[0].cast("int").alias("position"),
            parts[1].alias("label"),
            "n",
            "percentage",
        )
        .orderBy("distribution", "position")
    )


def mart_trend_labels(cube: DataFrame) -> DataFrame:
    """Monthly volume, speed, low-score rate and residue, with month labels.

    The reference rate is that of all tickets, the partial month included; it
    is added up from the monthly rows before the partial month is left out.
    """
    months = by_month(cube, partial=True).groupBy("month", "is_partial_month").agg(
        total("n").alias("volume"),
        round_to(weighted_quantile("hours", 0.5), 2).alias("median_hrs"),
        total("low").alias("low"),
        total("scored").alias("scored"),
        total("open").alias("still_open"),
    )
    everything = Window.partitionBy()
    reference = pct(F.sum("low").over(everything), F.sum("scored").over(everything))
    return (
        months.withColumn("reference_low_score_percentage", reference)
        .filter(~F.col("is_partial_month"))
        .select(
            "month",
            F.date_format("month", "MMM yy").alias("month_label"),
            "volume",
            "median_hrs",
            pct(F.col("low"), F.col("scored")).alias("low_score_percentage"),
            "reference_low_score_percentage",
            "still_open",
            pct(F.col("still_open"), F.col("volume")).alias("pct_still_open"),
        )
        .orderBy("month")
    )


def mart_swing_ranked(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """The readings of X3 by value, with their number and range."""
    everything = Window.partitionBy()
    value = F.col("satisfaction_percentage")
    lowest, highest = F.min(value).over(everything), F.max(value).over(everything)
    return (
        swing_readings(tickets, profile)
        .select(
            "variant",
            "approach",
            value,
            (F.col("variant") == HIGHLIGHTED_VARIANT).alias("is_highlighted"),
            F.count("*").over(everything).alias("methods"),
            lowest.alias("lowest"),
            highest.alias("highest"),
            round_to(highest - lowest, 1).alias("range_points"),
        )
        .orderBy("satisfaction_percentage", "variant")
    )


def mart_scale_cutover(cube: DataFrame, profile: TicketProfile) -> DataFrame:
    """The monthly detector next to what a mid-period migration would have shown."""
    everything = Window.partitionBy()
    actual = F.col("score_above_5_percentage")
    position = F.row_number().over(Window.orderBy("month"))
    first_half = position <= F.floor(F.count("*").over(everything) / 2)
    return (
        monthly_scale_share(cube, profile)
        .select(
            "month",
            F.date_format("month", "MMM").alias("month_label"),
            actual.alias("actual_percentage"),
            round_to(F.avg(actual).over(everything), 4).alias("mean_percentage"),
            F.when(first_half, F.lit(0.0))
            .otherwise(F.lit(CUTOVER_PERCENTAGE))
            .alias("cutover_percentage"),
        )
        .orderBy("month")
    )


def mart_dashboard_tiles(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """The KPI tiles of the dashboard; exactly one of them is an alert."""
    tiles = [
        ("Tickets (period)", "total_tickets", "tickets", False),
        ("Resolved < 24h (of ALL tickets)", "pct_all_resolved_24h", "%", False),
        ("Open backlog", "open_tickets", "tickets", False),
        ("Median age of open work", "median_open_age_days", "days", True),
        ("Survey response rate", "response_rate_percentage", "%", False),
        ("Median close", "median_res_hours", "hours", False),
    ]
    backlog_share = F.col("backlog_percentage")
    return unpivot_row(
        headline_kpis(tickets, profile),
        ["position", "tile", "value", "unit", "share_percentage", "is_alert"],
        [
            {
                "position": F.lit(position),
                "tile": F.lit(label),
                "value": F.col(measure).cast("double"),
                "unit": F.lit(unit),
                "share_percentage": backlog_share
                if measure == "open_tickets"
                else F.lit(None).cast("double"),
                "is_alert": F.lit(alert),
            }
            for position, (label, measure, unit, alert) in enumerate(tiles, start=1)
        ],
    )


def mart_priority_panel(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Hours to close and days waiting per priority, against the overall median.

    Overall and per-priority figures come from the same pass over the tickets.
    The panel shows the listed priorities only, which also bounds the window.
    """
    priority = F.col("priority")
    listed = F.when(priority.isin(*profile.priorities_by_severity), priority)
    figures = grouped_histogram(
        tickets,
        [],
        ticket_values(),
        {"open": ~F.col("is_resolved")},
        [
            round_to(weighted_quantile("hours", 0.5), 2).alias("median_hrs"),
            round_to(weighted_quantile("age", 0.5)).alias("median_age_days"),
            total("open").alias("open_tickets"),
        ],
        {ALL_TICKETS: F.lit(ALL_TICKETS), "priority": listed},
    )
    overall = F.max(F.when(F.col("dimension") == ALL_TICKETS, F.col("median_hrs")))
    rank = severity_rank(F.col("segment"), profile.priorities_by_severity)
    return (
        figures.withColumn("overall_median_hrs", overall.over(Window.partitionBy()))
        .filter((F.col("dimension") == "priority") & F.col("segment").isNotNull())
        .select(
            rank.alias("severity_rank"),
            F.col("segment").alias("priority"),
            "median_hrs",
            "overall_median_hrs",
            "open_tickets",
            "median_age_days",
        )
        .orderBy("severity_rank")
    )
