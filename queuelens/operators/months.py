"""Tickets counted by calendar: what reports by month and by weekday share.

Eight reports look at tickets by month or weekday.  They read one written table of counts,
made in one scan and one shuffle by grouping sets; the calendar bounds its rows, since
durations are whole minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.numeric import pct
from queuelens.functions.timecols import month_start, weekday_name, weekday_number
from queuelens.operators.metrics import pick, ticket_counts, ticket_values
from queuelens.plans.shapes import total
from queuelens.profile import TicketProfile

COUNTS = ("open", "resolved", "answered", "scored", "low")

# What a row of the cube is counted by.
READINGS = {
    "speed": ("month", "is_partial_month", "hours"),
    "score": ("month", "is_partial_month", "score"),
    "weekday": ("day_of_week", "day_name", "hours"),
    "closed": ("resolved_month",),
}


def month_cube(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """(reading, the columns of all readings, n, one column per count).

    The reading says by which columns a row is counted; the others are NULL in it.
    """
    created = F.col("created_at")
    columns = {
        "month": month_start(created),
        "is_partial_month": F.col("is_partial_month"),
        "day_of_week": weekday_number(created),
        "day_name": weekday_name(created),
        "hours": ticket_values()["hours"],
        "score": F.col("satisfaction_score"),
        "resolved_month": month_start(F.col("resolved_at")),
    }
    conditions = pick(ticket_counts(profile), *COUNTS)
    staged = tickets.select(
        *[column.alias(name) for name, column in columns.items()],
        *[F.when(c, 1).otherwise(0).alias(f"is_{name}") for name, c in conditions.items()],
    )
    # readings differ in which of these they are counted by
    by = {name: F.grouping(name) == 0 for name in ("month", "score", "day_of_week")}
    reading = (
        F.when(by["score"], F.lit("score"))
        .when(by["month"], F.lit("speed"))
        .when(by["day_of_week"], F.lit("weekday"))
        .otherwise(F.lit("closed"))
    )
    return staged.groupingSets([list(by) for by in READINGS.values()], *columns).agg(
        reading.alias("reading"),
        F.count("*").alias("n"),
        *[F.sum(f"is_{name}").alias(name) for name in conditions],
    )


def by_month(cube: DataFrame, reading: str = "speed", partial: bool = False) -> DataFrame:
    """Rows of a reading; without ``partial``, those of full months only."""
    rows = cube.filter(F.col("reading") == reading)
    return rows if partial else rows.filter(~F.col("is_partial_month"))


def monthly_scale_share(cube: DataFrame, profile: TicketProfile) -> DataFrame:
    """K2 without its order."""
    above = F.when(F.col("score") > profile.short_scale_max, F.col("scored")).otherwise(0)
    return (
        by_month(cube, "score")
        .withColumn("above", above)
        .groupBy("month")
        .agg(
            total("scored").alias("scored"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
            pct(total("above"), total("scored")).alias("score_above_5_percentage"),
        )
    )


def scale_evidence_monthly(cube: DataFrame, profile: TicketProfile) -> DataFrame:
    """K2: per full month, the scored count, score range and share above the short scale."""
    return monthly_scale_share(cube, profile).orderBy("month")
