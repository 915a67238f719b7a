"""Sign-off checks to run before anyone trusts a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.numeric import bucketize, pct, round_to
from queuelens.functions.timecols import date_lit
from queuelens.operators.clean import valid_resolution
from queuelens.operators.months import by_month
from queuelens.operators.quality import fingerprint, raw_row_counts
from queuelens.plans.shapes import group_by_each, side_by_side, tickets_in, total
from queuelens.profile import TicketProfile

RESPONSE_DIMENSIONS = ("brand", "channel", "priority")


def _verdict(passed: Column, failed: str = "FAIL") -> Column:
    return F.when(passed, F.lit("PASS")).otherwise(F.lit(failed))


def _answered() -> Column:
    return F.count_if(F.col("is_resolved") & F.col("has_satisfaction"))


def _resolved() -> Column:
    return F.count_if("is_resolved")


def check_reconciliation(copies: DataFrame, tickets: DataFrame, control: DataFrame) -> DataFrame:
    """V1: no row was lost, split, changed or invented on the way from the files to the clean table.

    ``control`` is the one row of ``control_totals``, taken from the files without the stages
    that are checked.  The export has as many filled lines as the counted copies stand for
    and none of them is broken; counted copies have the rows of the files, by an order-free
    fingerprint; and the clean table has the ids of the distinct rows, each as often.
    """
    ids = ["ticket_id"]
    counted = copies.agg(
        fingerprint([c for c in copies.columns if c != "copies"], F.col("copies")).alias("counted_print"),
        fingerprint(ids).alias("distinct_ids"),
    )
    cleaned = tickets.agg(F.count("*").alias("clean_rows"), fingerprint(ids).alias("clean_ids"))
    row = side_by_side(raw_row_counts(copies), counted, cleaned, control)
    same = (F.col("counted_print") == F.col("read_print")) & (
        F.col("distinct_ids") == F.col("clean_ids")
    )
    passed = (
        (F.col("clean_rows") == F.col("raw_distinct"))
        & (F.col("broken_rows") == 0)
        & (F.col("raw_rows") == F.col("export_lines"))
        & same
    )
    return row.select(
        "raw_rows",
        "raw_distinct",
        "broken_rows",
        "clean_rows",
        "export_lines",
        F.coalesce(same, F.lit(False)).alias("same_rows"),
        _verdict(passed).alias("reconciliation"),
    )


def check_no_negatives(tickets: DataFrame) -> DataFrame:
    """V2: no impossible duration reaches a speed metric."""
    row = tickets.filter(valid_resolution()).agg(
        tickets_in(tickets, F.col("resolution_hours") < 0).alias("negatives_in_metric_input")
    )
    return row.withColumn(
        "check_no_negatives", _verdict(F.col("negatives_in_metric_input") == 0)
    )


def response_rate_by_segment(tickets: DataFrame) -> DataFrame:
    """V3: survey response per brand, channel and priority."""
    return (
        group_by_each(
            tickets,
            {name: F.col(name) for name in RESPONSE_DIMENSIONS},
            [_resolved().alias("resolved"), _answered().alias("answered")],
        )
        .select(
            "dimension",
            F.col("segment").alias("value"),
            "resolved",
            pct(F.col("answered"), F.col("resolved")).alias("response_rate_percentage"),
        )
        .orderBy("dimension", F.desc_nulls_last("response_rate_percentage"))
    )


def domain_rules(profile: TicketProfile) -> dict[str, Column]:
    """What makes a value illegal, per column; NULL is never an offender."""
    score = F.col("satisfaction_score")
    return {
        "bad_satisfaction": ~score.between(1, profile.long_scale_max),
        "bad_priority": ~F.col("priority").isin(*profile.priorities_by_severity),
        "bad_channel": ~F.col("channel").isin(*profile.channels),
        "bad_category": ~F.col("category").isin(*profile.categories),
        "bad_brand": ~F.col("brand").isin(*profile.brands),
    }


def check_domains(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """V4: out-of-domain values per column and the overall verdict."""
    rules = domain_rules(profile)
    row = tickets.agg(*[F.count_if(offends).alias(name) for name, offends in rules.items()])
    return row.withColumn("domain_checks", _verdict(F.greatest(*rules) == 0))


def check_window_bounds(tickets: DataFrame) -> DataFrame:
    """V5: first and last creation, and the rows trends leave out."""
    return tickets.agg(
        F.min("created_at").alias("first_created"),
        F.max("created_at").alias("last_created"),
        F.count_if("is_partial_month").alias("partial_month_rows"),
    )


def response_rate_by_speed(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """V6: are slow tickets surveyed less?"""
    label = bucketize(F.col("resolution_hours"), profile.survey_speed_bins)
    return (
        tickets.filter(valid_resolution())
        .groupBy(label.alias("speed_bucket"))
        .agg(
            tickets_in(tickets).alias("resolved"),
            pct(tickets_in(tickets, "has_satisfaction"), tickets_in(tickets)).alias(
                "response_rate_percentage"
            ),
        )
        .orderBy("speed_bucket")
    )


def response_rate_by_month(cube: DataFrame) -> DataFrame:
    """V7: is survey coverage drifting?"""
    months = by_month(cube).groupBy("month").agg(
        total("resolved").alias("resolved"),
        pct(total("answered"), total("resolved")).alias("response_rate_percentage"),
    )
    return months.orderBy("month")


def check_future_timestamps(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """V8: resolutions dated after the extract."""
    row = tickets.agg(
        F.count_if("is_future_resolution").alias("resolved_after_extract"),
        F.max("resolved_at").alias("latest_resolution"),
    )
    return row.select(
        "resolved_after_extract",
        "latest_resolution",
        date_lit(profile.extract_date).alias("extract_date"),
        _verdict(F.col("resolved_after_extract") == 0, "FLAG (kept in metric)").alias("status"),
    )


def activity_on_both_clocks(cube: DataFrame) -> DataFrame:
    """V9: creations and resolutions on one month axis."""
    closed = F.col("reading") == "closed"
    month = F.when(closed, F.col("resolved_month")).otherwise(F.col("month"))
    clocks = cube.filter(closed | (F.col("reading") == "speed")).withColumn("month", month)

    def on(clock: Column) -> Column:
        return F.sum(F.when(clock, F.col("n")).otherwise(0))

    return (
        clocks.filter(month.isNotNull())
        .groupBy("month")
        .agg(on(~closed).alias("tickets_created"), on(closed).alias("tickets_resolved"))
        .orderBy("month")
    )


def check_duration_gap(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Is the slow tail continuous, or a cluster behind an empty gap?"""
    hours, extreme = F.col("resolution_hours"), F.col("is_extreme_duration")
    return tickets.filter(valid_resolution()).agg(
        round_to(F.max(F.when(~extreme, hours)), 1).alias("last_ordinary_value"),
        round_to(F.min(F.when(extreme, hours)), 1).alias("first_extreme_value"),
        tickets_in(tickets, hours.between(*profile.gap_hours)).alias("tickets_in_the_gap"),
        tickets_in(tickets, extreme).alias("extreme_tickets"),
    )
