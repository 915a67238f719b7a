"""M1 to M9: put one defect back and see what the headline metric becomes.

The export enters as its distinct rows, or as :func:`count_copies` counted them
where the number of copies matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions.numeric import pct, ratio, round_to
from queuelens.functions.text import folded
from queuelens.functions.timecols import days_between, minutes_between, parse_first
from queuelens.operators.clean import valid_resolution
from queuelens.operators.metrics import pick, ticket_counts, ticket_values
from queuelens.operators.quality import label_counts
from queuelens.plans.shapes import (
    TICKETS,
    side_by_side,
    tickets_in,
    total,
    weighted_quantile,
    whole_table,
)
from queuelens.profile import TicketProfile


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def mat_duplicates(copies: DataFrame, tickets: DataFrame) -> DataFrame:
    """M1: volume when exact copies stay in."""
    row = side_by_side(
        copies.agg(total("copies").alias("volume_if_unhandled")),
        _count(tickets, "volume_correct"),
    )
    extra = F.col("volume_if_unhandled") - F.col("volume_correct")
    return row.select(
        "*",
        extra.alias("overstated_by"),
        pct(extra, F.col("volume_correct"), 2).alias("overstated_pct"),
    )


def month_first_counts(distinct_rows: DataFrame, profile: TicketProfile) -> DataFrame:
    """Raw rows counted by what M2 reads of them when day-first times are taken as month-first.

    Times are parsed here only, once: over the rows themselves, every use of ``hours`` in
    filters and quantiles would parse them again.
    """
    iso = profile.timestamp_formats[0]
    created_text = F.col("created_at")
    slashed = created_text.like(profile.slashed_date_like)
    read = distinct_rows.select(
        slashed.alias("slashed"),
        parse_first(created_text, [profile.month_first_format]).alias("month_first"),
        parse_first(created_text, [iso, profile.month_first_format]).alias("created"),
        parse_first(F.col("resolved_at"), [iso]).alias("resolved"),
    )
    hours = minutes_between(F.col("created"), F.col("resolved")) / F.lit(60.0)
    return read.groupBy(
        hours.alias("hours"), "slashed", F.col("month_first").isNotNull().alias("is_month_first")
    ).agg(F.count("*").alias(TICKETS))


def mat_date_misparsed(
    distinct_rows: DataFrame, tickets: DataFrame, profile: TicketProfile
) -> DataFrame:
    """M2: day-first creation times read as month-first.

    ``distinct_rows`` are raw rows, or :func:`month_first_counts` of them.
    """
    counts = distinct_rows
    if TICKETS not in counts.columns:
        counts = month_first_counts(distinct_rows, profile)
    hours, month_first = F.col("hours"), F.col("is_month_first")
    wrong = whole_table(
        counts,
        {"hours": F.when(hours >= 0, hours)},
        {
            "lost": F.col("slashed") & ~month_first,
            "misread": F.col("slashed") & month_first,
            "negative": hours < 0,
        },
        {"p90": ("hours", 0.9)},
    ).select(
        F.col("lost").alias("rows_lost_entirely"),
        F.col("misread").alias("rows_silently_misparsed"),
        round_to(F.col("p90"), 2).alias("p90_if_unhandled"),
        F.col("negative").alias("negatives_manufactured"),
    )
    right = whole_table(
        tickets,
        pick(ticket_values(), "hours"),
        {"negative": F.col("is_negative_duration")},
        {"p90": ("hours", 0.9)},
    ).select(
        round_to(F.col("p90"), 2).alias("p90_correct"),
        F.col("negative").alias("negatives_real"),
    )
    return side_by_side(wrong, right).select(
        "rows_lost_entirely",
        "rows_silently_misparsed",
        "p90_if_unhandled",
        "p90_correct",
        "negatives_manufactured",
        "negatives_real",
    )


def mat_date_rows_dropped(
    distinct_rows: DataFrame, tickets: DataFrame, profile: TicketProfile
) -> DataFrame:
    """M3: every ticket id with a day-first creation time thrown away.

    "Not among the dropped ids" is three-valued: one NULL among them leaves no
    ticket, and a ticket without id stays only when nothing is dropped.  Tickets
    are counted per (id, hours) before the join, so neither side can carry a hot
    id into it, and the id list is never broadcast by decree.  The match is
    null-safe, and the id list keeps its row count, so that one scan feeds both
    the join and the null check; the rows the match removes in excess are those
    the null check overrules anyway.
    """
    slashed = F.col("created_at").like(profile.slashed_date_like)
    dropped = distinct_rows.filter(slashed).groupBy("ticket_id").agg(F.count("*").alias("rows"))
    ids = dropped.agg(
        total("rows").alias("dropped_rows"),
        F.coalesce(F.sum(F.when(F.col("ticket_id").isNull(), F.col("rows"))), F.lit(0)).alias(
            "dropped_without_id"
        ),
    )
    per_id = tickets.groupBy("ticket_id", ticket_values()["hours"].alias("hours")).agg(
        F.count("*").alias("n")
    )
    kept = per_id.join(
        dropped.filter("rows > 0").select(F.col("ticket_id").alias("dropped_id")),
        F.col("ticket_id").eqNullSafe(F.col("dropped_id")),
        "left_anti",
    )
    by_hours = kept.groupBy("hours").agg(
        total("n").alias("n"),
        F.sum(F.when(F.col("ticket_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"),
    )
    speed = by_hours.agg(
        total("n").alias("kept"),
        total("with_id").alias("kept_with_id"),
        weighted_quantile("hours", 0.5).alias("median"),
        weighted_quantile("hours", 0.9).alias("p90"),
        weighted_quantile("hours", 0.5, "with_id").alias("median_with_id"),
        weighted_quantile("hours", 0.9, "with_id").alias("p90_with_id"),
    )
    row = side_by_side(_count(tickets, "everything"), speed, ids)

    nothing_dropped = F.col("dropped_rows") == 0
    unknowable = F.col("dropped_without_id") > 0
    volume = (
        F.when(nothing_dropped, F.col("kept"))
        .when(unknowable, F.lit(0).cast("bigint"))
        .otherwise(F.col("kept_with_id"))
    )
    lost = F.col("everything") - volume

    def speed_of(name: str):
        known = F.when(nothing_dropped, F.col(name)).otherwise(F.col(f"{name}_with_id"))
        return round_to(F.when(~unknowable, known), 2)

    return row.select(
        volume.alias("volume_if_dropped"),
        lost.alias("tickets_lost"),
        pct(lost, F.col("everything")).alias("pct_of_dataset_lost"),
        speed_of("median").alias("median_if_dropped"),
        speed_of("p90").alias("p90_if_dropped"),
    )


def mat_mean_vs_median(tickets: DataFrame) -> DataFrame:
    """M4: what a few stale tickets do to the mean."""
    row = whole_table(
        tickets.filter(valid_resolution()),
        {"hours": F.col("resolution_hours")},
        {"extreme": F.col("is_extreme_duration")},
        {"median": ("hours", 0.5)},
        [
            F.sum(F.col("hours") * F.col("n")).alias("hour_sum"),
            F.sum(F.when(F.col("hours").isNotNull(), F.col("n"))).alias("timed"),
        ],
    )
    mean, median = ratio(F.col("hour_sum"), F.col("timed")), F.col("median")
    return row.select(
        round_to(mean, 1).alias("mean_hours"),
        round_to(median, 1).alias("median_hours"),
        round_to(F.try_divide(mean, median), 1).alias("mean_is_x_times_median"),
        F.col("extreme").alias("outliers_responsible"),
    )


def mat_missing_as_bad(tickets: DataFrame) -> DataFrame:
    """M5: unsurveyed resolved tickets counted as low scores."""
    unsurveyed = F.col("is_resolved") & ~F.col("has_satisfaction")
    row = tickets.agg(
        tickets_in(tickets, "is_bottom_box").alias("low"),
        tickets_in(tickets, "has_satisfaction").alias("scored"),
        tickets_in(tickets, F.col("is_bottom_box") | unsurveyed).alias("low_or_unsurveyed"),
        tickets_in(tickets, "is_resolved").alias("resolved"),
        tickets_in(tickets, unsurveyed).alias("unsurveyed_resolved"),
    )
    return row.select(
        pct(F.col("low"), F.col("scored")).alias("low_score_correct"),
        pct(F.col("low_or_unsurveyed"), F.col("resolved")).alias(
            "low_score_if_missing_counted_bad"
        ),
        "unsurveyed_resolved",
    )


def mat_not_normalised(copies: DataFrame, tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """M6: label values when free-form spellings are kept."""
    fragment = F.trim(F.col("category")) == profile.merged_category_fragment
    orphaned = {"bill_rows_orphaned": F.when(fragment, F.col("copies"))}
    row = side_by_side(
        label_counts(copies, "values_if_unhandled", orphaned),
        label_counts(tickets, "values_correct"),
    )
    return row.select(
        "category_values_if_unhandled",
        "category_values_correct",
        "channel_values_if_unhandled",
        "channel_values_correct",
        "bill_rows_orphaned",
    )


def mat_survivorship(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """M7: speed when tickets that never closed are left out."""
    row = whole_table(
        tickets,
        pick(ticket_values(), "age"),
        pick(ticket_counts(profile), "fast", "resolved", "open"),
        {"median": ("age", 0.5)},
    )
    return row.select(
        pct(F.col("fast"), F.col("resolved")).alias("pct_24h_if_unhandled"),
        pct(F.col("fast"), F.col("n")).alias("pct_24h_correct"),
        F.col("open").alias("tickets_hidden_by_the_filter"),
        round_to(F.col("median")).alias("median_age_of_the_hidden"),
    )


def mat_bill_billing(
    distinct_rows: DataFrame, tickets: DataFrame, profile: TicketProfile
) -> DataFrame:
    """M8: size of the merged category with and without its truncated spelling."""
    category, merged = F.col("category"), F.lit(profile.merged_category)
    before = distinct_rows.agg(
        F.count_if(folded(category) == F.lower(merged)).alias("billing_without_bill"),
        F.count_if(F.trim(category) == profile.merged_category_fragment).alias("bill_rows"),
    )
    sizes = tickets.groupBy("category").agg(F.count("*").alias("size"))
    size = F.col("size")
    after = sizes.agg(
        F.coalesce(F.sum(F.when(category == merged, size)), F.lit(0).cast("bigint")).alias(
            "billing_after_merge"
        ),
        round_to(F.avg(F.when(category != merged, size))).alias("avg_of_other_4_categories"),
    )
    return side_by_side(before, after)


def mat_pre_hire(tickets: DataFrame, agents: DataFrame) -> DataFrame:
    """M9: tickets older than the employment of the agent they are booked to."""
    early = days_between(F.col("created_at"), F.col("hire_date"))
    affected = tickets.filter("created_before_hire").agg(
        F.count("*").alias("pre_hire_tickets"),
        F.countDistinct("agent_id").alias("agents_affected"),
        round_to(F.avg(early), 1).alias("avg_days_before_hire"),
        F.max(early).alias("max_days_before_hire"),
        F.min("hire_date").alias("earliest_hire_date_affected"),
    )
    return side_by_side(affected, _count(agents, "agents_total")).select(
        "pre_hire_tickets",
        "agents_affected",
        "agents_total",
        "avg_days_before_hire",
        "max_days_before_hire",
        "earliest_hire_date_affected",
    )
