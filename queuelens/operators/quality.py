"""Q1 to Q7: the before/after report of the cleaning step as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.numeric import round_to
from queuelens.operators.clean import valid_resolution
from queuelens.operators.metrics import pick, ticket_counts, ticket_values
from queuelens.plans.shapes import (
    group_by_each,
    side_by_side,
    total,
    unpivot_row,
    whole_table,
)
from queuelens.profile import TicketProfile
from queuelens.sources.files import BROKEN_COLUMN


def raw_row_counts(copies: DataFrame) -> DataFrame:
    """Rows, distinct rows and broken lines of the export, from its counted copies."""
    broken = F.sum(F.when(F.col(BROKEN_COLUMN).isNotNull(), F.col("copies")))
    return copies.agg(
        total("copies").alias("raw_rows"),
        F.count("*").alias("raw_distinct"),
        F.coalesce(broken, F.lit(0).cast("bigint")).alias("broken_rows"),
    )


def fingerprint(columns: Sequence[str], times: Column | None = None) -> Column:
    """Order-free sum of row hashes, a row counting ``times``; 0 over no rows."""
    value = F.xxhash64(*columns).cast("decimal(38,0)")
    if times is not None:
        value = value * times.cast("decimal(18,0)")
    return F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def control_totals(lines: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: filled lines of the files without headers, and a fingerprint of the rows read.

    ``lines`` are those of ``sources.files.export_lines``, which no CSV parser has touched.
    """
    read = raw.agg(fingerprint(raw.columns).alias("read_print"))
    return side_by_side(lines.agg(F.count("*").alias("export_lines")), read)


def qa_row_counts(copies: DataFrame, tickets: DataFrame) -> DataFrame:
    """Q1: rows before and after, duplicates removed, broken lines, width of the clean table."""
    row = side_by_side(raw_row_counts(copies), tickets.agg(F.count("*").alias("clean_rows")))
    return row.select(
        "raw_rows",
        "raw_distinct",
        (F.col("raw_rows") - F.col("raw_distinct")).alias("duplicates_removed"),
        "broken_rows",
        "clean_rows",
        F.lit(len(tickets.columns)).alias("clean_columns"),
    )


LABELS = ("channel", "category")


def label_counts(df: DataFrame, suffix: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: distinct channels and categories, and the ``sums`` of columns over all rows.

    Values are counted per column first, by grouping sets, and then the values: two plain
    aggregates, of which the second sees one row per value.
    """
    sums = sums or {}
    values = group_by_each(
        df,
        {name: F.col(name) for name in LABELS},
        [F.count("*").alias("n"), *[F.sum(column).alias(name) for name, column in sums.items()]],
    )
    known, once = F.col("segment").isNotNull(), F.col("dimension") == LABELS[0]
    return values.agg(
        *[
            F.count_if(known & (F.col("dimension") == name)).alias(f"{name}_{suffix}")
            for name in LABELS
        ],
        *[
            F.coalesce(F.sum(F.when(once, F.col(name))), F.lit(0).cast("bigint")).alias(name)
            for name in sums
        ],
    )


def qa_distinct_before_after(distinct_rows: DataFrame, tickets: DataFrame) -> DataFrame:
    """Q2: distinct channel and category values before and after."""
    return side_by_side(label_counts(distinct_rows, "before"), label_counts(tickets, "after"))


def qa_value_counts(tickets: DataFrame, column: str) -> DataFrame:
    """Q3: value frequencies, most frequent first."""
    return (
        tickets.groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last(column))
    )


def qa_flag_counts(tickets: DataFrame) -> DataFrame:
    """Q4: one row per data-quality flag with the rows it marks."""
    flags = {
        "open_backlog": ~F.col("is_resolved"),
        "negative_duration": F.col("is_negative_duration"),
        "extreme_gt_30d": F.col("is_extreme_duration"),
        "resolved_after_extract": F.col("is_future_resolution"),
        "created_before_hire": F.col("created_before_hire"),
        "missing_agent": F.col("missing_agent"),
        "id_conflict_rows": F.col("is_id_conflict"),
        "missing_satisfaction": ~F.col("has_satisfaction"),
        "partial_month": F.col("is_partial_month"),
    }
    row = tickets.agg(*[F.count_if(condition).alias(name) for name, condition in flags.items()])
    return unpivot_row(
        row, ["flag", "count"], [{"flag": F.lit(name), "count": F.col(name)} for name in flags]
    )


def qa_unparsed_created(tickets: DataFrame) -> DataFrame:
    """Q5: rows whose creation time fits no known format."""
    return tickets.filter(F.col("created_at").isNull()).agg(
        F.count("*").alias("unparsed_created_at")
    )


def qa_resolution_summary(tickets: DataFrame) -> DataFrame:
    """Q6: durations of ordinary resolutions (neither negative nor extreme)."""
    ordinary = tickets.filter(valid_resolution() & ~F.col("is_extreme_duration"))
    row = whole_table(
        ordinary,
        {"hours": F.col("resolution_hours")},
        {},
        {"p50": ("hours", 0.5), "p90": ("hours", 0.9)},
        [F.min("hours").alias("least"), F.max("hours").alias("most")],
    )
    return row.select(
        round_to(F.col("p50"), 2).alias("p50"),
        round_to(F.col("p90"), 1).alias("p90"),
        round_to(F.col("least"), 2).alias("min_h"),
        round_to(F.col("most"), 1).alias("max_h"),
    )


def qa_open_age_summary(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Q7: size and age of the backlog at the extract date."""
    row = whole_table(
        tickets.filter(~F.col("is_resolved")),
        {"age": ticket_values()["age"]},
        pick(ticket_counts(profile), "stale"),
        {"p50": ("age", 0.5)},
        [F.max("age").alias("max_age_days")],
    )
    return row.select(
        F.col("n").alias("open_tickets"),
        round_to(F.col("p50")).alias("median_age_days"),
        "max_age_days",
        F.col("stale").alias("older_than_180d"),
    )
