"""Significance tests.

The statistic comes out of distributed aggregates and is reduced to counts on
the way, so nothing row-sized reaches a single task; the p-value is a Column.
Totals come back to the counts as scalar subqueries.
The one window without a partition runs over days of duration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.functions.numeric import ratio, round_to
from queuelens.functions.tails import chi2_tail, normal_two_sided
from queuelens.operators.clean import valid_resolution
from queuelens.operators.metrics import above_short_scale
from queuelens.operators.mixture import score_counts
from queuelens.plans.shapes import group_by_each
from queuelens.profile import TicketProfile

LOW_SCORE_DIMENSIONS = ("category", "channel", "brand", "priority")
SCALE_DIMENSIONS = ("brand", "channel", "team", "location")
HOURS_PER_RANK_BUCKET = 24


def _verdict(p: Column, profile: TicketProfile, quiet: str, loud: str) -> Column:
    return F.when(p > profile.significance, F.lit(quiet)).when(p.isNotNull(), F.lit(loud))


def _with_p(df: DataFrame, profile: TicketProfile, quiet: str, loud: str) -> DataFrame:
    """Adds p_value and verdict to a frame with ``chi2`` and ``dof``; rounds the statistic."""
    p = chi2_tail("chi2", "dof")
    return (
        df.withColumn("p_value", p)
        .withColumn("verdict", _verdict(F.col("p_value"), profile, quiet, loud))
        .withColumns(
            {"chi2": round_to(F.col("chi2"), 4), "p_value": round_to(F.col("p_value"), 4)}
        )
    )


def chi2_independence(
    tickets: DataFrame, dimensions: Sequence[str], hit: Column, null_segments: bool
) -> DataFrame:
    """Tests of "``hit`` does not depend on the segment", one per dimension, in one job.

    ``null_segments`` says whether rows without a segment form one of their
    own.  A 2x2 table gets Yates' continuity correction.
    """
    scored = tickets.filter("has_satisfaction")
    table = group_by_each(
        scored,
        {name: F.col(name) for name in dimensions},
        [F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")],
    )
    if not null_segments:
        table = table.filter(F.col("segment").isNotNull())

    # one row per dimension, summed from the table itself: partial sums meet, not labels
    per_dimension = table.groupBy("dimension").agg(
        F.struct(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).alias("totals")
    )
    totals = per_dimension.agg(
        F.map_from_entries(F.collect_list(F.struct("dimension", "totals")))
    ).scalar()
    margins = table.withColumn("totals", F.element_at(totals, F.col("dimension")))
    size = F.col("hits") + F.col("misses")
    everything = F.col("totals.hits") + F.col("totals.misses")

    def cell(column: str, corrected: bool) -> Column:
        expected = ratio(size * F.col(f"totals.{column}").cast("double"), everything)
        distance = F.abs(F.col(column) - expected)
        if corrected:
            distance = F.greatest(distance - F.lit(0.5), F.lit(0.0))
        return F.try_divide(distance * distance, expected)

    def statistic(corrected: bool) -> Column:
        return F.sum(cell("hits", corrected) + cell("misses", corrected))

    segments = F.count("*")
    return margins.groupBy("dimension").agg(
        F.when(segments == 2, statistic(True)).otherwise(statistic(False)).alias("chi2"),
        (segments - 1).alias("dof"),
    )


def _independence_report(tests: DataFrame, profile: TicketProfile) -> DataFrame:
    return _with_p(tests, profile, "NOT significant (within noise)", "SIGNIFICANT").orderBy(
        "dimension"
    )


def chi2_low_score_by_dim(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Does the low-score rate depend on category, channel, brand or priority?"""
    hit = F.col("is_bottom_box")
    return _independence_report(
        chi2_independence(tickets, LOW_SCORE_DIMENSIONS, hit, null_segments=True), profile
    )


def chi2_scale_by_dim(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Does the share of long-scale scores depend on brand, channel, team or location?"""
    hit = above_short_scale(profile)
    return _independence_report(
        chi2_independence(tickets, SCALE_DIMENSIONS, hit, null_segments=False), profile
    )


def _range_midranks(counts: DataFrame, value: str, group: str, bucket_width: float) -> DataFrame:
    """Adds midrank ``rank``, tie size ``ties`` and overall size ``total`` to (value, group, n).

    Ranks need a running count over all values.  It is taken inside buckets of
    the value range in parallel and shifted by the bucket's offset, which comes
    from one row per bucket; no step orders all values in one task.  The
    null-safe match lets both sides read the same shuffle: a plain one would
    push a NULL filter into one of them and scan the tickets twice.
    """
    bucketed = counts.withColumn("bucket", F.floor(F.col(value) / F.lit(float(bucket_width))))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("bucket")
        .agg(F.sum("n").alias("in_bucket"))
        .select(
            F.col("bucket").alias("offset_of"),
            F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"),
            F.sum("in_bucket").over(Window.partitionBy()).alias("total"),
        )
    )
    upto = Window.partitionBy("bucket").orderBy(value)  # RANGE frame: ties included
    same = Window.partitionBy("bucket", value)
    ranked = bucketed.withColumns(
        {"upto": F.sum("n").over(upto), "ties": F.sum("n").over(same)}
    ).join(offsets, F.col("bucket").eqNullSafe(F.col("offset_of")))
    rank = F.col("offset") + F.col("upto") - F.col("ties") + (F.col("ties") + 1) / F.lit(2.0)
    return ranked.select(value, group, "n", "ties", "total", rank.alias("rank"))


def kruskal_wallis(df: DataFrame, value: str, group: str, bucket_width: float) -> DataFrame:
    """Tie-corrected H over the groups of ``df``: one row with chi2 (H), dof, groups and n.

    Ranks enter as distances from the mean rank, which avoids subtracting two
    huge sums.  Everything past the first aggregate works on value counts.
    """
    counts = df.groupBy(value, group).agg(F.count("*").alias("n"))
    ranked = _range_midranks(counts, value, group, bucket_width)
    n, ties = F.col("n").cast("double"), F.col("ties").cast("double")
    centred = F.col("rank") - (F.col("total") + 1) / F.lit(2.0)
    per_group = ranked.groupBy(group).agg(
        F.sum("n").alias("size"),
        F.sum(n * centred).alias("rank_sum"),
        F.sum(n * (ties * ties - 1.0)).alias("tie_sum"),
    )
    size = F.sum("size").cast("double")
    spread = F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size"))
    h = F.try_divide(F.lit(12.0) * spread, size * (size + 1.0))
    correction = F.lit(1.0) - F.try_divide(F.sum("tie_sum"), size * (size * size - 1.0))
    return per_group.agg(
        F.sum("size").alias("n"),
        F.count("*").alias("groups"),
        F.try_divide(h, correction).alias("chi2"),
        (F.count("*") - 1).alias("dof"),
    )


def kruskal_resolution_by_priority(
    tickets: DataFrame, profile: TicketProfile, hours_per_bucket: float = HOURS_PER_RANK_BUCKET
) -> DataFrame:
    """Does resolution time differ between priorities?"""
    valid = tickets.filter(
        valid_resolution()
        & F.col("resolution_hours").isNotNull()
        & F.col("priority").isin(*profile.priorities_by_severity)
    )
    test = kruskal_wallis(valid, "resolution_hours", "priority", hours_per_bucket)
    return _with_p(
        test, profile, "NOT significant (priority does not change speed)", "SIGNIFICANT"
    ).withColumnRenamed("chi2", "h_statistic")


def two_prop_z_cells(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """I4: every category x channel cell against the overall low-score rate.

    The overall group contains the cell, as in the usual "cell versus total"
    reading.  Scanning many cells makes some look significant by chance, hence
    the Bonferroni bar next to the plain one.  Worst-looking cells come first.
    """
    cells = tickets.groupBy("category", "channel").agg(
        F.count_if("has_satisfaction").alias("cell_n"),
        F.count_if("is_bottom_box").alias("cell_low"),
    )
    totals = cells.agg(
        F.struct(
            F.sum("cell_n").alias("n"), F.sum("cell_low").alias("low"), F.count("*").alias("cells")
        )
    ).scalar()
    counted = cells.withColumn("totals", totals).withColumns(
        {
            "all_n": F.col("totals.n"),
            "all_low": F.col("totals.low"),
            "cells": F.col("totals.cells"),
        }
    )
    cell_n, cell_low = F.col("cell_n"), F.col("cell_low")
    all_n, all_low = F.col("all_n"), F.col("all_low")
    rate, overall = ratio(cell_low, cell_n), ratio(all_low, all_n)
    pooled = ratio(cell_low + all_low, cell_n + all_n)
    inverse_sizes = F.try_divide(F.lit(1.0), cell_n) + F.try_divide(F.lit(1.0), all_n)
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * inverse_sizes)
    tested = counted.withColumn("z", F.try_divide(rate - overall, error)).withColumn(
        "p", normal_two_sided("z")
    )
    threshold = F.lit(profile.significance) / F.col("cells")
    return tested.orderBy(rate.desc_nulls_last(), "category", "channel").select(
        "category",
        "channel",
        "cell_n",
        round_to(F.lit(100.0) * rate, 1).alias("cell_percentage"),
        round_to(F.lit(100.0) * overall, 1).alias("overall_percentage"),
        round_to(F.col("z"), 4).alias("z"),
        round_to(F.col("p"), 4).alias("p_value"),
        (F.col("p") < profile.significance).alias("below_plain_threshold"),
        round_to(threshold, 6).alias("bonferroni_threshold"),
        (F.col("p") < threshold).alias("survives_correction"),
    )


def _gof(observed: str, expected: str) -> Column:
    """Chi-square distance of two arrays."""
    terms = f"zip_with({observed}, {expected}, (o, e) -> try_divide((o - e) * (o - e), e))"
    return F.expr(f"aggregate({terms}, 0D, (a, x) -> a + x)")


def _gof_report(
    row: DataFrame, chi2: Column, dof: int, profile: TicketProfile, quiet: str, loud: str
) -> DataFrame:
    test = row.select(chi2.alias("chi2"), F.lit(dof).cast("bigint").alias("dof"))
    return _with_p(test, profile, quiet, loud)


def gof_upper_scores(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Are scores that only the long scale has evenly spread?"""
    short, high = profile.short_scale_max, profile.long_scale_max - profile.short_scale_max
    chi2 = _gof(f"slice(observed, {short + 1}, {high})", f"array_repeat(h, {high})")
    return _gof_report(
        score_counts(tickets, profile), chi2, high - 1, profile, "yes, flat", "no"
    )


def gof_lower_scores(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Is what remains of scores 1-5 evenly spread once the long scale is taken off?"""
    short = profile.short_scale_max
    implied = score_counts(tickets, profile).select(
        F.expr(f"transform(slice(observed, 1, {short}), n -> n - h)").alias("implied")
    )
    mean = f"aggregate(implied, 0D, (a, n) -> a + n) / {short}D"
    chi2 = _gof("implied", f"array_repeat({mean}, {short})")
    return _gof_report(implied, chi2, short - 1, profile, "yes, flat", "no")


def _mixture_chi2(profile: TicketProfile) -> Column:
    """Distance of ``observed`` from two evenly spread groups, given ``h`` and ``scored``."""
    short, high = profile.short_scale_max, profile.long_scale_max - profile.short_scale_max
    return _gof(
        "observed",
        f"concat(array_repeat(scored / {short}D - h, {short}), array_repeat(h, {high}))",
    )


def _mixture_dof(profile: TicketProfile) -> int:
    return profile.long_scale_max - 1 - 2  # both group sizes come from the data


def gof_full_mixture(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Does the two-group model fit the whole histogram?"""
    return _gof_report(
        score_counts(tickets, profile),
        _mixture_chi2(profile),
        _mixture_dof(profile),
        profile,
        "MODEL FITS",
        "model rejected",
    )
