"""Separating two unmarked rating scales at population level.

Scores above the short scale exist only on the long one, so their mean count
``h`` is the long scale's height at every score; what scores on the short range
hold beyond ``h`` came from the short scale.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.numeric import pct, ratio, round_to
from queuelens.operators.metrics import above_short_scale, score_frequencies
from queuelens.operators.segments import ALL_TICKETS
from queuelens.plans.shapes import group_by_each, unpivot_row
from queuelens.profile import TicketProfile

DETECTOR_DIMENSIONS = ("brand", "channel", "team", "location")
Z_95 = 1.96

# The ten readings of "satisfaction", as they are labelled in the report.
SWING_LABELS = {
    "A": 'Naive mean, reported as "out of 10"',
    "B": 'Naive mean, reported as "out of 5"',
    "C": "Normalise everything as 1-10: (x-1)/9",
    "D": "Normalise everything as 1-5: (x-1)/4",
    "E": "Rule: score >5 came from 1-10, else 1-5",
    "F": "Top-box, scale-aware (4-5 or 8-10)",
    "G": "Top-box, naive (>=4)",
    "H": "100 - bottom-box(1-2)  [the old instrument]",
    "I": "100 - bottom(1-3)",
    "J": "Mixture model: the defensible answer",
}
MIDPOINT_PERCENTAGE = 50.0


def scale_deconvolution(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Each observed score split into its two scales, next to the even-spread model."""
    observed = score_frequencies(tickets).select(
        F.col("satisfaction_score").alias("score"), F.col("n").alias("observed")
    )
    high = F.when(F.col("score") > profile.short_scale_max, F.col("observed"))
    model = observed.agg(
        F.struct(F.avg(high).alias("h"), F.sum("observed").alias("total"))
    ).scalar()
    modelled = observed.withColumn("model", model).select(
        "score", "observed", F.col("model.h").alias("h"), F.col("model.total").alias("total")
    )
    short = F.col("score") <= profile.short_scale_max
    even_short = F.col("total") / F.lit(float(profile.short_scale_max)) - F.col("h")
    return modelled.select(
        "score",
        "observed",
        round_to(F.col("h"), 1).alias("from_1_10_scale"),
        F.when(short, round_to(F.col("observed") - F.col("h"), 1)).alias("from_1_5_scale"),
        round_to(F.when(short, even_short).otherwise(F.col("h")), 1).alias("expected_if_random"),
    ).orderBy("score")


def with_scale_model(counts: DataFrame, profile: TicketProfile) -> DataFrame:
    """Adds the two numbers the mixture is made of to frames with ``observed``.

    ``observed`` is an array with the count of every score from 1 up, ``h`` the
    height of the long scale and ``scored`` the total.
    """
    short, high = profile.short_scale_max, profile.long_scale_max - profile.short_scale_max
    return counts.withColumns(
        {
            "h": F.expr(
                f"aggregate(slice(observed, {short + 1}, {high}), 0D, (a, n) -> a + n) / {high}D"
            ),
            "scored": F.expr("aggregate(observed, 0L, (a, n) -> a + n)"),
        }
    )


def score_counts(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """One row with ``observed``, ``h`` and ``scored``; absent scores count 0."""
    scores = range(1, profile.long_scale_max + 1)
    cells = ", ".join(f"count_if(satisfaction_score = {s})" for s in scores)
    return with_scale_model(tickets.agg(F.expr(f"array({cells})").alias("observed")), profile)


def population_sizes(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Unrounded group sizes ``n_long`` and ``n_short`` next to ``observed`` and ``scored``."""
    n_long = F.col("h") * F.lit(float(profile.long_scale_max))
    return score_counts(tickets, profile).select(
        "observed", "scored", n_long.alias("n_long"), (F.col("scored") - n_long).alias("n_short")
    )


def scale_population_split(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Size of both scale groups, and the low-score rate even spread would produce."""
    low_scores = float(len(profile.bottom_box))
    predicted = F.col("n_short") * F.lit(low_scores / profile.short_scale_max) + F.col(
        "n_long"
    ) * F.lit(low_scores / profile.long_scale_max)
    scored = F.col("scored")
    low = reduce(add, [F.col("observed")[s - 1] for s in profile.bottom_box])
    return population_sizes(tickets, profile).select(
        "scored",
        round_to(F.col("n_long")).alias("n_1_10_scale"),
        pct(F.col("n_long"), scored).alias("pct_1_10_scale"),
        round_to(F.col("n_short")).alias("n_1_5_scale"),
        pct(F.col("n_short"), scored).alias("pct_1_5_scale"),
        pct(predicted, scored).alias("predicted_low_score_percentage"),
        pct(low, scored).alias("observed_low_score_percentage"),
    )


def _score_sums(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Whole-number sums that every reading of the scores is made of."""
    x = F.col("satisfaction_score")
    high = x > profile.short_scale_max
    return tickets.filter("has_satisfaction").agg(
        F.count("*").alias("n"),
        F.sum(x).alias("sum_x"),
        F.count_if(high).alias("n_high"),
        F.sum(F.when(high, x)).alias("sum_high"),
        F.count_if(x.isin(4, 5, 8, 9, 10)).alias("top_aware"),
        F.count_if(x >= 4).alias("top_naive"),
        F.count_if(x <= 2).alias("bottom_2"),
        F.count_if(x <= 3).alias("bottom_3"),
    )


def _swing_values() -> dict[str, Column]:
    """Unrounded percentage of each reading over :func:`_score_sums`."""
    n, sum_x = F.col("n"), F.col("sum_x")
    n_high, sum_high = F.col("n_high"), F.coalesce("sum_high", F.lit(0))
    hundred = F.lit(100.0)

    def share(part: Column) -> Column:
        return ratio(hundred * part, n)

    by_rule = (sum_high - n_high) / F.lit(9.0) + (
        (sum_x - sum_high) - (n - n_high)
    ) / F.lit(4.0)
    return {
        "A": share(sum_x) / F.lit(10.0),
        "B": share(sum_x) / F.lit(5.0),
        "C": share(sum_x - n) / F.lit(9.0),
        "D": share(sum_x - n) / F.lit(4.0),
        "E": share(by_rule),
        "F": share(F.col("top_aware")),
        "G": share(F.col("top_naive")),
        "H": hundred - share(F.col("bottom_2")),
        "I": hundred - share(F.col("bottom_3")),
        "J": F.lit(MIDPOINT_PERCENTAGE),
    }


def swing_readings(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """X3 without its order."""
    values = _swing_values()
    return unpivot_row(
        _score_sums(tickets, profile),
        ["variant", "approach", "satisfaction_percentage"],
        [
            {
                "variant": F.lit(variant),
                "approach": F.lit(label),
                "satisfaction_percentage": round_to(values[variant], 1),
            }
            for variant, label in SWING_LABELS.items()
        ],
    )


def methodology_swing(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Ten readings of "how satisfied" on the same scores, from one pass."""
    return swing_readings(tickets, profile).orderBy("variant")


def methodology_gap(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Distance between the two most distant defensible readings (B and C)."""
    values = _swing_values()
    low, high = F.least(values["B"], values["C"]), F.greatest(values["B"], values["C"])
    return _score_sums(tickets, profile).select(
        round_to(low, 1).alias("lowest"),
        round_to(high, 1).alias("highest"),
        round_to(high - low, 1).alias("swing_points"),
    )


def scale_detector_by_dimension(tickets: DataFrame, profile: TicketProfile) -> DataFrame:
    """Share of long-scale scores per segment with a Wald 95% interval, and overall."""
    dimensions = {ALL_TICKETS: F.lit(ALL_TICKETS)}
    dimensions.update({name: F.col(name) for name in DETECTOR_DIMENSIONS})
    counted = group_by_each(
        tickets,
        dimensions,
        [
            F.count_if("has_satisfaction").alias("n"),
            F.count_if(above_short_scale(profile)).alias("k"),
        ],
    ).filter(F.col("segment").isNotNull())
    p = ratio(F.col("k"), F.col("n"))
    half_width = F.lit(Z_95) * F.sqrt(F.try_divide(p * (F.lit(1.0) - p), F.col("n")))
    return counted.select(
        "dimension",
        "segment",
        "n",
        "k",
        round_to(F.lit(100.0) * p, 4).alias("score_above_5_percentage"),
        round_to(F.lit(100.0) * half_width, 4).alias("ci95_half_width"),
    ).orderBy("dimension", "segment")
