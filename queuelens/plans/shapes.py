"""Plan shapes several operators share.

``grouped_histogram``  exact quantiles per group next to counts
``whole_table``        exact quantiles of all rows next to counts, in no single buffer
``group_by_each``      one scan and one shuffle for aggregates over many dimensions
``side_by_side``       one row out of several one-row frames, without a join
``unpivot_row``        a one-row frame as labelled rows
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_histogram(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    counts: Mapping[str, Column],
    finals: Sequence[Column],
    dimensions: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Two-level aggregate for exact quantiles at scale.

    Level one counts rows per (keys, values): a plain hash aggregate that
    combines on the map side and spreads a hot key over its distinct values.
    Level two sees at most one row per distinct value, so the exact percentile
    gets its input as (value, frequency) pairs.  Durations are whole minutes
    and ages whole days, which bounds that input by the calendar, not the rows.

    ``df`` holds tickets, or counts of them with the number in ``tickets``.
    ``counts`` maps a name to a condition; ``finals`` are aggregates over the
    level-one columns, where ``total(name)`` adds a count up and ``n`` is the
    row count.  Given ``dimensions``, the keys are (dimension, segment) pairs as
    :func:`group_by_each` makes them.
    """
    weight = _weight(df)
    aggregates = [F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in counts]]
    flags = [weight.alias("n"), *_flags(counts, weight)]
    if dimensions is None:
        staged = df.select(*keys, *[v.alias(k) for k, v in values.items()], *flags)
        level_one = staged.groupBy(*keys, *values).agg(*aggregates)
    else:
        keys = ["dimension", "segment"]
        level_one = group_by_each(df, dimensions, aggregates, values, flags)
    return level_one.groupBy(*keys).agg(*finals)


# Width of the buckets of values in which ranks are looked for: hours in days.
BUCKET_WIDTH = 24.0


def select_quantiles(
    counts: DataFrame, value: str, wanted: Mapping[str, float], width: float = BUCKET_WIDTH
) -> DataFrame:
    """One row of exact interpolated quantiles of (value, n) rows, by distributed selection.

    Values fall into buckets of ``width``.  One row per bucket tells which bucket holds a rank;
    inside the bucket, a running count finds the value.  So no task sees all distinct values,
    only those of a bucket, or one row per bucket.  NULL values do not count; without any
    value the quantiles are NULL.
    """
    known = counts.filter(F.col(value).isNotNull()).groupBy(value).agg(F.sum("n").alias("n"))
    bucketed = known.withColumn("bucket", F.floor(F.col(value) / F.lit(float(width))))
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
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy(value))
    # the null-safe match lets both sides read the same shuffle
    placed = bucketed.withColumn("upto", upto).join(
        offsets, F.col("bucket").eqNullSafe(F.col("offset_of"))
    )
    last = F.col("offset") + F.col("upto") - 1
    first = last - F.col("n") + 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col(value).cast("double")))

    found, finals = [F.max("total").alias("total")], []
    for name, q in wanted.items():
        position = F.lit(float(q)) * (F.col("total") - 1)
        found += [at(F.floor(position)).alias(f"{name}_lo"), at(F.ceil(position)).alias(f"{name}_hi")]
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        between = (F.ceil(position) - position) * lo + (position - F.floor(position)) * hi
        finals.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    return placed.agg(*found).select(*finals)


def whole_table(
    df: DataFrame,
    values: Mapping[str, Column],
    counts: Mapping[str, Column],
    quantiles: Mapping[str, tuple[str, float]],
    extras: Sequence[Column] = (),
) -> DataFrame:
    """One row over all of ``df``: ``n``, the ``counts``, ``extras`` and exact ``quantiles``.

    Like :func:`grouped_histogram` without keys, but ``quantiles`` (name to value and q) are
    selected by :func:`select_quantiles`, so no buffer holds all distinct values.
    ``extras`` are aggregates over (values, n, counts) rows.
    """
    weight = _weight(df)
    staged = df.select(
        *[v.alias(k) for k, v in values.items()], weight.alias("n"), *_flags(counts, weight)
    )
    sums = [F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in counts]]
    level_one = staged.groupBy(*values).agg(*sums)
    frames = [
        level_one.agg(
            total("n").alias("n"), *[total(name).alias(name) for name in counts], *extras
        )
    ]
    for value in values:
        wanted = {name: q for name, (of, q) in quantiles.items() if of == value}
        if wanted:
            frames.append(select_quantiles(level_one, value, wanted))
    return side_by_side(*frames)


def group_by_each(
    df: DataFrame,
    dimensions: Mapping[str, Column],
    aggregates: Sequence[Column],
    values: Mapping[str, Column] | None = None,
    inputs: Sequence[Column] = (),
) -> DataFrame:
    """The same aggregates by each of several dimensions, from one scan and one shuffle.

    Returns (dimension, segment, *values, *aggregates).  Grouping sets do it:
    every row is counted once per dimension, combined on the map side, and no
    row is copied through a shuffle.  ``inputs`` are further columns the
    aggregates read; without them the aggregates see all columns of ``df``.
    """
    values = values or {}
    slots = {name: f"_by_{number}" for number, name in enumerate(dimensions)}
    carried = list(inputs) if inputs else [F.col(c) for c in df.columns if c not in values]
    staged = df.select(
        *[dimensions[name].alias(slot) for name, slot in slots.items()],
        *[v.alias(k) for k, v in values.items()],
        *carried,
    )
    grouped = staged.groupingSets(
        [[slot, *values] for slot in slots.values()], *slots.values(), *values
    ).agg(*[F.grouping(slot).alias(f"{slot}_off") for slot in slots.values()], *aggregates)
    dimension = F.coalesce(
        *[F.when(F.col(f"{slot}_off") == 0, F.lit(name)) for name, slot in slots.items()]
    )
    helpers = {*slots.values(), *[f"{slot}_off" for slot in slots.values()], *values}
    return grouped.select(
        dimension.alias("dimension"),
        # only the dimension a row is grouped by is not NULL
        F.coalesce(*slots.values()).alias("segment"),
        *values,
        *[c for c in grouped.columns if c not in helpers],
    )


# Column of a table of counts: how many tickets a row stands for.
TICKETS = "tickets"


def _weight(df: DataFrame) -> Column:
    return F.col(TICKETS) if TICKETS in df.columns else F.lit(1).cast("bigint")


def _flags(counts: Mapping[str, Column], weight: Column) -> list[Column]:
    return [F.when(c, weight).otherwise(0).alias(name) for name, c in counts.items()]


def tickets_in(df: DataFrame, condition: Column | str | None = None) -> Column:
    """Number of tickets, of those that meet ``condition``, in ticket rows or counts of them."""
    if isinstance(condition, str):
        condition = F.col(condition)
    if TICKETS not in df.columns:
        return F.count("*") if condition is None else F.count_if(condition)
    counted = F.col(TICKETS) if condition is None else F.when(condition, F.col(TICKETS))
    return F.coalesce(F.sum(counted), F.lit(0).cast("bigint"))


def total(name: str) -> Column:
    """Sum of a level-one count; 0 (not NULL) over no rows."""
    return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))


def weighted_quantile(value: str, q: float, weight: str = "n") -> Column:
    """Exact interpolated quantile of (value, frequency) rows; NULL values do not count."""
    return F.percentile(value, F.lit(q), F.col(weight))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames as one row.

    The frames are appended with NULLs for one another's columns and folded
    with ``max``, which leaves the one non-NULL value of each column.
    """
    names = [name for frame in frames for name in frame.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(name).alias(name) for name in names])


def unpivot_row(
    row: DataFrame, names: Sequence[str], entries: Sequence[Mapping[str, Column]]
) -> DataFrame:
    """Each of ``entries`` (name to Column over ``row``) as one output row."""
    structs = [F.struct(*[entry[name].alias(name) for name in names]) for entry in entries]
    return row.select(F.inline(F.array(*structs)))
