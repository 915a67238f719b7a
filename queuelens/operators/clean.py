"""From the raw export to one typed, flagged row per distinct raw row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.text import blank_to_null, folded, lenient_int, relabel
from queuelens.functions.timecols import (
    days_between,
    minutes_between,
    month_start,
    parse_first,
    timestamp_lit,
)
from queuelens.profile import RAW_TICKET_COLUMNS, TicketProfile
from queuelens.sources.files import CLEAN_SCHEMA

# Rows of one join key that a task is meant to get at most.
ROWS_PER_SLOT = 1_000_000
# Keys look up their number of slots by hash, in a table of this fixed size.
SPREAD_BUCKETS = 1 << 16


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SPREAD_BUCKETS)).cast("int")


def spread_table(loads: DataFrame, key: str, rows: str) -> DataFrame:
    """One row, ``slots``: over how many join keys the rows of a key are spread.

    ``loads`` has the number of ``rows`` per ``key``.  Entry b of the array holds for keys of
    hash bucket b: 1 for nearly all, more where a key has over ``ROWS_PER_SLOT`` rows.  Its
    size is fixed, so rows look their slots up in constant time, without a join, whatever
    the number of heavy keys.  A light key that shares a bucket with a heavy one is spread
    like it, which costs rows but changes no result.
    """
    heavy = loads.filter(F.col(rows) > ROWS_PER_SLOT).select(
        _bucket(F.col(key)).alias("bucket"),
        F.ceil(F.col(rows) / ROWS_PER_SLOT).cast("int").alias("slots"),
    )
    every = loads.sparkSession.range(SPREAD_BUCKETS).select(
        F.col("id").cast("int").alias("bucket"), F.lit(1).alias("slots")
    )
    widest = every.unionByName(heavy).groupBy("bucket").agg(F.max("slots").alias("slots"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "slots")))
    return widest.agg(F.transform(ordered, lambda e: e["slots"]).alias("slots"))


def _slots_of(key: Column, slots: Column) -> Column:
    return F.get(slots, _bucket(key))


def in_all_slots(keys: DataFrame, key: str, slots: Column) -> DataFrame:
    """The rows of a side with one row per key, one for each ``_slot`` of its key."""
    last = (_slots_of(F.col(key), slots) - 1).cast("bigint")
    return keys.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_slot"))


def _salt(df: DataFrame, key: str, slots: Column) -> Column:
    """Slot of a row: that of its other columns for a heavy key, 0 for the others.

    Rows without key, which match nothing, are dealt over all values.
    """
    own = _slots_of(F.col(key), slots)
    others = [c for c in RAW_TICKET_COLUMNS if c != key and c in df.columns]
    mixed = F.xxhash64(*others)
    return (
        F.when(F.col(key).isNull(), mixed)
        .when(own > 1, F.pmod(mixed, own))
        .otherwise(F.lit(0).cast("bigint"))
    )


def dedup_exact(raw: DataFrame) -> DataFrame:
    """Drop full-row duplicates.

    Copies meet on the map side first, so a row repeated billions of times
    crosses the shuffle once per task.
    """
    return raw.distinct()


def count_copies(raw: DataFrame) -> DataFrame:
    """Distinct raw rows with their number of occurrences, ``copies``.

    Holds all that later steps want to know of the export, so written once it
    spares them both its text files and another row-sized shuffle.
    """
    return raw.groupBy(*raw.columns).agg(F.count("*").alias("copies"))


def normalize_channel(df: DataFrame, profile: TicketProfile) -> DataFrame:
    """C4: folded channel with aliases merged."""
    channel = F.col("channel")
    return df.withColumn("channel", relabel(channel, profile.channel_aliases, folded(channel)))


def normalize_category(df: DataFrame, profile: TicketProfile) -> DataFrame:
    """Canonical category; an unknown one is trimmed and kept visible."""
    category = F.col("category")
    return df.withColumn("category", relabel(category, profile.category_labels, F.trim(category)))


def parse_timestamps(df: DataFrame, profile: TicketProfile) -> DataFrame:
    """Both clocks, each by the first format that fits."""
    return df.withColumns(
        {
            name: parse_first(F.col(name), profile.timestamp_formats)
            for name in ("created_at", "resolved_at")
        }
    )


def type_agent_and_score(df: DataFrame) -> DataFrame:
    """Blank agents to NULL, scores to integers."""
    return df.withColumns(
        {
            "agent_id": blank_to_null(F.col("agent_id")),
            "satisfaction_score": lenient_int(F.col("satisfaction_score")),
        }
    )


def id_conflicts(distinct_rows: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Ids carried by more than one distinct row, with their row count."""
    return distinct_rows.groupBy(key).agg(F.count("*").alias("id_rows")).filter("id_rows > 1")


def flag_id_conflicts(
    df: DataFrame, conflicts: DataFrame, key: str = "ticket_id", slots: Column | None = None
) -> DataFrame:
    """Mark rows whose id is in ``conflicts``; a NULL id stays NULL.

    Few ids conflict, so adaptive execution normally turns this into a
    broadcast once it has measured that side.  When it cannot, the rows of a heavy id
    are spread over the ``slots`` that :func:`spread_table` gives it, so no id lands in
    one task, and the conflict side grows by the slots of heavy ids only.  The
    null-safe match keeps an ``IS NOT NULL`` filter from being pushed into the
    conflict side, where it would stop that side from reusing the shuffle of
    the exact de-duplication.
    """
    if slots is None:
        slots = spread_table(conflicts, key, "id_rows").scalar()
    marked = in_all_slots(conflicts, key, slots).select(
        F.col(key).alias("_key"), F.lit(True).alias("_conflict"), "_slot"
    )
    salt = _salt(df, key, slots)
    matched = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_slot"))
    flag = F.when(F.col(key).isNotNull(), F.coalesce("_conflict", F.lit(False)))
    return (
        df.withColumn("_salt", salt)
        .join(marked, matched, "left")
        .withColumn("is_id_conflict", flag)
        .drop("_salt", "_conflict", "_key", "_slot")
    )


def agent_loads(df: DataFrame) -> DataFrame:
    """Rows per agent, of raw or typed tickets; those without agent do not count."""
    agent = F.trim("agent_id")
    return df.filter(agent != "").groupBy(agent.alias("agent_id")).agg(F.count("*").alias("rows"))


def enrich_agents(df: DataFrame, agents: DataFrame, slots: Column | None = None) -> DataFrame:
    """Team, hire date and location of the agent.

    No broadcast hint: Spark broadcasts the dimension while its size allows.  When it
    has outgrown that, rows without agent are dealt over all tasks, since they
    match nothing, and those of a heavy agent over its ``slots``, by a hash of the other
    columns that ``df`` has.
    """
    if slots is None:
        slots = spread_table(agent_loads(df), "agent_id", "rows").scalar()
    known = agents.select("agent_id", "team", "hire_date", "location")
    known = in_all_slots(known, "agent_id", slots).withColumnRenamed("agent_id", "_agent")
    salted = df.withColumn("_salt", _salt(df, "agent_id", slots))
    matched = (F.col("agent_id") == F.col("_agent")) & (F.col("_salt") == F.col("_slot"))
    return salted.join(known, matched, "left").drop("_salt", "_agent", "_slot")


def add_resolution_time(df: DataFrame, profile: TicketProfile) -> DataFrame:
    """Resolution state, hours, and the three suspicious kinds of resolution."""
    created, resolved = F.col("created_at"), F.col("resolved_at")
    both = created.isNotNull() & resolved.isNotNull()
    return df.withColumns(
        {
            "is_resolved": resolved.isNotNull(),
            "resolution_hours": minutes_between(created, resolved) / F.lit(60.0),
            "is_negative_duration": both & (resolved < created),
            "is_extreme_duration": both
            & (days_between(created, resolved) > profile.extreme_after_days),
            "is_future_resolution": resolved.isNotNull()
            & (resolved >= timestamp_lit(profile.future_cutoff)),
        }
    )


def add_open_age(df: DataFrame, profile: TicketProfile) -> DataFrame:
    """C11: whole days an open ticket has waited at the extract date."""
    age = days_between(F.col("created_at"), timestamp_lit(profile.extract_date))
    return df.withColumn("open_age_days", F.when(F.col("resolved_at").isNull(), age))


def add_attribution_and_survey_flags(df: DataFrame, profile: TicketProfile) -> DataFrame:
    """Agent, survey and reporting-window flags.

    ``is_bottom_box`` and ``is_partial_month`` stay NULL where their input is:
    neither the flag nor its negation may select such a row.
    """
    created, hired, score = F.col("created_at"), F.col("hire_date"), F.col("satisfaction_score")
    return df.withColumns(
        {
            "created_before_hire": created.isNotNull()
            & hired.isNotNull()
            & (created < hired.cast("timestamp_ntz")),
            "missing_agent": F.col("agent_id").isNull(),
            "has_satisfaction": score.isNotNull(),
            "is_bottom_box": score.isin(*profile.bottom_box),
            "is_partial_month": month_start(created) == timestamp_lit(profile.partial_month),
        }
    )


def type_rows(distinct_rows: DataFrame, profile: TicketProfile) -> DataFrame:
    """C4 to C7 in one projection."""
    out = normalize_channel(distinct_rows, profile)
    out = normalize_category(out, profile)
    out = parse_timestamps(out, profile)
    return type_agent_and_score(out)


def clean_distinct_rows(
    distinct_rows: DataFrame,
    conflicts: DataFrame,
    agents: DataFrame,
    profile: TicketProfile,
    conflict_slots: Column | None = None,
    agent_slots: Column | None = None,
) -> DataFrame:
    """C4 to C12 over rows already de-duplicated, given C8's conflicts.

    Conflicts are attached while rows are still narrow: that join may have to
    shuffle them, and everything derived afterwards needs no shuffle.
    """
    typed = type_rows(distinct_rows, profile)
    out = flag_id_conflicts(typed, conflicts, slots=conflict_slots)
    if agent_slots is None:
        agent_slots = spread_table(agent_loads(distinct_rows), "agent_id", "rows").scalar()
    out = enrich_agents(out, agents, agent_slots)
    out = add_resolution_time(out, profile)
    out = add_open_age(out, profile)
    out = add_attribution_and_survey_flags(out, profile)
    return out.select(*CLEAN_SCHEMA.fieldNames())


def clean_tickets(raw: DataFrame, agents: DataFrame, profile: TicketProfile) -> DataFrame:
    """The 24-column ticket table, one row per distinct raw row, as one plan."""
    distinct_rows = dedup_exact(raw)
    return clean_distinct_rows(distinct_rows, id_conflicts(distinct_rows), agents, profile)


def valid_resolution() -> Column:
    """Resolved, and not before it was created."""
    return F.col("is_resolved") & ~F.col("is_negative_duration")
