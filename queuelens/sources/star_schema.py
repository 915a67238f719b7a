"""A raw ticket feed, with its usual defects, derived from order and customer tables.

Every column is modular arithmetic on the order key, so any engine produces the
same rows: mixed timestamp formats, odd spaces and texts that are no time, free-form
and unknown labels with quotes and commas, blanks, decimal and junk scores, agents nobody
knows, missing ids, impossible and stale durations, exact copies and ids with conflicting
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.profile import RAW_AGENT_COLUMNS, RAW_TICKET_COLUMNS

# Fixed values of the feed.
CHANNEL_SPELLINGS = ("Email", "e-mail", "PHONE ", "chat", " Social", "email")
CATEGORY_SPELLINGS = (
    "Bill",
    "billing",
    "BOOKING CHANGE",
    "Technical Issue",
    " cancellation",
    "General Query",
)
TEAMS = ("Tier 1", "Tier 2", "Specialist")
UNKNOWN_CHANNEL = ' Carrier "pigeon", e-mailed'
UNKNOWN_CATEGORY = 'Refund request, "urgent" '
ILLEGAL_PRIORITY = "Critical"
UNKNOWN_AGENT = "A999"
BLANK_AGENT = "  "
DECIMAL_SCORE, JUNK_SCORE = "7.5", "n/a"
NO_DATE = "not a date"
LOCATIONS = ("Bucharest", "Lisbon", "Manila", "Remote")
AGENT_COUNT = 59
CONFLICT_CATEGORY = "General Query"


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _seconds_after(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def ticket_feed(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The nine raw text columns; blanks are NULL, as a CSV reader returns them."""
    k = F.col("o_orderkey")
    joined = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(
        customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"),
        "o_custkey",
        "left",
    )
    # dealt evenly, since a table may come in fewer row groups than there are cores; by a hash of
    # the key, as dealing in turn would sort every task's rows first, and before times are added
    dealt = joined.hint("rebalance", k)
    created = _seconds_after(F.col("o_orderdate"), k * 7919 % 86400)
    timed = dealt.withColumn("created", created).withColumn(
        "resolved",
        F.when(k % 13 == 0, F.lit(None).cast("timestamp_ntz"))
        .when(k % 350 == 1, _seconds_after(F.col("created"), F.lit(-120 * 60)))
        .when(k % 400 == 2, _seconds_after(F.col("created"), F.lit(230000 * 60)))
        .otherwise(_seconds_after(F.col("created"), k * 6007 % 172800)),
    )

    # times are spelled out once, before the formats that use the text
    timed = timed.select(
        "*",
        F.col("created").cast("string").alias("created_text"),
        F.col("resolved").cast("string").alias("resolved_text"),
    )

    def written(ts: str) -> Column:
        iso = F.col(f"{ts}_text")
        day_first = F.concat(
            F.substring(iso, 9, 2),
            F.lit("/"),
            F.substring(iso, 6, 2),
            F.lit("/"),
            F.substring(iso, 1, 4),
            F.substring(iso, 11, 6),
        )
        text = F.when(k % 5 == 0, day_first).otherwise(iso)
        spaced = F.concat(F.replace(text, F.lit(" "), F.lit("  ")), F.lit("\t"))
        return F.when(k % 331 == 11, spaced).otherwise(text)

    # Spark takes a pick to be never NULL, though its index may be
    category = F.when(k % 211 == 5, F.lit(UNKNOWN_CATEGORY)).when(
        F.col("o_custkey").isNotNull(), _pick(CATEGORY_SPELLINGS, F.col("o_custkey") % 6)
    )
    # an unknown category stays unknown in the conflicting copy, which is then an exact copy
    conflict = F.when(k % 211 == 5, F.lit(UNKNOWN_CATEGORY)).otherwise(F.lit(CONFLICT_CATEGORY))
    score = F.when(k * 7901 % 7 < 2, k * 7883 % 10 + 1).otherwise(k * 7883 % 5 + 1)
    # one row per written copy: the ticket, its exact copy, its conflicting copy
    copies = {
        "_own": category,
        "_copy": F.when(k % 85 == 0, category),
        "_conflict": F.when(k % 970 == 1, conflict),
    }
    rows = timed.withColumns(copies).unpivot(timed.columns, [*copies], "_kind", "category")
    return rows.filter(F.col("category").isNotNull()).select(
        F.when(k % 505 != 12, k.cast("string")).alias("ticket_id"),
        F.col("c_mktsegment").alias("brand"),
        F.when(k % 223 == 6, F.lit(UNKNOWN_CHANNEL))
        .otherwise(_pick(CHANNEL_SPELLINGS, k % 6))
        .alias("channel"),
        "category",
        F.when(k % 509 == 13, F.lit(ILLEGAL_PRIORITY))
        .otherwise(F.col("o_orderpriority"))
        .alias("priority"),
        F.when(k % 401 == 10, F.lit(NO_DATE)).otherwise(written("created")).alias("created_at"),
        written("resolved").alias("resolved_at"),
        F.when(k % 250 == 3, F.lit(BLANK_AGENT))
        .when(k % 301 == 7, F.lit(UNKNOWN_AGENT))
        .when(k % 125 != 3, F.concat(F.lit("A"), (k * 31 % AGENT_COUNT).cast("string")))
        .alias("agent_id"),
        F.when(k % 307 == 8, F.lit(DECIMAL_SCORE))
        .when(k % 311 == 9, F.lit(JUNK_SCORE))
        .when(k * 7907 % 11 >= 3, score.cast("string"))
        .alias("satisfaction_score"),
    ).select(*RAW_TICKET_COLUMNS)


def agent_feed(orders: DataFrame) -> DataFrame:
    """One text row per agent any order maps to."""
    number = F.col("number")
    hired = F.date_add(F.lit("1994-06-01").cast("date"), (number * 97 % 2000).cast("int"))
    return (
        orders.select((F.col("o_orderkey") * 31 % AGENT_COUNT).alias("number"))
        .distinct()
        .select(
            F.concat(F.lit("A"), number.cast("string")).alias("agent_id"),
            _pick(TEAMS, number % 3).alias("team"),
            hired.cast("string").alias("hire_date"),
            _pick(LOCATIONS, number % 4).alias("location"),
        )
        .select(*RAW_AGENT_COLUMNS)
    )
