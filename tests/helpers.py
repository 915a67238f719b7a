"""Small hand-made inputs."""

from queuelens.profile import RAW_AGENT_COLUMNS, RAW_TICKET_COLUMNS
from queuelens.sources.files import CLEAN_SCHEMA

RAW_SCHEMA = ", ".join(f"{c} string" for c in RAW_TICKET_COLUMNS)
AGENT_SCHEMA = ", ".join(f"{c} string" for c in RAW_AGENT_COLUMNS)

RAW_DEFAULTS = {
    "ticket_id": "T1",
    "brand": "KAYAK",
    "channel": "email",
    "category": "Billing",
    "priority": "Low",
    "created_at": "2025-01-10 10:00:00",
    "resolved_at": "2025-01-10 12:00:00",
    "agent_id": "A1",
    "satisfaction_score": "4",
}

CLEAN_DEFAULTS = {
    "ticket_id": "T1",
    "brand": "KAYAK",
    "channel": "email",
    "category": "Billing",
    "priority": "Low",
    "is_resolved": True,
    "resolution_hours": 1.0,
    "is_negative_duration": False,
    "is_extreme_duration": False,
    "is_future_resolution": False,
    "created_before_hire": False,
    "missing_agent": False,
    "has_satisfaction": False,
    "is_partial_month": False,
    "is_id_conflict": False,
}


def raw_tickets(spark, *rows):
    data = [tuple({**RAW_DEFAULTS, **r}[c] for c in RAW_TICKET_COLUMNS) for r in rows]
    return spark.createDataFrame(data, RAW_SCHEMA)


def agents(spark, *rows):
    from queuelens.functions.timecols import parse_date
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(rows), AGENT_SCHEMA)
    return df.withColumn("hire_date", parse_date(F.col("hire_date"), "y-M-d"))


def clean_rows(spark, *rows):
    names = CLEAN_SCHEMA.fieldNames()
    data = [tuple({**CLEAN_DEFAULTS, **r}.get(c) for c in names) for r in rows]
    return spark.createDataFrame(data, CLEAN_SCHEMA)


def scored(spark, counts):
    """Clean rows carrying each score as often as ``counts`` says."""
    return clean_rows(
        spark,
        *[
            {"satisfaction_score": s, "has_satisfaction": True, "is_bottom_box": s <= 2}
            for s, n in counts.items()
            for _ in range(n)
        ],
    )
