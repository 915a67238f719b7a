"""Ingest, cleaning and the before/after report."""

from oracle import values
from oracle.base import n_if, on_clean, on_raw, on_typed, quant

CLEANING = {
    # no line of the feed is broken
    "ingest_raw_tickets": on_raw("SELECT *, CAST(NULL AS VARCHAR) AS broken_record FROM raw"),
    "dedup_exact": on_raw(
        "SELECT *, CAST(NULL AS VARCHAR) AS broken_record FROM (SELECT * FROM raw GROUP BY ALL)"
    ),
    "agents_dim": on_raw("SELECT agent_id, team, hire_date, location FROM agents"),
    "normalize_channel": on_typed(
        "SELECT ticket_id, channel AS raw_channel,"
        " CASE lower(trim(channel)) WHEN 'e-mail' THEN 'email' ELSE lower(trim(channel)) END"
        " AS channel"
        " FROM uniq"
    ),
    "normalize_category": on_typed(
        """SELECT ticket_id, category AS raw_category,
             CASE lower(trim(category))
                  WHEN 'bill' THEN 'Billing' WHEN 'billing' THEN 'Billing'
                  WHEN 'booking change' THEN 'Booking Change'
                  WHEN 'technical issue' THEN 'Technical Issue'
                  WHEN 'cancellation' THEN 'Cancellation'
                  WHEN 'general query' THEN 'General Query'
                  ELSE trim(category) END AS category
           FROM uniq"""
    ),
    "parse_mixed_timestamps": on_typed(
        "SELECT ticket_id, created_at, resolved_at FROM typed"
    ),
    "blank_to_null_and_score": on_typed(
        """SELECT ticket_id, CASE WHEN trim(agent_id) <> '' THEN trim(agent_id) END AS agent_id,
                  TRY_CAST(satisfaction_score AS INTEGER) AS satisfaction_score FROM uniq"""
    ),
    "id_conflicts": on_typed(
        "SELECT ticket_id, count(*) AS id_rows FROM uniq GROUP BY ticket_id HAVING count(*) > 1"
    ),
    "enrich_agents": on_clean(
        "SELECT ticket_id, category, agent_id, team, hire_date, location FROM clean"
    ),
    "resolution_time": on_clean(
        """SELECT ticket_id, category, created_at, resolved_at, is_resolved, resolution_hours,
                  is_negative_duration, is_extreme_duration, is_future_resolution FROM clean"""
    ),
    "open_age": on_clean(
        "SELECT ticket_id, category, created_at, resolved_at, open_age_days FROM clean"
    ),
    "attribution_and_survey_flags": on_clean(
        """SELECT ticket_id, category, created_before_hire, missing_agent, has_satisfaction,
                  is_bottom_box, is_partial_month FROM clean"""
    ),
    "clean_tickets": on_clean("SELECT * FROM clean"),
    # both exports hold every row
    "write_clean": on_clean(
        "SELECT *, 'parquet' AS export FROM clean UNION ALL SELECT *, 'csv' FROM clean"
    ),
    "qa_row_counts": on_clean(
        """SELECT (SELECT count(*) FROM raw) AS raw_rows,
                  (SELECT count(*) FROM uniq) AS raw_distinct,
                  (SELECT count(*) FROM raw) - (SELECT count(*) FROM uniq) AS duplicates_removed,
                  CAST(0 AS BIGINT) AS broken_rows,
                  (SELECT count(*) FROM clean) AS clean_rows,
                  24 AS clean_columns"""
    ),
    "qa_distinct_before_after": on_clean(
        """SELECT (SELECT count(DISTINCT channel) FROM raw) AS channel_before,
                  (SELECT count(DISTINCT category) FROM raw) AS category_before,
                  (SELECT count(DISTINCT channel) FROM clean) AS channel_after,
                  (SELECT count(DISTINCT category) FROM clean) AS category_after"""
    ),
    "qa_value_counts_channel": on_clean(
        "SELECT channel, count(*) AS n FROM clean GROUP BY channel"
    ),
    "qa_value_counts_category": on_clean(
        "SELECT category, count(*) AS n FROM clean GROUP BY category"
    ),
    "qa_flag_counts": on_clean(
        " UNION ALL ".join(
            f'SELECT \'{flag}\' AS flag, count(*) AS "count" FROM clean WHERE {condition}'
            for flag, condition in (
                ("open_backlog", "resolved_at IS NULL"),
                ("negative_duration", "resolved_at < created_at"),
                ("extreme_gt_30d", "date_diff('day', created_at, resolved_at) > 30"),
                ("resolved_after_extract", f"resolved_at >= {values.FUTURE_CUTOFF}"),
                ("created_before_hire", "created_at < hire_date"),
                ("missing_agent", "agent_id IS NULL"),
                ("id_conflict_rows", "is_id_conflict"),
                ("missing_satisfaction", "satisfaction_score IS NULL"),
                ("partial_month", f"date_trunc('month', created_at) = {values.PARTIAL_MONTH}"),
            )
        )
    ),
    "qa_unparsed_created": on_clean(
        f"SELECT {n_if('created_at IS NULL')} AS unparsed_created_at FROM clean"
    ),
    "qa_resolution_summary": on_clean(
        f"""SELECT {quant('resolution_hours', 0.5, 2)} AS p50,
                   {quant('resolution_hours', 0.9, 1)} AS p90,
                   round(min(resolution_hours), 2) AS min_h,
                   round(max(resolution_hours), 1) AS max_h
            FROM tix WHERE v AND NOT is_extreme_duration"""
    ),
    "qa_open_age_summary": on_clean(
        f"""SELECT count(*) AS open_tickets,
                   {quant('open_age_days', 0.5, 0)} AS median_age_days,
                   max(open_age_days) AS max_age_days,
                   {n_if('open_age_days >= 180')} AS older_than_180d
            FROM tix WHERE NOT is_resolved"""
    ),
}
