"""Headline metrics, segments, trends, sign-off checks, materiality and figure data."""

from oracle import values
from oracle.base import bins, n_if, on_clean, pct, quant

FAST = n_if("v AND resolution_hours <= 24")
RESOLVED = n_if("is_resolved")
OPEN = n_if("NOT is_resolved")
SCORED = n_if("has_satisfaction")
LOW = n_if("is_bottom_box")
ANSWERED = n_if("is_resolved AND has_satisfaction")
MEDIAN_HOURS = quant("resolution_hours", 0.5, 2, "v")
MONTH = "date_trunc('month', created_at)"

SEGMENT_MEASURES = f"""
  count(*) AS volume,
  {pct(OPEN, 'count(*)')} AS backlog_percentage,
  {MEDIAN_HOURS} AS median_hrs,
  {quant('resolution_hours', 0.9, 1, 'v')} AS p90_hrs,
  {pct(ANSWERED, RESOLVED)} AS response_rate_percentage,
  {pct(LOW, SCORED)} AS low_score_percentage"""

SEGMENTS = "segments AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {column} AS segment, {SEGMENT_MEASURES} FROM tix GROUP BY 2"
    for name, column in (
        ("category", "category"),
        ("channel", "channel"),
        ("brand", "brand"),
        ("priority", "priority"),
        ("team", f"ifnull(team, '{values.NO_TEAM}')"),
    )
) + ")"


def _slice(dimension: str) -> str:
    return on_clean(
        f"SELECT * EXCLUDE (dimension) FROM segments WHERE dimension = '{dimension}'", SEGMENTS
    )


RESOLUTION_BINS = bins("resolution_hours", *values.RESOLUTION_BINS)
AGE_BINS = bins("open_age_days", *values.AGE_BINS)
SPEED_BINS = bins("resolution_hours", *values.SPEED_BINS)

KPIS = f"""kpis AS (
  SELECT count(*) AS total_tickets,
         {RESOLVED} AS resolved_tickets,
         {OPEN} AS open_tickets,
         {pct(OPEN, 'count(*)')} AS backlog_percentage,
         {MEDIAN_HOURS} AS median_res_hours,
         {quant('resolution_hours', 0.9, 1, 'v')} AS p90_res_hours,
         {pct(FAST, 'count(*)')} AS pct_all_resolved_24h,
         {pct(FAST, RESOLVED)} AS pct_resolved_only_24h,
         {quant('open_age_days', 0.5, 0, 'NOT is_resolved')} AS median_open_age_days,
         {n_if('NOT is_resolved AND open_age_days >= 180')} AS open_over_180d,
         {ANSWERED} AS surveyed_tickets,
         {pct(ANSWERED, RESOLVED)} AS response_rate_percentage,
         {pct(LOW, SCORED)} AS low_score_percentage
  FROM tix)"""

EVIDENCE = f"""evidence AS (
  SELECT {MONTH} AS month, {SCORED} AS scored, min(satisfaction_score) AS min_score,
         max(satisfaction_score) AS max_score,
         {pct(n_if('satisfaction_score > 5'), SCORED)} AS score_above_5_percentage
  FROM tix WHERE NOT is_partial_month GROUP BY 1)"""

BACKLOG = f"""backlog AS (
  SELECT {AGE_BINS} AS age_bucket, count(*) AS open_tickets,
         {pct('count(*)', '(SELECT count(*) FROM tix WHERE NOT is_resolved)')} AS pct_of_backlog
  FROM tix WHERE NOT is_resolved GROUP BY 1)"""

DURATIONS = f"""durations AS (
  SELECT {RESOLUTION_BINS} AS resolution_bucket, count(*) AS n FROM tix WHERE v GROUP BY 1)"""

BY_PRIORITY_AGE = f"""SELECT priority, {OPEN} AS open_tickets,
       {quant('open_age_days', 0.5, 0, 'NOT is_resolved')} AS median_age_days,
       max(open_age_days) AS max_age_days,
       {n_if('open_age_days >= 180')} AS open_over_180d,
       {MEDIAN_HOURS} AS median_close_hours
FROM tix GROUP BY priority"""

METRICS = {
    "headline_kpis": on_clean("SELECT * FROM kpis", KPIS),
    "scale_evidence_monthly": on_clean("SELECT * FROM evidence", EVIDENCE),
    "score_histogram": on_clean(
        "SELECT satisfaction_score, count(*) AS n FROM tix WHERE has_satisfaction GROUP BY 1"
    ),
    "resolution_distribution": on_clean("SELECT * FROM durations", DURATIONS),
    "backlog_age_profile": on_clean("SELECT * FROM backlog", BACKLOG),
    "speed_by_denominator": on_clean(
        f"""SELECT 'resolved tickets only' AS population, {RESOLVED} AS denominator,
                   {pct(FAST, RESOLVED)} AS pct_within_24h FROM tix
            UNION ALL
            SELECT 'ALL tickets (honest)', count(*), {pct(FAST, 'count(*)')} FROM tix"""
    ),
    "segment_metrics": on_clean("SELECT * FROM segments", SEGMENTS),
    "by_category": _slice("category"),
    "by_channel": _slice("channel"),
    "by_brand": _slice("brand"),
    "by_priority": _slice("priority"),
    "by_team": on_clean(
        "SELECT segment, volume, median_hrs, low_score_percentage FROM segments"
        " WHERE dimension = 'team'",
        SEGMENTS,
    ),
    "uniformity_spread": on_clean(
        """SELECT dimension, min(low_score_percentage) AS min_percentage,
                  max(low_score_percentage) AS max_percentage,
                  round(max(low_score_percentage) - min(low_score_percentage), 1) AS spread_points
           FROM segments WHERE dimension <> 'team' GROUP BY dimension""",
        SEGMENTS,
    ),
    "monthly_trend": on_clean(
        f"""SELECT {MONTH} AS month, count(*) AS volume, {MEDIAN_HOURS} AS median_hrs,
                   {pct(LOW, SCORED)} AS low_score_percentage
            FROM tix WHERE NOT is_partial_month GROUP BY 1"""
    ),
    "backlog_by_creation_month": on_clean(
        f"""SELECT {MONTH} AS month, count(*) AS created, {OPEN} AS still_open,
                   {pct(OPEN, 'count(*)')} AS pct_still_open
            FROM tix WHERE NOT is_partial_month GROUP BY 1"""
    ),
    "arrivals_by_weekday": on_clean(
        f"""SELECT dayofweek(created_at) AS day_of_week, strftime(created_at, '%A') AS day_name,
                   count(*) AS volume, {MEDIAN_HOURS} AS median_hrs FROM tix GROUP BY 1, 2"""
    ),
    "backlog_age_by_priority": on_clean(BY_PRIORITY_AGE),
    "backlog_age_summary": on_clean(
        f"""SELECT {OPEN} AS open_tickets,
                   {quant('open_age_days', 0.5, 0)} AS median_age_days,
                   max(open_age_days) AS max_age_days,
                   {n_if('open_age_days >= 180')} AS over_180_days,
                   {pct(n_if('open_age_days >= 180'), OPEN)} AS over_180_percentage,
                   {n_if('open_age_days < 7')} AS under_7_days,
                   {pct(n_if('open_age_days < 7'), OPEN)} AS under_7_percentage,
                   {quant('resolution_hours', 0.5, 1, 'v')} AS median_close_hours
            FROM tix"""
    ),
    "agent_low_score_spread": on_clean(
        """SELECT count(*) AS agents, round(min(rate), 1) AS min_percentage,
                  round(quantile_cont(rate, 0.25), 1) AS q25_percentage,
                  round(quantile_cont(rate, 0.5), 1) AS median_percentage,
                  round(quantile_cont(rate, 0.75), 1) AS q75_percentage,
                  round(max(rate), 1) AS max_percentage
           FROM rates""",
        """rates AS (SELECT agent_id, 100.0::DOUBLE * sum(CAST(is_bottom_box AS INTEGER)) / count(*) AS rate
             FROM tix WHERE agent_id IS NOT NULL AND has_satisfaction
             GROUP BY agent_id HAVING count(*) >= 40)""",
    ),
    "resolution_satisfaction_corr": on_clean(
        """SELECT priority, count(*) AS n,
                  CASE WHEN isnan(corr(h, s)) THEN NULL ELSE round(corr(h, s), 3) + 0.0 END
                    AS corr_res_sat
           FROM (SELECT unnest(['ALL', priority]) AS priority, resolution_hours AS h,
                        CAST(satisfaction_score AS DOUBLE) AS s
                 FROM tix WHERE v AND has_satisfaction) GROUP BY priority"""
    ),
    "check_reconciliation": on_clean(
        """SELECT r AS raw_rows, d AS raw_distinct, CAST(0 AS BIGINT) AS broken_rows,
                  c AS clean_rows, r AS export_lines, TRUE AS same_rows,
                  CASE WHEN c = d THEN 'PASS' ELSE 'FAIL' END AS reconciliation
           FROM (SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM uniq) AS d,
                        (SELECT count(*) FROM clean) AS c)"""
    ),
    "check_no_negatives": on_clean(
        """SELECT count(*) AS negatives_in_metric_input,
                  CASE count(*) WHEN 0 THEN 'PASS' ELSE 'FAIL' END AS check_no_negatives
           FROM tix WHERE v AND resolution_hours < 0"""
    ),
    "response_rate_by_segment": on_clean(
        " UNION ALL ".join(
            f"""SELECT '{d}' AS dimension, {d} AS value, {RESOLVED} AS resolved,
                       {pct(ANSWERED, RESOLVED)} AS response_rate_percentage FROM tix GROUP BY {d}"""
            for d in ("brand", "channel", "priority")
        )
    ),
    "check_domains": on_clean(
        f"""SELECT *, CASE WHEN bad_satisfaction + bad_priority + bad_channel + bad_category
                              + bad_brand = 0 THEN 'PASS' ELSE 'FAIL' END AS domain_checks
           FROM (SELECT
             (SELECT count(*) FROM tix WHERE satisfaction_score < 1 OR satisfaction_score > 10)
               AS bad_satisfaction,
             (SELECT count(*) FROM tix WHERE priority NOT IN {values.listed(values.PRIORITIES)}) AS bad_priority,
             (SELECT count(*) FROM tix WHERE channel NOT IN {values.listed(values.CHANNELS)})
               AS bad_channel,
             (SELECT count(*) FROM tix WHERE category NOT IN {values.listed(values.CATEGORIES)}) AS bad_category,
             (SELECT count(*) FROM tix WHERE brand NOT IN {values.listed(values.BRANDS)}) AS bad_brand)"""
    ),
    "check_window_bounds": on_clean(
        f"""SELECT min(created_at) AS first_created, max(created_at) AS last_created,
                   {n_if('is_partial_month')} AS partial_month_rows FROM tix"""
    ),
    "response_rate_by_speed": on_clean(
        f"""SELECT {SPEED_BINS} AS speed_bucket, count(*) AS resolved,
                   {pct(SCORED, 'count(*)')} AS response_rate_percentage
            FROM tix WHERE v GROUP BY 1"""
    ),
    "response_rate_by_month": on_clean(
        f"""SELECT {MONTH} AS month, {RESOLVED} AS resolved,
                   {pct(ANSWERED, RESOLVED)} AS response_rate_percentage
            FROM tix WHERE NOT is_partial_month GROUP BY 1"""
    ),
    "check_future_timestamps": on_clean(
        f"""SELECT sum(CAST(is_future_resolution AS BIGINT))::BIGINT AS resolved_after_extract,
                  max(resolved_at) AS latest_resolution, {values.EXTRACT_DATE} AS extract_date,
                  CASE WHEN bool_or(is_future_resolution) THEN 'FLAG (kept in metric)'
                       ELSE 'PASS' END AS status
           FROM tix"""
    ),
    "activity_on_both_clocks": on_clean(
        """SELECT coalesce(c.month, r.month) AS month, coalesce(c.n, 0) AS tickets_created,
                  coalesce(r.n, 0) AS tickets_resolved
           FROM (SELECT date_trunc('month', created_at) AS month, count(*) AS n FROM tix
                 WHERE created_at IS NOT NULL GROUP BY 1) c
           FULL JOIN (SELECT date_trunc('month', resolved_at) AS month, count(*) AS n FROM tix
                      WHERE resolved_at IS NOT NULL GROUP BY 1) r ON c.month = r.month"""
    ),
    "check_duration_gap": on_clean(
        f"""SELECT round(max(CASE WHEN NOT is_extreme_duration THEN resolution_hours END), 1)
                     AS last_ordinary_value,
                   round(min(CASE WHEN is_extreme_duration THEN resolution_hours END), 1)
                     AS first_extreme_value,
                   {n_if('resolution_hours >= 100 AND resolution_hours <= 3000')}
                     AS tickets_in_the_gap,
                   {n_if('is_extreme_duration')} AS extreme_tickets
            FROM tix WHERE v"""
    ),
    "mat_duplicates": on_clean(
        f"""SELECT r AS volume_if_unhandled, c AS volume_correct, r - c AS overstated_by,
                   {pct('r - c', 'c', 2)} AS overstated_pct
            FROM (SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM clean) AS c)"""
    ),
    "mat_date_misparsed": on_clean(
        f"""SELECT (SELECT {n_if('slashed AND mf IS NULL')} FROM misread) AS rows_lost_entirely,
                   (SELECT {n_if('slashed AND mf IS NOT NULL')} FROM misread)
                     AS rows_silently_misparsed,
                   (SELECT {quant('h', 0.9, 2, 'h >= 0')} FROM misread) AS p90_if_unhandled,
                   (SELECT {quant('resolution_hours', 0.9, 2, 'v')} FROM tix) AS p90_correct,
                   (SELECT {n_if('h < 0')} FROM misread) AS negatives_manufactured,
                   (SELECT {n_if('is_negative_duration')} FROM tix) AS negatives_real""",
        f"""misread AS (
             SELECT slashed, mf, date_diff('minute', ifnull(iso, mf), shut) / 60.0::DOUBLE AS h
             FROM (SELECT created_at LIKE '__/__/____%' AS slashed,
                          try_strptime(created_at, '{values.MONTH_FIRST_FORMAT}') AS mf,
                          try_strptime(created_at, '{values.TIMESTAMP_FORMATS[0]}') AS iso,
                          try_strptime(resolved_at, '{values.TIMESTAMP_FORMATS[0]}') AS shut FROM uniq))""",
    ),
    "mat_date_rows_dropped": on_clean(
        f"""SELECT count(*) AS volume_if_dropped, total - count(*) AS tickets_lost,
                   {pct('total - count(*)', 'total')} AS pct_of_dataset_lost,
                   {MEDIAN_HOURS} AS median_if_dropped,
                   {quant('resolution_hours', 0.9, 2, 'v')} AS p90_if_dropped
            FROM tix, (SELECT count(*) AS total FROM tix)
            WHERE ticket_id <> ALL (SELECT ticket_id FROM raw
                                    WHERE created_at LIKE '__/__/____%')
            GROUP BY total"""
    ),
    "mat_mean_vs_median": on_clean(
        f"""SELECT round(avg(resolution_hours), 1) AS mean_hours,
                   {quant('resolution_hours', 0.5, 1)} AS median_hours,
                   round(avg(resolution_hours) / nullif(quantile_cont(resolution_hours, 0.5), 0), 1)
                     AS mean_is_x_times_median,
                   {n_if('is_extreme_duration')} AS outliers_responsible
            FROM tix WHERE v"""
    ),
    "mat_missing_as_bad": on_clean(
        f"""SELECT {pct(LOW, SCORED)} AS low_score_correct,
                   {pct(n_if('is_bottom_box') + ' + ' + n_if('is_resolved AND NOT has_satisfaction'),
                        RESOLVED)} AS low_score_if_missing_counted_bad,
                   {n_if('is_resolved AND NOT has_satisfaction')} AS unsurveyed_resolved
            FROM tix"""
    ),
    "mat_not_normalised": on_clean(
        """SELECT (SELECT count(DISTINCT category) FROM raw) AS category_values_if_unhandled,
                  (SELECT count(DISTINCT category) FROM clean) AS category_values_correct,
                  (SELECT count(DISTINCT channel) FROM raw) AS channel_values_if_unhandled,
                  (SELECT count(DISTINCT channel) FROM clean) AS channel_values_correct,
                  (SELECT count(*) FROM raw WHERE trim(category) = 'Bill') AS bill_rows_orphaned"""
    ),
    "mat_survivorship": on_clean(
        f"""SELECT {pct(FAST, RESOLVED)} AS pct_24h_if_unhandled,
                   {pct(FAST, 'count(*)')} AS pct_24h_correct,
                   {OPEN} AS tickets_hidden_by_the_filter,
                   {quant('open_age_days', 0.5, 0)} AS median_age_of_the_hidden FROM tix"""
    ),
    "mat_bill_billing": on_clean(
        """SELECT (SELECT count(*) FROM uniq WHERE lower(trim(category)) = 'billing')
                    AS billing_without_bill,
                  (SELECT count(*) FROM uniq WHERE trim(category) = 'Bill') AS bill_rows,
                  (SELECT count(*) FROM clean WHERE category = 'Billing') AS billing_after_merge,
                  (SELECT round(count(*)::DOUBLE / count(DISTINCT category), 0) FROM clean
                   WHERE category <> 'Billing') AS avg_of_other_4_categories"""
    ),
    "mat_pre_hire": on_clean(
        """SELECT count(*) AS pre_hire_tickets, count(DISTINCT agent_id) AS agents_affected,
                  (SELECT count(*) FROM agents) AS agents_total,
                  round(avg(hire_date - CAST(created_at AS DATE)), 1) AS avg_days_before_hire,
                  max(hire_date - CAST(created_at AS DATE)) AS max_days_before_hire,
                  min(hire_date) AS earliest_hire_date_affected
           FROM tix WHERE created_at < hire_date"""
    ),
    "mart_score_cliff": on_clean(
        """SELECT satisfaction_score, count(*) AS n,
                  CASE WHEN satisfaction_score > 5 THEN '6-10 (1-10 scale only)'
                       ELSE '1-5 range (ambiguous scale)' END AS scale_class
           FROM tix WHERE has_satisfaction GROUP BY 1"""
    ),
    "mart_bins": on_clean(
        """SELECT 'resolution' AS distribution, CAST(resolution_bucket[1] AS INTEGER) AS position,
                  resolution_bucket[4:] AS label, n, CAST(NULL AS DOUBLE) AS percentage
           FROM durations
           UNION ALL
           SELECT 'backlog age', CAST(age_bucket[1] AS INTEGER), age_bucket[4:], open_tickets,
                  pct_of_backlog FROM backlog""",
        DURATIONS,
        BACKLOG,
    ),
    "mart_trend_labels": on_clean(
        f"""SELECT {MONTH} AS month, strftime({MONTH}, '%b %y') AS month_label,
                   count(*) AS volume, {MEDIAN_HOURS} AS median_hrs,
                   {pct(LOW, SCORED)} AS low_score_percentage,
                   (SELECT low_score_percentage FROM kpis) AS reference_low_score_percentage,
                   {OPEN} AS still_open, {pct(OPEN, 'count(*)')} AS pct_still_open
            FROM tix WHERE NOT is_partial_month GROUP BY 1""",
        KPIS,
    ),
    "mart_scale_cutover": on_clean(
        """SELECT month, strftime(month, '%b') AS month_label,
                  score_above_5_percentage AS actual_percentage,
                  round((SELECT avg(score_above_5_percentage) FROM evidence), 4) AS mean_percentage,
                  CASE WHEN row_number() OVER (ORDER BY month)
                            <= (SELECT count(*) // 2 FROM evidence)
                       THEN 0.0::DOUBLE ELSE 50.0::DOUBLE END AS cutover_percentage
           FROM evidence""",
        EVIDENCE,
    ),
    "mart_dashboard_tiles": on_clean(
        """SELECT t.* FROM kpis, LATERAL (VALUES
             (1, 'Tickets (period)', total_tickets::DOUBLE, 'tickets', NULL::DOUBLE, FALSE),
             (2, 'Resolved < 24h (of ALL tickets)', pct_all_resolved_24h, '%', NULL, FALSE),
             (3, 'Open backlog', open_tickets::DOUBLE, 'tickets', backlog_percentage, FALSE),
             (4, 'Median age of open work', median_open_age_days, 'days', NULL, TRUE),
             (5, 'Survey response rate', response_rate_percentage, '%', NULL, FALSE),
             (6, 'Median close', median_res_hours, 'hours', NULL, FALSE)
           ) AS t(position, tile, value, unit, share_percentage, is_alert)""",
        KPIS,
    ),
    "mart_priority_panel": on_clean(
        f"""SELECT CAST(priority[1] AS INTEGER) AS severity_rank, priority, {MEDIAN_HOURS} AS median_hrs,
                   (SELECT median_res_hours FROM kpis) AS overall_median_hrs,
                   {OPEN} AS open_tickets,
                   {quant('open_age_days', 0.5, 0)} AS median_age_days
            FROM tix WHERE priority IN {values.listed(values.PRIORITIES)} GROUP BY priority""",
        KPIS,
    ),
}
