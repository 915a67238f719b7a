"""Dates, formats, labels and bins that results must show exactly so."""

EXTRACT_DATE = "DATE '2001-08-02'"
FUTURE_CUTOFF = "TIMESTAMP '2001-08-03'"
PARTIAL_MONTH = "TIMESTAMP '2001-08-01'"

TIMESTAMP_FORMATS = ("%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M")
MONTH_FIRST_FORMAT = "%m/%d/%Y %H:%M"

CATEGORY_LABELS = {
    "bill": "Billing",
    "billing": "Billing",
    "booking change": "Booking Change",
    "technical issue": "Technical Issue",
    "cancellation": "Cancellation",
    "general query": "General Query",
}
CATEGORIES = ("Billing", "Booking Change", "Technical Issue", "Cancellation", "General Query")
CHANNELS = ("email", "phone", "chat", "social")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BRANDS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NO_TEAM = "(no agent/team)"

RESOLUTION_BINS = (
    [(2, "0: <2h"), (4, "1: 2-4h"), (8, "2: 4-8h"), (16, "3: 8-16h"), (24, "4: 16-24h"), (72, "5: 1-3d")],
    "6: 3d+",
)
AGE_BINS = (
    [(7, "0: <7 days"), (30, "1: 7-30 days"), (90, "2: 30-90 days"), (180, "3: 90-180 days")],
    "4: over 180 days",
)
SPEED_BINS = (
    [(4, "0: <4h"), (12, "1: 4-12h"), (24, "2: 12-24h"), (168, "3: 1-7d")],
    "4: 7d+",
)

# file names of the saved reports, and the query behind each
REPORTS = {
    "by_category": "by_category",
    "by_channel": "by_channel",
    "by_brand": "by_brand",
    "by_priority": "by_priority",
    "by_team": "by_team",
    "monthly_trend": "monthly_trend",
    "agent_low_score_spread": "agent_low_score_spread",
    "resolution_vs_satisfaction_correlation": "resolution_satisfaction_corr",
    "backlog_age_by_priority": "backlog_age_by_priority",
    "backlog_by_creation_month": "backlog_by_creation_month",
    "arrival_pattern_by_weekday": "arrivals_by_weekday",
    "duplicates": "mat_duplicates",
    "date_format_misparsed": "mat_date_misparsed",
    "date_format_rows_dropped": "mat_date_rows_dropped",
    "mean_vs_median": "mat_mean_vs_median",
    "missing_satisfaction_as_bad_score": "mat_missing_as_bad",
    "category_and_channel_not_normalised": "mat_not_normalised",
    "survivorship": "mat_survivorship",
    "bill_to_billing_evidence": "mat_bill_billing",
    "pre_hire_tickets_diagnosed": "mat_pre_hire",
    "satisfaction_scale_deconvolution": "scale_deconvolution",
    "satisfaction_methodology_swing": "methodology_swing",
    "backlog_age_profile": "backlog_age_profile",
    "speed_by_denominator": "speed_by_denominator",
}


def listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
