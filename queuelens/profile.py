"""Everything about a ticket feed that is a choice rather than a computation.

Operators never hard-code a date, a label or a threshold: they read it from a
:class:`TicketProfile`.  The defaults describe the customer-support export the
engine was first written for; :func:`star_schema_profile` describes the ticket
feed that :mod:`queuelens.sources.star_schema` derives from order tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from types import MappingProxyType

# ---------------------------------------------------------------------------
# These must be exactly so for results to be right.
RAW_TICKET_COLUMNS = (
    "ticket_id",
    "brand",
    "channel",
    "category",
    "priority",
    "created_at",
    "resolved_at",
    "agent_id",
    "satisfaction_score",
)
RAW_AGENT_COLUMNS = ("agent_id", "team", "hire_date", "location")

TIMESTAMP_FORMATS = ("y-M-d H:m:s", "d/M/y H:m")
MONTH_FIRST_FORMAT = "M/d/y H:m"
DATE_FORMAT = "y-M-d"
SLASHED_DATE_LIKE = "__/__/____%"

CHANNEL_ALIASES = {"e-mail": "email"}
CATEGORY_LABELS = {
    "bill": "Billing",
    "billing": "Billing",
    "booking change": "Booking Change",
    "technical issue": "Technical Issue",
    "cancellation": "Cancellation",
    "general query": "General Query",
}

BRANDS = ("agoda", "Booking.com", "priceline", "KAYAK")
CHANNELS = ("email", "phone", "chat", "social")
CATEGORIES = ("Billing", "Booking Change", "Technical Issue", "Cancellation", "General Query")
PRIORITIES_BY_SEVERITY = ("Urgent", "High", "Medium", "Low")

NO_TEAM_LABEL = "(no agent/team)"

RESOLUTION_BINS = (
    (2, "0: <2h"),
    (4, "1: 2-4h"),
    (8, "2: 4-8h"),
    (16, "3: 8-16h"),
    (24, "4: 16-24h"),
    (72, "5: 1-3d"),
    (None, "6: 3d+"),
)
SURVEY_SPEED_BINS = (
    (4, "0: <4h"),
    (12, "1: 4-12h"),
    (24, "2: 12-24h"),
    (168, "3: 1-7d"),
    (None, "4: 7d+"),
)
BACKLOG_AGE_BINS = (
    (7, "0: <7 days"),
    (30, "1: 7-30 days"),
    (90, "2: 30-90 days"),
    (180, "3: 90-180 days"),
    (None, "4: over 180 days"),
)
# ---------------------------------------------------------------------------


def _frozen(mapping: Mapping[str, str]) -> Mapping[str, str]:
    return MappingProxyType(dict(mapping))


@dataclass(frozen=True)
class TicketProfile:
    """Formats, label maps, thresholds and legal values of one ticket feed."""

    timestamp_formats: tuple[str, ...] = TIMESTAMP_FORMATS
    month_first_format: str = MONTH_FIRST_FORMAT
    date_format: str = DATE_FORMAT
    slashed_date_like: str = SLASHED_DATE_LIKE

    channel_aliases: Mapping[str, str] = field(default_factory=lambda: _frozen(CHANNEL_ALIASES))
    category_labels: Mapping[str, str] = field(default_factory=lambda: _frozen(CATEGORY_LABELS))
    merged_category: str = "Billing"
    merged_category_fragment: str = "Bill"

    extract_date: date = date(2025, 6, 2)
    future_cutoff: date = date(2025, 6, 3)
    partial_month: date = date(2025, 6, 1)

    extreme_after_days: int = 30
    fast_hours: float = 24
    stale_days: int = 180
    fresh_days: int = 7
    gap_hours: tuple[float, float] = (100, 3000)

    bottom_box: tuple[int, ...] = (1, 2)
    short_scale_max: int = 5
    long_scale_max: int = 10
    min_scored_per_agent: int = 40

    brands: tuple[str, ...] = BRANDS
    channels: tuple[str, ...] = CHANNELS
    categories: tuple[str, ...] = CATEGORIES
    priorities_by_severity: tuple[str, ...] = PRIORITIES_BY_SEVERITY
    no_team_label: str = NO_TEAM_LABEL

    resolution_bins: tuple = RESOLUTION_BINS
    survey_speed_bins: tuple = SURVEY_SPEED_BINS
    backlog_age_bins: tuple = BACKLOG_AGE_BINS

    significance: float = 0.05


def star_schema_profile() -> TicketProfile:
    """Profile of the ticket feed derived from the order/customer tables."""
    return TicketProfile(
        extract_date=date(2001, 8, 2),
        future_cutoff=date(2001, 8, 3),
        partial_month=date(2001, 8, 1),
        brands=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
        priorities_by_severity=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    )
