"""Ticket analytics on Spark: cleaning, metrics, checks and inference as DataFrame operators."""

from queuelens.profile import TicketProfile, star_schema_profile
from queuelens.session import build_session

__all__ = ["TicketProfile", "build_session", "star_schema_profile"]
