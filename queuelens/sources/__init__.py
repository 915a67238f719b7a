"""Readers, writers and the adapter that derives a ticket feed from order tables."""
