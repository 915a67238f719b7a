"""Operators that prepare text for training: scoring, scans, de-duplication, packing."""
