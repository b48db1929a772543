"""Event tables."""
