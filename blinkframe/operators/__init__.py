"""Operators over frames, clusters and localizations."""
