"""Stages and views."""
