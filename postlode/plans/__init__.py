"""Whole queries over the landed tables."""
