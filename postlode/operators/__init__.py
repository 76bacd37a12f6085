"""Relational operators: dedup, units, aggregates, rankings, similarity."""
