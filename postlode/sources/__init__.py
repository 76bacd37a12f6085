"""Parsers of landed payloads: one DataFrame of raw responses in, one of postings out."""
