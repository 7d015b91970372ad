"""Operators for preparing training corpora at scale (token counts, scoring, filters, mixing, deduplication)."""
