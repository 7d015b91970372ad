"""Ladders that reports and their SQL share, as ANSI SQL over named columns. The audit's own classifiers are in ``ladders``."""

from __future__ import annotations

RELIABILITY = "CASE WHEN n >= 20 OR share >= 0.15 THEN 'broad' WHEN n >= 10 OR share >= 0.08 THEN 'moderate' ELSE 'narrow' END"

#: Of a sample's first and second model; ``edge`` are the rates on generated tests, ``n_edge`` those tests.
COMPARISON = """CASE WHEN "second" IS NULL THEN concat('one model: ', first_label)
 WHEN n_edge > 0 AND abs(first_edge - second_edge) >= 0.34 THEN concat('edge cases favour ', CASE WHEN first_edge > second_edge THEN "first" ELSE "second" END)
 WHEN abs(first_rate - second_rate) < 0.05 THEN 'tie'
 ELSE concat('stronger overall: ', CASE WHEN first_rate > second_rate THEN "first" ELSE "second" END) END"""
