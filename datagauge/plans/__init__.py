"""All queries on the shared tables."""

from ..operators import audit, checks, code, incremental, outcomes, packets, pairs, profile, quantiles, reports, review, sections, similarity, stages
from ..streaming import resumable, rollup

_PARTS = (outcomes, profile, similarity, pairs, audit, sections, reports, review, checks, code, packets, incremental, stages, quantiles, rollup, resumable)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
