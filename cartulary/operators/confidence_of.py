"""Confidence of names by their raw score, and states of review by confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.confidence import review_state

#: Fixed values: (least raw score, confidence) of each role, best first; the last holds for any score.
BUCKETS = {
    "patient": ((12.0, 0.98), (8.0, 0.90), (4.0, 0.80), (None, 0.68)),
    "mother": ((10.0, 0.94), (6.0, 0.86), (None, 0.72)),
    "provider": ((10.0, 0.94), (6.0, 0.84), (None, 0.70)),
}


def raw_score(role: str, score: Column) -> Column:
    out = None
    *bounds, (_, rest) = BUCKETS[role]
    for least, sure in bounds:
        out = F.when(score >= least, sure) if out is None else out.when(score >= least, sure)
    return out.otherwise(rest)


def review(confidence: Column, recommended: float = 0.80) -> Column:
    return review_state(confidence, recommended)
