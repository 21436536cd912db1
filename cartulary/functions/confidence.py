"""The algebra of confidence, provenance and review states: chains of conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def review_state(confidence: Column, recommended: float = 0.80) -> Column:
    """0.80 is the bound for seeds and events, 0.82 for people and anchors."""
    return F.when(confidence >= 0.95, "auto_confirmed").when(confidence >= recommended, "review_recommended").otherwise("needs_review")


def anchor_confidence(label: Column, has_bbox: Column) -> Column:
    base = F.when(label.isin("patient_name", "mother_name", "provider_name"), 0.78).when(label.rlike("^(crm|cid|date)"), 0.84).otherwise(0.68)
    return F.when(has_bbox, F.least(base + 0.12, F.lit(0.99))).otherwise(base)


def assertion_level(has_bbox: Column, provenance: Column) -> Column:
    return F.when(has_bbox & (provenance == "exact"), "observed").when(provenance.isin("inferred", "estimated", "text_fallback", "snippet_only"), "inferred").otherwise("unknown")


def event_confidence(seed: Column, event_type: Column, document_type: Column, has_bbox: Column, has_patient: Column, has_codes: Column, interval_types: list[str], medical_types: list[str]) -> Column:
    base = F.coalesce(F.nullif(seed, F.lit(0.0)), F.lit(0.70))
    floor = F.when(event_type.isin(interval_types), 0.92).when(document_type.isin(medical_types), 0.84).when(document_type.isNotNull(), 0.76).otherwise(0.0)
    more = F.when(has_bbox, 0.03).otherwise(0.0) + F.when(has_patient, 0.02).otherwise(0.0) + F.when(has_codes, 0.02).otherwise(0.0)
    return F.round(F.least(F.greatest(base, floor) + more, F.lit(1.0)), 3)


def event_provenance(any_bbox: Column, any_exact: Column, event_type: Column, estimated_types: list[str]) -> Column:
    return F.when(any_bbox | any_exact, "exact").when(event_type.isin(estimated_types), "estimated").otherwise("inferred")


def causal_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "forte").when(confidence >= 0.75, "médio").when(confidence >= 0.5, "fraco").otherwise("rejeitado")


def link_strength(confidence: Column) -> Column:
    """Strength in the causal timeline, whose bounds differ from those of causal_level."""
    return F.when(confidence == 0.0, "conflict").when(confidence >= 0.8, "strong").when(confidence >= 0.6, "medium").otherwise("weak")


def mean_of_positive(*scores: Column) -> Column:
    """Mean of the scores above 0, to three places; null without any."""
    kept = F.filter(F.array(*scores), lambda x: x > 0)
    return F.round(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept)), 3)
