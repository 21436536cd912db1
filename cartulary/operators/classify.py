"""Keyword classifiers and rule engines: vocabularies are parameters, decisions are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import group_counts
from ..functions.values import let


def keyword_score(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the text holds."""
    return sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def ranked(scores: Sequence[tuple[str, Column]]) -> Column:
    """An array of struct(s, o, label); its greatest element is the highest score, of equal ones the first."""
    return F.array(*[F.struct(s.cast("double").alias("s"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, s) in enumerate(scores)])


def ranked_counts(text: Column, sets: dict[str, Sequence[str]]) -> Column:
    """ranked() of keyword scores for many labels: the text is read once for all their keywords."""
    labels = F.array(*[F.lit(k) for k in sets])
    return F.transform(group_counts(text, list(sets.values())), lambda s, i: F.struct(s.cast("double").alias("s"), (-i).alias("o"), F.get(labels, i).alias("label")))


def first_best(scores: Sequence[tuple[str, Column]], default: str) -> Column:
    """The label of the highest score above 0; the first label wins among equals."""
    return let(F.array_max(ranked(scores)), lambda top: F.when(top["s"] > 0, top["label"]).otherwise(default))


def taxonomy(text: Column, sets: dict[str, Sequence[str]], generic: Sequence[str], composite: str = "composite", generic_label: str = "generic", unknown: str = "unknown") -> Column:
    """struct(value, confidence): the label with most keywords; the composite label where two reach two; the generic
    one at 0.55; unknown at 0.20."""
    row = lambda v, c: F.struct(v.alias("value"), c.cast("double").alias("confidence"))

    def decide(found: Column) -> Column:
        top, active = F.array_max(found["scores"]), F.size(F.filter(found["scores"], lambda x: x["s"] >= 2))
        return (
            F.when(active >= 2, row(F.lit(composite), F.lit(0.92)))
            .when(top["s"] >= 2, row(top["label"], F.least(0.70 + 0.08 * top["s"], F.lit(0.95))))
            .when(found["generic"] > 0, row(F.lit(generic_label), F.lit(0.55)))
            .otherwise(row(F.lit(unknown), F.lit(0.20)))
        )

    scores = lambda t: F.struct(ranked([(label, keyword_score(t, words)) for label, words in sets.items()]).alias("scores"), keyword_score(t, generic).alias("generic"))
    return let(let(text, scores), decide)


class Rule:
    """A label that holds where a condition does, with a confidence; a registry of them is a list in order."""

    def __init__(self, label: str, condition: Column, confidence: float | Column):
        self.label, self.condition = label, condition
        self.confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)


def best_rule(rules: Sequence[Rule]) -> Column:
    """struct(confidence, label) of the most confident rule that holds, the first among equals; null if none does."""
    rows = [F.when(r.condition, F.struct(r.confidence.cast("double").alias("confidence"), F.lit(-i).alias("o"), F.lit(r.label).alias("label"))) for i, r in enumerate(rules)]
    top = F.array_max(F.array_compact(F.array(*rows)))
    return F.when(top.isNotNull(), F.struct(top["confidence"].alias("confidence"), top["label"].alias("label")))


def media_type(mime: Column) -> Column:
    return F.when(mime.rlike("^image/"), "imagem").when(mime.rlike("^audio/"), "audio").when(mime.rlike("^video/"), "video").otherwise("documento")


def processing_mode(media: Column, page_count: Column, has_native_text: Column, rotated: Column, is_pdf: Column) -> Column:
    """struct(mode, reason, confidence) before any page is read."""
    row = lambda m, r, c: F.struct(F.lit(m).alias("mode"), F.lit(r).alias("reason"), F.lit(c).alias("confidence"))
    return (
        F.when(media.isin("audio", "video"), row("forensic", "time_based_media", 0.95))
        .when(media != "documento", row("standard", "non_document", 0.90))
        .when(is_pdf & (page_count <= 2) & has_native_text & ~rotated, row("fast", "short_native_pdf", 0.95))
        .when(is_pdf & rotated, row("forensic", "rotated_pdf", 0.93))
        .when(is_pdf & ~has_native_text, row("standard", "no_native_text", 0.92))
        .otherwise(row("standard", "default", 0.90))
    )
