"""The whole way of a collection, from pages to read models, as a set of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import canonical, hard_entities, medico_legal, page_entities, readmodel, stages, timeline

#: The sentences of a document's factual narrative: with a value, and without it.
NARRATIVE = (
    ("media", "Memória do tipo {}.", "Memória de tipo não identificado."),
    ("date_canonical", "Registrada em {}.", "Sem data canônica confirmada."),
    ("origin", "Origem do artefato: {}.", "Origem do artefato não determinada."),
    ("event_type", "Classificada como evento ou documento do tipo {}.", "Tipo de evento ou documento ainda não classificado."),
)
NARRATIVE_END = "Algumas informações de contexto podem estar ausentes; esta narrativa foi gerada apenas a partir de dados estruturados do documento."


@dataclass(frozen=True)
class Tables:
    evidence: DataFrame
    zones: DataFrame
    units: DataFrame
    documents: DataFrame
    seeds: DataFrame
    events: DataFrame
    hard: DataFrame
    summary: DataFrame
    review: DataFrame
    models: DataFrame


def flat(units: DataFrame) -> DataFrame:
    """Canonical units as seeds and events read them: names as texts, the first page, the number of the unit."""
    return units.select(
        "document_id", "unit_id", F.regexp_extract("unit_id", r"(\d+)$", 1).try_cast("int").alias("unit_ord"), F.col("first_page").alias("page"), "document_type", "document_date", "stay_start", "stay_end", "leave_start", "leave_end", "codes",
        F.col("patient.name").alias("patient"), F.col("provider.name").alias("provider"),
    )


def process(pages: DataFrame, facts: DataFrame, spans: DataFrame | None = None) -> Tables:
    """pages(document_id, page, text) and facts(document_id, media, origin, artifact_uri, width, height, taken, seconds) -> all
    tables of the collection. What is read more than once is written to the shared folder first."""
    keys = ["document_id", "page"]
    evidence, zones = page_entities.analyse(pages.select(*keys, "text"), keys, spans=spans)
    evidence = kept(stages.with_context(evidence), "context")
    units = kept(stages.units(evidence, zones, ["document_id", "unit_id"]), "units")
    documents = kept(stages.units(evidence, zones, ["document_id"]), "documents")
    rows = flat(units)
    seeds = kept(medico_legal.seeds(rows), "seeds")
    events = kept(medico_legal.events(seeds, rows, zones), "events")
    hard = kept(hard_entities.hard_entities(documents.select("document_id", "text"), evidence, zones.withColumnRenamed("ord", "anchor_ord")), "hard")
    summary = kept(stages.entity_summary(documents, evidence, hard, events), "summary")
    same = timeline.consistency(seeds.where("include_in_timeline").select("document_id", "date_iso"), events.select("document_id", "date_iso"), "document_id", "date_iso")
    review = kept(stages.review_items(documents, events, same.where("NOT consistent")), "review")
    return Tables(evidence, zones, units, documents, seeds, events, hard, summary, review, read_models(facts, documents, evidence, events, summary, review, same))


def exif_date(taken: Column) -> Column:
    """`YYYYMMDD HHMMSS` of a picture as an ISO time."""
    return F.date_format(F.try_to_timestamp(taken, F.lit("yyyyMMdd HHmmss")), "yyyy-MM-dd'T'HH:mm:ss")


def read_models(facts: DataFrame, documents: DataFrame, evidence: DataFrame, events: DataFrame, summary: DataFrame, review: DataFrame, consistency: DataFrame) -> DataFrame:
    """The searchable row of each document in facts: twenty columns, among them a text to search that is never empty. facts may have
    ``inferred_date`` and ``estimated_date``, as a model of context gives them."""
    none = F.array().cast("array<string>")
    docs = facts.select("document_id", exif_date(F.col("taken")).alias("exif_date"), *[F.col(c).cast("string").alias(c) if c in facts.columns else F.lit(None).cast("string").alias(c) for c in ("inferred_date", "estimated_date")])
    docs = docs.join(documents.select("document_id", "document_date", "warnings", "document_type", "codes", "text"), "document_id", "left").join(stages.candidate_dates(evidence), "document_id", "left")
    doubted = F.when(F.array_contains("warnings", "document_date_looks_like_birth_date"), F.array("document_date.date_iso"))
    births = F.array_distinct(F.concat(F.coalesce("births", none), F.coalesce(doubted, none)))
    docs = docs.withColumn("births", births).where(F.col("document_date").isNotNull() | F.col("text").isNotNull() | F.coalesce("exif_date", "inferred_date", "estimated_date").isNotNull())
    dated = stages.normalised(docs, evidence, lambda d: F.coalesce(F.array_contains("births", F.substring(d, 1, 10)), F.lit(False)))
    kinds = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("date_iso", "priority", "event_id", "event_type"))), lambda e: e["event_type"]))
    anchored = F.exists("citations", lambda c: c["page"].isNotNull() & c["bbox"].isNotNull())
    happened = events.groupBy("document_id").agg(kinds.alias("event_types"), F.count("*").alias("total_events"), F.count_if(anchored).alias("anchored_events"))
    out = facts.join(docs.select("document_id", "document_type", "text"), "document_id", "left").join(dated, "document_id", "left").join(happened, "document_id", "left")
    out = out.join(summary, "document_id", "left").join(stages.review_counts(review), "document_id", "left").join(consistency.select("document_id", "consistent"), "document_id", "left")
    kinds, cids = F.coalesce("event_types", none), F.coalesce("cids", none)
    tags = F.array_distinct(F.concat(F.coalesce("tags", none), F.transform(cids, lambda c: F.concat(F.lit("cid:"), c)), F.transform(kinds, lambda e: F.concat(F.lit("event:"), e))))
    date = F.date_format(F.try_to_timestamp("date_canonical"), "yyyy-MM-dd")
    out = out.withColumn("date_canonical", F.coalesce(F.when(F.col("date_canonical").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date_canonical")), date))
    parts = [F.replace("document_type", F.lit("_"), F.lit(" ")), F.concat(F.lit("Paciente: "), "patient"), F.concat(F.lit("Prestador: "), "provider"), F.concat(F.lit("Data: "), "date_canonical")]
    title = readmodel.title(F.col("document_type"), F.col("patient"), F.col("media"), F.col("document_id").cast("string"))
    named = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("patient", "provider")]), lambda e: e["label"].isNotNull())
    entities = F.concat(named, F.transform(cids, lambda c: F.struct(F.lit("cid").alias("kind"), c.alias("label"))))
    score = F.when(F.coalesce("consistent", F.lit(True)), 100.0).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = out.select(
        "document_id", F.col("media").alias("media_type"), title.alias("title"), readmodel.executive_summary(parts, cids, "Documento sem síntese.").alias("summary"), F.col("document_type").alias("doc_type"), "date_canonical", canonical.period(F.col("date_canonical")).alias("period_label"),
        tags.alias("tags"), F.array_distinct(entities).alias("entities"), kinds.alias("event_types"), "patient", "provider", cids.alias("cids"), F.struct(F.col("artifact_uri").alias("original")).alias("artefacts"),
        F.struct(F.concat(F.lit("/documents/"), F.col("document_id").cast("string"), F.lit("/timeline")).alias("endpoint"), zero("total_events"), zero("anchored_events"), score.alias("timeline_consistency_score")).alias("timeline"),
        F.struct(score.alias("timeline_consistency_score"), zero("needs_review_count"), zero("total_items"), zero("anchored_events")).alias("confidence_indicators"), zero("needs_review_count"), "text", F.col("place"), "origin",
    )
    said = F.concat_ws(" ", F.col("document_id").cast("string"), "title", "summary", "date_canonical", "tags", F.transform("entities", lambda e: e["label"]), "event_types", "text")
    return rows.withColumn("search_text", said).drop("text")


def narrative(models: DataFrame) -> DataFrame:
    """(document_id, narrative): what is known of a document in plain sentences, and a word on what may be missing."""
    row = models.withColumn("media", F.col("media_type")).withColumn("event_type", F.coalesce("doc_type", F.get("event_types", F.lit(0))))

    def sentence(column: str, known: str, unknown: str) -> Column:
        before, after = known.split("{}")
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after))).otherwise(unknown)

    return row.select("document_id", F.concat_ws(" ", *[sentence(*s) for s in NARRATIVE], F.lit(NARRATIVE_END)).alias("narrative"))
