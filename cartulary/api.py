"""The facade: one method for each question that a user asks of a collection, each a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import causal, document_types, legal_fields, medico_legal, process, readmodel, segment, stages, timeline
from .operators.ranking import best
from .session import kept
from .sources import files, recognition, sinks

#: Fields of texts that name an occupation, the surest first.
ACTIVITY_FIELDS = ("Cargo",)


@dataclass
class Collection:
    """pages(document_id, page, text), units and read_models are tables; what isn't given is derived or left out."""

    pages: DataFrame | None = None
    units: DataFrame | None = None
    zones: DataFrame | None = None
    read_models: DataFrame | None = None
    ntep: list[tuple[str, str]] | None = None
    facts: DataFrame | None = None
    spans: DataFrame | None = None
    _tables: list[process.Tables] = field(default_factory=list, repr=False)

    def page_types(self) -> DataFrame:
        return self.pages.withColumn("t", medico_legal.page_type(F.col("text"))).select("*", F.col("t.value").alias("page_type"), F.col("t.confidence").alias("type_confidence")).drop("t")

    def subdocuments(self) -> DataFrame:
        """Runs of pages of one type, with their pages and text."""
        typed = self.pages.withColumn("kind", medico_legal.segment_type(F.col("text")))
        runs = segment.page_runs(typed, "document_id", ["page"], "kind", "DOCUMENTO").withColumn("unit_id", segment.subdoc_id(F.col("segment")))
        kinds = best(runs.where("kind <> 'DOCUMENTO'"), ["document_id", "unit_id"], [F.col("page")]).select("document_id", "unit_id", "kind")
        return segment.grouped_text(runs, ["document_id", "unit_id"], "page", "text").join(kinds, ["document_id", "unit_id"], "left")

    def seeds(self) -> DataFrame:
        return medico_legal.seeds(self.units)

    def events(self) -> DataFrame:
        return medico_legal.events(self.seeds(), self.units, self.zones)

    def timeline(self, document_id: str) -> DataFrame:
        return self.events().where(F.col("document_id") == document_id).orderBy("date_iso", "priority", "event_id")

    def timeline_summary(self) -> DataFrame:
        rows = self.events().select("document_id", F.element_at("citations", 1)["page"].alias("page"), F.exists("citations", lambda c: c["bbox"].isNotNull()).alias("has_bbox"), "review_state", "assertion_level")
        return timeline.summary(rows, "document_id")

    def causal_links(self, events: DataFrame) -> DataFrame:
        return medico_legal.causal_links(events, self.ntep or [])

    def document(self, document_id: str) -> DataFrame:
        return self.read_models.where(F.col("document_id") == document_id).limit(1)

    def search(self, skip: int = 0, limit: int = 20, **filters) -> DataFrame:
        return readmodel.page(self.read_models.where(readmodel.matches(**filters)), "date_canonical", "document_id", skip, limit)

    def search_text(self, query: str, limit: int = 20) -> DataFrame:
        return readmodel.search(self.read_models, "document_id", "search_text", query, min(limit, 100))

    def search_all(self, skip: int = 0, limit: int = 20) -> DataFrame:
        """Every document, latest first."""
        return readmodel.page(self.read_models, "date_canonical", "document_id", skip, limit)

    # --- the whole way, from pages ---------------------------------------------------------------------------------

    @staticmethod
    def health(spark: SparkSession) -> DataFrame:
        return spark.range(1).select(F.lit("ok").alias("status"), F.lit(spark.version).alias("engine"))

    @staticmethod
    def ingest(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
        return files.ingest(spark, path, known)

    @classmethod
    def of_files(cls, spark: SparkSession, path: str, known: DataFrame | None = None, engine: Callable[[bytes], list] | None = None, recognise: recognition.Options = recognition.Options(), **options) -> Collection:
        """Accepted files below path with their pages, spans and media facts: the id of a document is the hash of its content. With an engine, pages
        whose native text isn't good are recognised, and the better reading counts."""
        accepted = files.ingest(spark, path, known).where("status = 'accepted'")
        own = accepted.select("path", F.col("content_sha256").alias("document_id"))
        texts, spans = files.read_texts(spark, path), recognition.layout_spans(spark, path)
        if engine is not None:
            words, status = recognition.recognised(spark, path, engine, recognise)
            texts, spans = recognition.best_readings(texts, words, status), recognition.best_spans(spans, words)
        media = files.media_facts(spark, path).drop("warning")
        facts = accepted.join(media, "path", "left").select(F.col("content_sha256").alias("document_id"), "media", F.lit("upload").alias("origin"), F.col("path").alias("artifact_uri"), "width", "height", "taken", "seconds")
        pages = texts.join(own, "path").select("document_id", "page", F.coalesce("text", F.lit("")).alias("text"), "source", "warning")
        return cls(pages=kept(pages, "pages"), facts=facts, spans=kept(spans.join(own, "path").select("document_id", "page", "span_ord", "text", "bbox"), "spans"), **options)

    def processed(self) -> process.Tables:
        """All tables of the collection, made once."""
        if not self._tables:
            facts = self.facts
            if facts is None:
                nothing = {"width": "long", "height": "long", "taken": "string", "seconds": "double", "origin": "string", "artifact_uri": "string"}
                facts = self.pages.select("document_id").distinct().select("document_id", F.lit("documento").alias("media"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
            self._tables.append(process.process(self.pages, facts, self.spans))
        return self._tables[0]

    def extract(self, document_id) -> DataFrame:
        """The evidence of a document's pages."""
        return self.processed().evidence.where(F.col("document_id") == document_id).orderBy("page")

    def infer_context(self, document_id) -> DataFrame:
        """The type of a document and of what it is about."""
        t = self.processed()
        facts = self.facts if self.facts is not None else t.models.select("document_id", F.col("media_type").alias("media"), *[F.lit(None).cast("string").alias(c) for c in ("width", "height", "taken", "seconds")])
        rows = facts.join(t.documents.select("document_id", "text", F.col("document_type").alias("canonical_type")), "document_id", "left")
        return stages.context(rows.where(F.col("document_id") == document_id))

    def narrative(self, document_id) -> DataFrame:
        return process.narrative(self.processed().models.where(F.col("document_id") == document_id))

    def legal_fields(self) -> DataFrame:
        """(document_id, doc_type, field, ord, value, confidence) of the documents' texts."""
        texts = self.processed().documents.select("document_id", document_types.legal_type(F.col("text"))["value"].alias("doc_type"), "text")
        return legal_fields.text_fields(texts)

    def alerts(self, cases: DataFrame | None = None, today: Column | None = None) -> DataFrame:
        """(case_id, alert, ...): the legal alerts of cases(document_id, case_id); each document is a case of its own if none are given. ``today`` is the
        day that time limits count from."""
        rows = self.processed().documents.select("document_id", document_types.legal_type(F.col("text"))["value"].alias("doc_type"), F.col("codes").alias("cids"))
        rows = rows.join(legal_fields.field_map(self.legal_fields()), "document_id", "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
        rows = rows.withColumn("case_id", F.col("document_id")) if cases is None else rows.join(cases.select("document_id", "case_id"), "document_id")
        return legal_fields.alert_payloads(rows, F.current_date() if today is None else today)

    def case(self, document_id) -> DataFrame:
        """Everything about one document: model, timeline, review, legal part with its alerts, and where it comes from."""
        t, one = self.processed(), F.col("document_id") == document_id
        fields = self.legal_fields().where(one)
        alerts = self.alerts().withColumnRenamed("case_id", "document_id").where(one)
        legal = legal_fields.legal_section(fields, legal_fields.facts(fields), alerts)
        items = t.review.where(one).withColumn("source", F.col("item_type"))
        view = readmodel.case_view(t.models.where(one).withColumnRenamed("timeline", "timeline_summary"), t.events.where(one), items)
        return view.join(legal, "document_id", "left").withColumn("provenance", stages.provenance(F.coalesce(F.size("timeline"), F.lit(0)) > 0))

    def cases(self) -> DataFrame:
        """(document_id, case_id): documents of one patient, by the letters of the name, are a case; a document without one is a case of its own."""
        who = F.nullif(text.identity_text(text.accent_fold(F.col("patient.name"))), F.lit(""))
        alone = F.concat(F.lit("document:"), F.col("document_id").cast("string"))
        return self.processed().documents.select("document_id", F.coalesce(F.concat(F.lit("patient:"), who), alone).alias("case_id"))

    def dossier(self, document_id) -> DataFrame:
        t, one = self.processed(), F.col("document_id") == document_id
        whole = t.models.where(one).select("document_id", "title", "media_type", "doc_type", "date_canonical", "artefacts")
        return stages.dossier_payload(whole, t.events.where(one), t.summary.where(one), t.review.where(one))

    def activities(self) -> DataFrame:
        """(document_id, document_activity): the occupation that a document's fields name."""
        named = self.legal_fields().where(F.col("field").isin(*ACTIVITY_FIELDS))
        return named.groupBy("document_id").agg(F.min_by(F.substring_index("value", "\n", 1), F.array_position(F.array(*[F.lit(f) for f in ACTIVITY_FIELDS]), F.col("field"))).alias("document_activity"))

    def causal_timeline(self, scope: str = "case", cases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(events, links) in order: of each of cases(document_id, case_id), as cases() finds them, or of the whole collection as one. An
        occupation holds for all documents of its case."""
        rows = self.processed().events.withColumn("ts", F.try_to_timestamp("date_iso")).withColumn("cid", F.get("codes", F.lit(0))).withColumn("provider_activity", F.lit(None).cast("string"))
        rows = rows.withColumn("scope_id", F.lit(scope)) if cases is None else rows.join(cases.select("document_id", F.col("case_id").alias("scope_id")), "document_id")
        named = self.activities() if cases is None else self.activities().join(cases, "document_id")
        by_scope = named.withColumn("scope_id", F.lit(scope) if cases is None else F.col("case_id")).groupBy("scope_id").agg(F.min_by("document_activity", "document_id").alias("scope_activity"))
        rows = rows.join(self.activities(), "document_id", "left").join(by_scope, "scope_id", "left").withColumn("document_activity", F.coalesce("document_activity", "scope_activity")).drop("scope_activity")
        merged = timeline.in_order(rows, ["scope_id"], [F.col("ts").asc_nulls_last(), F.col("event_id")], "pos")
        links = causal.in_order(medico_legal.causal_links(merged, self.ntep or []), ["scope_id"], list(medico_legal.RULE_CONFIDENCE))
        return medico_legal.causal_timeline(merged, links), links

    def stage(self, df: DataFrame, function: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
        """What a stage of the user's makes of a table, and its log."""
        return stages.run_stage(df, function, name, "user")

    def save(self, path: str) -> DataFrame:
        """The read models as a table that is searched by id and read in the order of dates."""
        sinks.write_indexed(self.processed().models, path, ["document_id"], ["date_canonical"])
        return self.pages.sparkSession.read.parquet(path)
