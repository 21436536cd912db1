"""Stages over whole collections: pages to canonical units, units to context, context to timelines, summaries and review
queues. Each stage is a function of tables; what a document lacks is null and never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks, text
from ..functions.patterns import literal_pairs
from ..functions.values import let
from ..session import kept
from . import canonical, confidence_of, document_types, medico_legal, page_entities, segment
from .ranking import best, keep_first

_STRINGS = "array<string>"
#: Rank of page types when candidates of pages are compared; others have 2.
CONTEXT_RANK = {"atestado_medico": 0, "parecer_medico": 0, "laudo_medico": 0, "documento_medico": 0, "documento_composto": 1, "formulario_administrativo": 3}
#: Markers of clinical papers.
CLINICAL_MARKERS = ["cid", "crm", "atestado", "internado", "diagnost", "laudo", "parecer"]
SUGGESTED = {"estimated": "confirm_or_recalculate_estimated_event", "evidence": "confirm_with_document_evidence", "review": "review_and_confirm", "none": "monitor"}


def _list(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array().cast(_STRINGS))


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


# --- canonical units -------------------------------------------------------------------------------------------------


def with_context(evidence: DataFrame, key: str = "document_id") -> DataFrame:
    """evidence of page_entities.analyse() with the sub-document of each page."""
    typed = evidence.withColumn("__kind", F.when(F.col("page_type") == "unknown", "DOCUMENTO").otherwise(F.upper("page_type")))
    return segment.page_runs(typed, key, ["page"], "__kind", "DOCUMENTO").withColumn("unit_id", segment.subdoc_id(F.col("segment"))).drop("__kind", "segment")


def units(pages: DataFrame, anchors: DataFrame, grain: list[str]) -> DataFrame:
    """Canonical units at a grain of (document), (document, unit) or (document, page): people, date, codes, type, stay
    and leave, text and pages of each unit.

    pages: evidence with unit_id; anchors: zones of page_entities (document_id, page, label, value, bbox, snippet, ord).
    A unit's lists are those of its pages; texts are joined in the order of pages."""
    key = grain[0]
    pages = kept(pages, "unit-pages")
    first_box = best(anchors, [key, "page", "label", "value"], [F.col("bbox").isNull(), F.col("ord")]).select(key, "page", "label", "value", F.col("bbox").alias("box"), F.col("snippet").alias("shown"))

    role_rows = None
    for role in ("patient", "mother", "provider"):
        p = F.try_element_at("people", F.lit(role))
        rows = pages.select(*grain, *([] if "page" in grain else ["page"]), "page_type", F.lit(role).alias("role"), p["name"].alias("name"), p["confidence"].alias("confidence"), F.when(F.lit(role == "provider"), F.get("basic.crm", F.lit(0))).alias("crm"))
        role_rows = rows if role_rows is None else role_rows.unionByName(rows)
    named = role_rows.where("name IS NOT NULL").join(first_box.select(key, "page", F.col("label").alias("role"), F.col("value").alias("name"), F.col("box").alias("bbox"), F.col("shown").alias("snippet")), [key, "page", "role", "name"], "left")
    people = canonical.people(named, grain)
    by_role = people.groupBy(*grain).agg(*[F.first(F.when(F.col("role") == r, F.struct("name", "confidence", "review_state", "page", "bbox", "snippet", "crm", "provenance_status")), True).alias(r) for r in ("patient", "mother", "provider")])

    days = pages.select(*grain, *([] if "page" in grain else ["page"]), "page_type", F.col("text").alias("page_text"), F.posexplode("dates").alias("ord", "d")).select("*", "d.literal", "d.date_iso").drop("d")
    days = days.join(first_box.where("label = 'date'").select(key, "page", F.col("value").alias("date_iso"), F.col("box").alias("bbox"), F.col("shown").alias("snippet")), [key, "page", "date_iso"], "left")
    dated = canonical.document_dates(days, grain).select(*grain, F.struct("date_iso", "literal", "snippet", "bbox", "page", "confidence", "review_state", "provenance_status").alias("document_date"))

    coded = pages.select(*grain, *([] if "page" in grain else ["page"]), "page_type", F.col("text").alias("page_text"), F.posexplode("clinical.cids").alias("ord", "code"))
    coded = coded.join(first_box.where("label = 'cid'").select(key, "page", F.col("value").alias("code"), F.col("box").alias("bbox")), [key, "page", "code"], "left").withColumn("page_rank", canonical.page_rank(F.col("page_type")))
    whole = F.col("code").rlike(r"^[A-Z]\d{2}(\.\d)?$") & ~((F.col("code") == "S30") & F.lower("page_text").rlike("s30 paulo|sao paulo"))
    score = F.when(F.col("bbox").isNotNull(), 0.9).otherwise(0.7) - 0.03 * F.col("page_rank")
    once = best(coded.where(whole).withColumn("score", score), [*grain, "code"], [F.col("score").desc(), F.col("page"), F.col("ord")])
    code_list = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(999)).alias("p"), "code", "bbox")))
    codes = once.groupBy(*grain).agg(code_list.alias("__codes")).select(*grain, F.transform("__codes", lambda x: x["code"]).alias("codes"), F.transform("__codes", lambda x: F.struct(x["code"].alias("code"), x["p"].alias("page"), x["bbox"].alias("bbox"))).alias("code_evidence"))

    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    texts = pages.withColumn("__page", F.col("page")).groupBy(*grain).agg(parts.alias("__p"), F.min("__page").alias("first_page"))
    texts = texts.select(*grain, F.transform("__p", lambda x: x["page"]).alias("pages"), F.array_join(F.filter(F.transform("__p", lambda x: x["text"]), lambda x: F.trim(x) != ""), "\n").alias("text"), "first_page")
    kinds = document_types.best_page_type(pages, grain, canonical.page_rank(F.col("page_type"))) if "page" not in grain else pages.select(*grain, F.col("page_type").alias("best_page_type"))

    out = texts
    for df in (by_role, dated, codes, kinds):
        out = out.join(df, grain, "left")
    from . import extract

    leave = extract.leave(F.col("text"))
    span = lambda c, level: F.when(c.isNotNull(), F.struct(c.cast("string").alias("date_iso"), F.date_format(c, "dd/MM/yyyy").alias("literal"), F.col("text").alias("__"), F.lit(None).cast("array<double>").alias("bbox"), F.col("first_page").alias("page"), F.lit(level).alias("confidence")))
    out = out.withColumn("document_type", document_types.canonical_type(F.col("text"), document_types.inferred_type(F.col("text"), F.lit(None).cast("string"))["value"], F.col("best_page_type"))).withColumn("__leave", leave)
    start = F.coalesce(F.col("__leave.stay_end"), F.to_date("document_date.date_iso"))
    start = F.when(F.col("__leave.leave_days").isNotNull(), start)
    for name, c, level in (("stay_start", F.col("__leave.stay_start"), 0.96), ("stay_end", F.col("__leave.stay_end"), 0.96), ("leave_start", start, 0.90), ("leave_end", F.date_add(start, F.col("__leave.leave_days")), 0.80)):
        line = canonical.line_of(F.col("text"), F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit("\0")))
        s = span(c, level)
        out = out.withColumn(name, F.when(s.isNotNull(), F.struct(s["date_iso"].alias("date_iso"), s["literal"].alias("literal"), F.coalesce(line, s["literal"]).alias("snippet"), s["bbox"].alias("bbox"), s["page"].alias("page"), s["confidence"].alias("confidence"))))
    out = out.withColumn("leave_days", F.col("__leave.leave_days")).drop("__leave", "best_page_type")
    return with_quality(out)


def with_quality(rows: DataFrame) -> DataFrame:
    """Units with what they lack, what looks wrong, what is uncertain, and their confidence."""
    lacks = lambda c: F.col(c).isNull()
    no_codes = F.size(_list("codes")) == 0
    missing = F.array_compact(F.array(F.when(lacks("patient"), "patient"), F.when(lacks("provider"), "provider"), F.when(lacks("document_date"), "document_date"), F.when(no_codes, "clinical.cids")))
    unboxed = lambda c: ~lacks(c) & F.col(c)["bbox"].isNull()
    birth = F.lower(F.coalesce(F.col("document_date")["snippet"], F.lit(""))).rlike(medico_legal.BIRTH_MARKERS)
    odd_name = ~checks.person_name(F.coalesce(F.col("patient")["name"], F.lit("")), stops=canonical.NO_NAMES)
    warnings = F.array_compact(
        F.array(
            F.when(unboxed("patient"), "patient_without_exact_bbox"), F.when(unboxed("provider"), "provider_without_exact_bbox"), F.when(unboxed("document_date"), "document_date_without_exact_bbox"),
            F.when(odd_name, "implausible_patient_name"), F.when(birth, "document_date_looks_like_birth_date"), F.when(~lacks("provider") & F.col("provider")["crm"].isNull(), "provider_without_crm"),
            F.when(F.exists(F.coalesce("code_evidence", F.array().cast("array<struct<code:string,page:int,bbox:array<double>>>")), lambda c: c["page"].isNull() | (c["page"] == 999)), "cid_without_page_evidence"),
        )
    )
    unsure = lambda c, name: F.when(lacks(c), f"{name}_unknown").when(F.col(c)["review_state"] != "auto_confirmed", f"{name}_needs_review")
    uncertain = F.array_compact(F.array(unsure("patient", "patient"), unsure("provider", "provider"), unsure("document_date", "document_date"), F.when(no_codes, "cid_unknown")))
    boxed = F.exists(F.coalesce("code_evidence", F.array().cast("array<struct<code:string,page:int,bbox:array<double>>>")), lambda c: c["bbox"].isNotNull())
    code_sure = F.when(no_codes, None).when(boxed, 0.95).otherwise(0.78)
    sures = F.array_compact(F.array(F.col("patient")["confidence"], F.col("provider")["confidence"], F.col("document_date")["confidence"], code_sure))
    positive = F.filter(sures, lambda x: x > 0)
    overall = F.round(F.aggregate(positive, F.lit(0.0), lambda a, x: a + x) / F.size(positive), 3)
    rows = rows.withColumn("missing", missing).withColumn("warnings", warnings).withColumn("uncertainties", uncertain).withColumn("overall_confidence", F.when(F.size(positive) > 0, overall).otherwise(0.0))
    enough = (F.size("missing") <= 1) & ~F.array_contains("warnings", "implausible_patient_name") & ~F.array_contains("warnings", "document_date_looks_like_birth_date")
    return rows.withColumn("has_minimum_entities", enough)


def evidence_refs(anchors: DataFrame, key: list[str]) -> DataFrame:
    """(key, evidence_refs): anchors and zones of a unit as references, each once in order."""
    ref = F.struct("page", "bbox", "snippet", F.coalesce("source_path", F.lit("page_evidence")).alias("source_path"), F.coalesce("provenance_status", F.when(F.col("bbox").isNotNull(), "exact").otherwise("unknown")).alias("provenance_status"), "confidence", "label", "value")
    once = keep_first(anchors, [*key, "page", "bbox", "snippet", "source_path"], ["ord"])
    return once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", ref.alias("r")))), lambda x: x["r"]).alias("evidence_refs"))


def spans_of(spans: DataFrame, pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Spans of the pages that are named."""
    return spans.join(pages.select(key, "page").distinct(), [key, "page"], "left_semi")


def provider_anchor_matches(anchor_text: Column, name: Column) -> Column:
    """Whether an anchor shows a provider: it holds the name, or four fifths of their words are the same."""
    a, n = text.identity_text(anchor_text), text.identity_text(name)
    return (F.length(n) > 0) & (F.contains(a, n) | (text.jaccard(F.split(a, " "), F.split(n, " ")) >= 0.8))


def resolution_block(c: str) -> Column:
    """A resolved person or date as the block of a contract: value, confidence, evidence, assertion level and reason."""
    r = F.col(c)
    value = r["name"] if c != "document_date" else r["date_iso"]
    level = F.when(r["bbox"].isNotNull() & (r["provenance_status"] == "exact"), "observed").otherwise("inferred")
    return F.when(
        value.isNotNull(),
        F.struct(
            value.alias("value"), r["confidence"].alias("confidence"), r["review_state"].alias("review_state"), level.alias("assertion_level"),
            F.struct(r["page"].alias("page"), r["bbox"].alias("bbox"), r["snippet"].alias("snippet"), r["provenance_status"].alias("provenance_status")).alias("evidence"), F.concat(F.lit(c), F.lit("_canonical_value")).alias("reason"),
        ),
    )


def candidates(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, value, confidence, review_state, page): every value that a unit was resolved to, as candidates."""
    one = lambda field, c, v: F.when(F.col(c).isNotNull(), F.struct(F.lit(field).alias("field"), F.col(c)[v].alias("value"), F.col(c)["confidence"].cast("double").alias("confidence"), F.col(c)["review_state"].alias("review_state"), F.col(c)["page"].cast("int").alias("page")))
    codes = F.transform("code_evidence", lambda e: F.struct(F.lit("cid").alias("field"), e["code"].alias("value"), F.when(e["bbox"].isNotNull(), 0.95).otherwise(0.78).alias("confidence"), F.when(e["bbox"].isNotNull(), "auto_confirmed").otherwise("review_recommended").alias("review_state"), e["page"].cast("int").alias("page")))
    kind = "array<struct<field:string,value:string,confidence:double,review_state:string,page:int>>"
    made = F.concat(F.array_compact(F.array(one("patient", "patient", "name"), one("mother", "mother", "name"), one("provider", "provider", "name"), one("document_date", "document_date", "date_iso"))).cast(kind), F.coalesce(codes.cast(kind), F.array().cast(kind)))
    return rows.select(*key, F.posexplode(made).alias("ord", "c")).select(*key, "ord", "c.*")


# --- context ---------------------------------------------------------------------------------------------------------


def escalation(pages: DataFrame, anchors: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, n_anchors, exact_rate, escalate, reason): documents whose fast reading wasn't good enough: no anchors, fewer than
    three fifths of them placed, or clinical markers without people. Pages without evidence count too."""
    found = anchors.groupBy(key).agg(F.count("*").alias("n_anchors"), F.count_if(F.col("bbox").isNotNull()).alias("n_exact"))
    named = F.coalesce(F.exists(F.map_keys("people"), lambda k: k.isin("patient", "provider")), F.lit(False))
    seen = pages.groupBy(key).agg(F.max(named).alias("has_people"), F.max(F.lower(F.coalesce("text", F.lit(""))).rlike("|".join(CLINICAL_MARKERS))).alias("is_clinical"))
    rows = seen.join(found, key, "left").na.fill(0, ["n_anchors", "n_exact"])
    rate = F.when(F.col("n_anchors") > 0, F.col("n_exact") / F.col("n_anchors")).otherwise(0.0)
    reason = F.when(F.col("n_anchors") == 0, "no_anchors").when(rate < 0.60, "low_exact_rate").when(F.col("is_clinical") & ~F.col("has_people"), "clinical_without_people")
    return rows.select(key, "n_anchors", rate.alias("exact_rate"), reason.isNotNull().alias("escalate"), reason.alias("reason"))


def decision_details(decision: Column, signals: Column) -> Column:
    return F.struct(decision["mode"].alias("mode"), F.array(decision["reason"]).alias("reasons"), decision["confidence"].alias("confidence"), signals.alias("signals"))


def escalation_details(mode: Column) -> Column:
    """From a mode to the next one, and how that is reported."""
    after = F.when(mode == "fast", "standard").when(mode == "standard", "forensic")
    report = lambda s: F.lit(s)
    return F.when(after.isNotNull(), F.struct(mode.alias("from_mode"), after.alias("to_mode"), report("low_extract_quality_after_fast_path").alias("reason"), report("pipeline_fallback_to_standard").alias("warning_code"), report("standard_reprocess_after_fast_path").alias("degraded_mode")))


def page_names(pages: DataFrame, key: str) -> DataFrame:
    """(key, __p_patient, __p_mother, __p_provider): the best name of each role over the pages of a document, by confidence less for
    pages down the ranks, and more for a provider beside a registration. The first page wins ties. Pages are read once for all roles, and
    what is shuffled is the best of each task."""
    rank = F.coalesce(F.try_element_at(_map(CONTEXT_RANK), F.lower("page_type")), F.lit(2))

    def candidate(role: str) -> Column:
        p = F.try_element_at("people", F.lit(role))
        score = F.coalesce(p["confidence"], F.lit(0.0)) - rank * 0.03
        if role == "provider":
            score = score + F.when(F.size(_list("basic.crm")) > 0, 0.05).otherwise(0.0)
        plausible = lambda value: F.when(checks.person_name(value, stops=canonical.NO_NAMES), F.struct((-score).alias("s"), F.col("page").alias("page"), value.alias("value")))
        return F.when(p["name"].isNotNull(), let(text.trim_marks(p["name"]), plausible)).alias(role)

    roles = ("patient", "mother", "provider")
    found = pages.select(key, *[candidate(r) for r in roles]).groupBy(key).agg(*[F.min(r).alias(r) for r in roles])
    return found.select(key, *[F.col(r)["value"].alias(f"__p_{r}") for r in roles])


def names(documents: DataFrame, pages: DataFrame, key: str = "document_id") -> DataFrame:
    """documents(key, patient, mother, provider structs) -> (key, patient, mother, provider): the canonical name if it is
    plausible, else the best of the pages."""
    out = documents.select(key, *[F.when(checks.person_name(F.col(r)["name"], stops=canonical.NO_NAMES), F.col(r)["name"]).alias(f"__{r}") for r in ("patient", "mother", "provider")])
    out = out.join(page_names(pages, key), key, "left")
    return out.select(key, *[F.coalesce(f"__{r}", f"__p_{r}").alias(r) for r in ("patient", "mother", "provider")])


def primary_codes(canonical_codes: Column, found: Column) -> Column:
    return F.when(F.size(_list(canonical_codes)) > 0, canonical_codes).otherwise(_list(found))


def event_type(hint: Column, snippet: Column, literal: Column, kind: Column) -> Column:
    """The type of a seed: its hint, else by the words of its snippet, else by the shape of its date."""
    s = F.lower(F.coalesce(snippet, F.lit("")))
    has = lambda x: F.contains(s, F.lit(x))
    dated = F.coalesce(literal, F.lit("")) != ""
    return F.coalesce(
        F.nullif(hint, F.lit("")),
        F.when(has("nascto") | has("nascimento"), "birth_date").when(has("internado") & has("do dia") & dated, "internacao_inicio").when(has("ao dia") & dated, "internacao_fim")
        .when(has("a partir desta data"), "afastamento_inicio").when(has("afastado") & has("dia(s)"), "afastamento_fim_estimado").when(s.rlike("s[aã]o paulo,"), "document_issue_date")
        .when(F.lower(kind) == "textual_pt", "document_issue_date"),
    )


def with_unit_or_document(seeds: DataFrame, unit_rows: DataFrame, document_rows: DataFrame, columns: list[str], key: str = "document_id") -> DataFrame:
    """seeds with columns of their unit, or of their document where the unit isn't known. A known unit that lacks a value
    lacks it; the document's doesn't step in."""
    u = unit_rows.select(key, "unit_id", F.lit(True).alias("__known"), *[F.col(c).alias(f"__u_{c}") for c in columns])
    d = document_rows.select(key, *[F.col(c).alias(f"__d_{c}") for c in columns])
    out = seeds.join(u, [key, "unit_id"], "left").join(d, key, "left")
    return out.select(*[c for c in seeds.columns if c not in columns], *[F.when(F.coalesce("__known", F.lit(False)), F.col(f"__u_{c}")).otherwise(F.col(f"__d_{c}")).alias(c) for c in columns])


def page_classes(evidence: DataFrame, zones: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, page, value, confidence): the class of each page by its core snippets, else its anchors, else its text."""
    joined = lambda core: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(core, F.struct("ord", "snippet")))), lambda x: x["snippet"]), " ")
    said = zones.groupBy(key, "page").agg(joined(F.col("zone") == "core_probative").alias("core"), joined(F.lit(True)).alias("every"))
    rows = evidence.select(key, "page", "text").join(said, [key, "page"], "left")
    return rows.select(key, "page", F.inline(F.array(document_types.page_label(F.col("core"), F.col("every"), F.col("text")))))


def context(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """documents(key, media, text, canonical_type, width, height, taken, seconds) -> (key, document_type, event_type, confidence,
    rule): pictures, films and sounds are events of their kind if a fact about them is known; documents have the type
    that their text and their canonical record give, and nothing without a text."""
    kind = document_types.inferred_type(F.col("text"), F.col("canonical_type"))
    guarded = (kind["value"] == "identidade") & F.col("canonical_type").isin(document_types.MEDICAL_PAPERS)
    value = F.when(guarded, F.col("canonical_type")).otherwise(kind["value"])
    sure = F.when(guarded, F.greatest(kind["confidence"], F.lit(0.88))).otherwise(kind["confidence"])
    known = F.when(F.col("media") == "imagem", F.coalesce("width", "height").isNotNull() | F.col("taken").isNotNull()).when(F.col("media").isin("audio", "video"), F.col("seconds").isNotNull())
    paper = ~F.col("media").isin("imagem", "audio", "video") & (F.trim(F.coalesce("text", F.lit(""))) != "") & value.isNotNull()
    return documents.select(
        key, F.when(paper, value).alias("document_type"), F.when(known, F.col("media")).when(paper, value).alias("event_type"), F.when(known, 0.9).when(paper, sure).alias("confidence"),
        F.when(known, "media_kind_to_tipo_evento").when(paper, "document_taxonomy_rules_v3").alias("rule"),
    )


def transcription_wanted(media: Column) -> Column:
    return media.isin("audio", "video")


# --- projections -----------------------------------------------------------------------------------------------------


def public_rows(seeds: DataFrame, key: str = "document_id") -> DataFrame:
    """Seeds as rows of the public timeline: dated ones, in order of date, unit and id."""
    kind = F.coalesce("event_hint", F.lit("evento_detectado"))
    rows = seeds.where("date_iso IS NOT NULL").select(
        key, F.col("seed_id").alias("event_id"), F.col("date_iso").alias("date"), kind.alias("event_type"), "unit_id", kind.alias("title"), "confidence", "review_state", "provenance_status",
        F.coalesce("assertion_level", F.when(F.col("provenance_status") == "exact", "observed").otherwise("inferred")).alias("assertion_level"), F.struct("page", "bbox", "snippet", "unit_id").alias("evidence_navigation"),
    )
    return rows.orderBy(key, "date", F.coalesce("unit_id", F.lit("")), F.coalesce("event_id", F.lit("")))


def timeline_v1(events: DataFrame, warned: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """One row a document: its events in order of date, priority and id, counts, and a score of consistency that is 0 for
    documents in warned(key)."""
    label = F.coalesce(F.try_element_at(_map(medico_legal.EVENT_LABELS), F.col("event_type")), F.initcap(F.replace("event_type", F.lit("_"), F.lit(" "))), F.lit("Evento probatório"))
    state = F.coalesce("review_state", confidence_of.review(F.col("confidence")))
    first = F.coalesce(F.try_element_at(_map(medico_legal.EVENT_PRIORITY), F.col("event_type")), F.lit(500))
    row = F.struct(F.coalesce("date_iso", F.lit("9999-99-99")).alias("sort_date"), first.alias("priority"), F.coalesce("event_id", F.lit("")).alias("event_id"), "event_type", F.coalesce("title", label).alias("title"), "date_iso", "confidence", state.alias("review_state"), "provenance_status", F.array_distinct(F.transform(_list("codes"), lambda c: F.concat(F.lit("cid:"), c))).alias("tags"))
    out = events.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("events"), F.count("*").alias("total_events"), F.count_if(state.isin("needs_review", "review_recommended")).alias("needs_review_count"))
    bad = F.lit(False)
    if warned is not None:
        out = out.join(warned.select(key, F.lit(True).alias("__bad")).distinct(), key, "left")
        bad = F.coalesce("__bad", F.lit(False))
    return out.withColumn("timeline_consistency_score", F.when(bad, 0.0).otherwise(100.0)).drop("__bad")


def entity_summary(documents: DataFrame, pages: DataFrame, hard: DataFrame, events: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, patient, mother, provider, cids, crms, cpfs, cnpjs): the first name over canonical record, pages and events;
    lists of the record, the hard entities and the events, each value once in that order."""
    roles = ("patient", "mother", "provider")
    people = documents.select(key, *[F.col(r)["name"].alias(r) for r in roles], _list("codes").alias("__c"), F.array_compact(F.array(page_entities.crm_parts(F.concat(F.lit("CRM "), F.col("provider")["crm"]))["display"])).alias("__m"))
    by_page = pages.groupBy(key).agg(*[F.min_by(F.try_element_at("people", F.lit(r))["name"], F.when(F.try_element_at("people", F.lit(r)).isNotNull(), F.col("page"))).alias(f"__p_{r}") for r in roles])
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(F.coalesce("page", F.lit(999)).alias("p"), "value")))), lambda x: x["value"])
    found = hard.groupBy(key).agg(*[listed(k).alias(f"__h_{k}") for k in ("cid", "crm", "cpf", "cnpj")])
    order = F.struct("date_iso", "event_id")
    told = events.groupBy(key).agg(*[F.min_by(r, F.when(F.col(r).isNotNull(), order)).alias(f"__e_{r}") for r in ("patient", "provider")], F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("date_iso", "event_id", _list("codes").alias("c")))), lambda x: x["c"])).alias("__e_c"))
    out = people
    for df in (by_page, found, told):
        out = out.join(df, key, "left")
    crms = F.transform(_list("__h_crm"), lambda v: F.concat(F.lit("CRM "), v))
    return out.select(
        key, F.coalesce("patient", "__p_patient", "__e_patient").alias("patient"), F.coalesce("mother", "__p_mother").alias("mother"), F.coalesce("provider", "__p_provider", "__e_provider").alias("provider"),
        F.array_distinct(F.concat("__c", _list("__h_cid"), _list("__e_c"))).alias("cids"), F.array_distinct(F.concat("__m", crms)).alias("crms"), F.array_distinct(_list("__h_cpf")).alias("cpfs"), F.array_distinct(_list("__h_cnpj")).alias("cnpjs"),
    )


def suggested_action(review_state: Column, provenance: Column, has_box: Column) -> Column:
    return (
        F.when(provenance == "estimated", SUGGESTED["estimated"]).when(provenance.isin("inferred", "text_fallback", "snippet_only") | ~has_box, SUGGESTED["evidence"])
        .when(review_state.isin("needs_review", "review_recommended"), SUGGESTED["review"]).otherwise(SUGGESTED["none"])
    )


REVIEW_COLUMNS = ["document_id", "source_ord", "item_type", "field", "value", "confidence", "review_state", "provenance_status", "reason", "source_signal", "suggested_action"]


def review_items(documents: DataFrame, events: DataFrame, inconsistent: DataFrame) -> DataFrame:
    """What a person has to look at, from six sources in order: people, date and codes of canonical documents, events that are
    estimated, inferred or without a box, documents whose own date is none of the days they were issued, and
    documents in inconsistent(document_id), whose timelines differ."""

    def item(df, source, kind, field, value, sure, state, how, boxed, reason, signal, action=None):
        state = F.coalesce(state, confidence_of.review(sure))
        how = F.coalesce(how, F.when(boxed, "exact").otherwise("inferred"))
        action = suggested_action(state, how, boxed) if action is None else action
        parts = {"source_ord": F.lit(source), "item_type": F.lit(kind), "field": field, "value": value.cast("string"), "confidence": sure.cast("double"), "review_state": state, "provenance_status": how, "reason": reason, "source_signal": F.lit(signal), "suggested_action": action}
        return df.select("document_id", *[c.alias(n) for n, c in parts.items()])

    out = []
    for role in ("patient", "mother", "provider"):
        r = F.col(role)
        out.append(item(documents.where(r["name"].isNotNull()), 0, "person", F.lit(role), r["name"], r["confidence"], r["review_state"], r["provenance_status"], r["bbox"].isNotNull(), F.lit(f"{role}_canonical_value"), "canonical.people"))
    d = F.col("document_date")
    out.append(item(documents.where(d["date_iso"].isNotNull()), 1, "document_date", F.lit("document_date"), d["date_iso"], d["confidence"], d["review_state"], d["provenance_status"], d["bbox"].isNotNull(), F.lit("document_date_canonical_value"), "canonical.document_date"))
    coded = documents.select("document_id", F.explode("code_evidence").alias("e"))
    boxed = F.col("e")["bbox"].isNotNull()
    out.append(item(coded, 2, "clinical_code", F.lit("cid"), F.col("e")["code"], F.when(boxed, 0.9).otherwise(0.7), F.when(boxed, "auto_confirmed").otherwise("review_recommended"), F.lit(None).cast("string"), boxed, F.lit("clinical_cid_detected"), "canonical.codes"))
    placed = F.coalesce(F.exists("citations", lambda c: c["bbox"].isNotNull()), F.lit(False))
    how = F.coalesce("provenance_status", F.when(~placed, "inferred"))
    unsure = events.where(F.col("provenance_status").isin("estimated", "inferred") | ~placed)
    why = F.when(F.col("provenance_status") == "estimated", "estimated_probatory_event").otherwise("inferred_probatory_event_without_exact_bbox")
    todo = F.when(F.col("provenance_status") == "estimated", "confirm_estimated_event_bounds").otherwise("confirm_event_with_exact_evidence")
    out.append(item(unsure, 3, "event", F.col("event_type"), F.col("event_id"), F.col("confidence"), F.col("review_state"), how, placed, why, "events", todo))
    issued = events.where("event_type = 'document_issue_date' AND date_iso IS NOT NULL").groupBy("document_id").agg(F.collect_set("date_iso").alias("days"))
    differs = documents.join(issued, "document_id").where(d["date_iso"].isNotNull() & ~F.array_contains("days", d["date_iso"]))
    conflict = (F.lit(0.99), F.lit("needs_review"), F.lit("conflict"), F.lit(False))
    out.append(item(differs, 4, "conflict", F.lit("document_date"), d["date_iso"], *conflict, F.lit("canonical_document_date_differs_from_layer3_document_issue_date"), "canonical.document_date", F.lit("reconcile_document_date_sources")))
    out.append(item(inconsistent.select("document_id").distinct(), 5, "conflict", F.lit("timeline_seed_vs_layer3"), F.lit(None), *conflict, F.lit("timeline_seed_layer3_divergence"), "timeline_consistency_v1", F.lit("reconcile_timeline_sources")))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole.select(*REVIEW_COLUMNS)


def review_counts(items: DataFrame, key: str = "document_id") -> DataFrame:
    return items.groupBy(key).agg(F.count("*").alias("total_items"), F.count_if(F.col("review_state").isin("needs_review", "review_recommended")).alias("needs_review_count"))


def subdocument_rows(unit_rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Sub-documents as the public timeline lists them."""
    return unit_rows.select(key, "unit_id", "pages", "document_type", F.col("patient.name").alias("patient"), F.col("provider.name").alias("provider"), F.col("document_date.date_iso").alias("document_date"), "warnings", "uncertainties", F.col("overall_confidence").alias("confidence"))


def subdocument_notice(unit_rows: DataFrame, key: str = "document_id") -> DataFrame:
    return unit_rows.groupBy(key).agg(F.count("*").alias("subdocument_count"), F.lit(True).alias("has_subdocuments"))


def artefact_uri(artefacts: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, artifact_uri): of the original artefact, else of the first. artefacts(key, ord, kind, uri)."""
    return best(artefacts, [key], [F.col("kind") != "original", F.col("ord")]).select(key, F.col("uri").alias("artifact_uri"))


def candidate_dates(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """pages(key, page, text, dates) -> (key, births, first_candidate): days that stand in a line which speaks of a birth, and the first day of the
    document that doesn't."""
    line = lambda d: F.lower(F.coalesce(canonical.line_of(F.col("text"), d["literal"]), d["literal"]))
    told = F.transform("dates", lambda d: F.struct(d["date_iso"].alias("day"), line(d).rlike(medico_legal.BIRTH_MARKERS).alias("birth")))
    rows = pages.select(key, "page", told.alias("told")).select(key, "page", F.transform(F.filter("told", lambda x: x["birth"]), lambda x: x["day"]).alias("born"), F.try_element_at(F.filter("told", lambda x: ~x["birth"] & x["day"].isNotNull()), F.lit(1))["day"].alias("first"))
    return rows.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("born"))).alias("births"), F.min_by("first", F.when(F.col("first").isNotNull(), F.col("page"))).alias("first_candidate"))


def normalised(documents: DataFrame, pages: DataFrame, is_birth: Callable[[Column], Column], key: str = "document_id") -> DataFrame:
    """documents(key, inferred_date, estimated_date, exif_date, document_date, first_candidate, document_type, codes) -> (key,
    date_canonical, period_label, place, tags)."""
    date = canonical.canonical_date(F.col("inferred_date"), F.col("estimated_date"), F.col("exif_date"), F.col("document_date.date_iso"), F.lit(None).cast("string"), F.col("first_candidate"), is_birth)
    rows = documents.select(key, date.alias("date_canonical"), canonical.tags(F.col("document_type"), F.col("codes")).alias("tags"))
    places = canonical.place(pages.select(key, "page", F.col("basic.city").alias("city"), F.col("basic.uf").alias("uf")), [key])
    return rows.join(places, key, "left").withColumn("period_label", canonical.period(F.col("date_canonical")))


def daily_period(date: Column) -> Column:
    """The older label of a period: the day itself."""
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(date, 1, 10))


def canonical_people(listed: DataFrame, pages: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, kind, value): entities that the context lists, then the best patient of the pages (a little more for medical
    pages, the first of equals), each once."""
    p = F.try_element_at("people", F.lit("patient"))
    medical = F.when(F.lower("page_type").isin(medico_legal.MEDICAL_PAGES), 0.03).otherwise(0.0)
    rows = pages.select(key, "page", p["name"].alias("value"), (F.coalesce(p["confidence"], F.lit(0.0)) + medical).alias("score")).where("value IS NOT NULL")
    patient = best(rows, [key], [F.col("score").desc(), F.col("page")]).select(key, F.lit("paciente").alias("kind"), "value", F.lit((1 << 31) - 1).alias("ord"))
    every = listed.select(key, "kind", "value", F.col("ord").cast("int").alias("ord")).unionByName(patient)
    return keep_first(every.where("kind <> '' AND value <> ''"), [key, "kind", "value"], ["ord"])


def dossier_payload(documents: DataFrame, events: DataFrame, summary: DataFrame, items: DataFrame, key: str = "document_id") -> DataFrame:
    """One auditable record a document: what it is, its timeline with assertion levels, its entities, what waits for review,
    counts and disclaimers."""
    from .readmodel import assertion_of_dossier

    row = F.struct(F.coalesce("date_iso", F.lit("9999-99-99")).alias("sort_date"), "event_id", "event_type", "title", "description", "date_iso", "confidence", "review_state", "provenance_status", assertion_of_dossier(F.col("provenance_status")).alias("assertion_level"), "citations")
    anchored = F.exists("citations", lambda c: c["bbox"].isNotNull() & c["page"].isNotNull())
    timeline = events.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("timeline"), F.count("*").alias("total_events"), F.count_if(anchored).alias("anchored_events"))
    waiting = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_ord", "item_type", "field", "value", "review_state", "suggested_action"))).alias("review_items"), F.count_if(F.col("review_state").isin("needs_review", "review_recommended")).alias("needs_review_count"))
    whole = documents.select(key, F.struct(*[F.col(c) for c in documents.columns]).alias("document"))
    people = summary.select(key, F.struct("patient", "mother", "provider", "cids", "crms").alias("entities"))
    out = whole.join(timeline, key, "left").join(people, key, "left").join(waiting, key, "left")
    return out.select(key, F.lit("dossier_auditavel_v1").alias("version"), "document", "timeline", "entities", "review_items", F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_events", "needs_review_count", "anchored_events")]).alias("summary"), F.array(*[F.lit(x) for x in DISCLAIMERS]).alias("disclaimers"))


#: What every dossier says of itself.
DISCLAIMERS = (
    "Derivados de mídia podem continuar não materializados, mas read models Layer5 são persistidos no DocumentMemory e podem ser projetados no read-model store.",
    "Eventos inferidos ou estimados permanecem marcados explicitamente e não equivalem a fato observado.",
)


def provenance(has_events: Column) -> Column:
    """struct of the signals that a case view rests on, each once."""
    groups = F.array(F.lit("entities_canonical_v1"), F.lit("legal_canonical_fields_v1"), F.lit("timeline_seed_v2"), F.when(has_events, "layer3.eventos_probatorios"), F.lit("layer5.read_models.entity_summary_v1"), F.lit("layer5.read_models.review_items_v1"))
    return F.struct(F.array_distinct(F.array_compact(groups)).alias("source_signals"))


def case_totals(events: DataFrame, links: DataFrame, scope: str = "scope_id", document: str = "document_id") -> DataFrame:
    """(scope, n_documents, n_events, n_links, documents) of a case."""
    own = events.groupBy(scope).agg(F.count_distinct(document).alias("n_documents"), F.count("*").alias("n_events"), F.array_sort(F.collect_set(document)).alias("documents"))
    return own.join(links.groupBy(scope).agg(F.count("*").alias("n_links")), scope, "left").na.fill(0, ["n_links"])


def first_entities(facts: DataFrame, key: str = "document_id") -> DataFrame:
    """facts(key, kind, ord, value) -> (key, kind, first_value, distinct_values): the older summary of entities."""
    return facts.where("value IS NOT NULL").groupBy(key, "kind").agg(F.min_by("value", "ord").alias("first_value"), F.array_sort(F.collect_set("value")).alias("distinct_values"))


def integrity(documents: DataFrame, artefacts: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, violation): rows of documents and artefacts that break a constraint."""
    bad = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "fingerprint is no sha256"), F.when(F.col("ingested_at").isNull(), "no time of ingestion"),
            F.when(F.coalesce("size_bytes", F.lit(0)) <= 0, "no content"), F.when(F.trim(F.coalesce("filename", F.lit(""))) == "", "no name"),
        )
    )
    own = documents.select(key, F.explode(bad).alias("violation"))
    originals = artefacts.groupBy(key).agg(F.count_if(F.col("kind") == "original").alias("n"), F.count_if(F.trim(F.coalesce("uri", F.lit(""))) == "").alias("blank"))
    rows = documents.select(key).join(originals, key, "left").na.fill(0, ["n", "blank"])
    more = F.array_compact(F.array(F.when(F.col("n") == 0, "no original artefact"), F.when(F.col("n") > 1, "several original artefacts"), F.when(F.col("blank") > 0, "an artefact without uri")))
    return own.unionByName(rows.select(key, F.explode(more).alias("violation")))


def event_rows_of_layout(candidates: DataFrame, spans: DataFrame, key: str = "document_id") -> DataFrame:
    """candidates(key, ord, literal) and spans(key, span_ord, text, page, bbox) -> every pair whose span holds the literal, wherever in
    its words that begins and ends."""
    return literal_pairs(candidates, spans, key)


def implausible_issue_date(date_iso: Column, kind: Column) -> Column:
    """Dates that a legacy timeline leaves out: births, and days before 1950."""
    return (kind == "birth_date") | ((kind == "document_issue_date") & (date_iso < "1950-01-01"))


def run_stage(df: DataFrame, stage: Callable[[DataFrame], DataFrame], name: str, engine: str, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """What a stage makes of df, and a row of the log for each document that came out of it."""
    from ..sources import sinks

    out = df.transform(stage)
    return out, sinks.processing_events(out.select(key).distinct(), key, name, engine, {})
