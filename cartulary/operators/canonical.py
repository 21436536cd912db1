"""Canonical entities: who a document is about, when it was made, where, under which tags.

Candidates are rows; a score is a column; the choice is a rank with explicit ties. The same functions serve pages,
sub-documents and documents: ``unit`` names the columns of the grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.text import cut_at, identity_text
from .medico_legal import BIRTH_MARKERS
from .ranking import best, best_without, keep_first

#: Rank of page types; words that end a name in a header; phrases that are no names.
PAGE_RANK = {"atestado_medico": 0, "parecer_medico": 0, "laudo_medico": 0, "documento_composto": 1, "documento_medico": 2, "formulario_administrativo": 4}
NAME_ENDS = ["CPF", "RG", "RGHC", "CRM", "Data", "Nascimento", "Idade", "Sexo", "Endereço", "Convênio"]
NO_NAMES = ["são paulo", "sao paulo", "hospital", "clínica", "prefeitura", "secretaria"]
EMISSION = "data:|emissão|emissao|assinatura"


def page_rank(page_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PAGE_RANK.items() for x in kv]), F.lower(page_type)), F.lit(3))


def line_of(text: Column, literal: Column) -> Column:
    """The line of the first place of a literal, in lower case; null where it doesn't occur."""
    low = F.lower(text)
    at = F.instr(low, F.lower(literal))
    head = F.substring_index(F.left(low, at - 1), "\n", -1)
    return F.when(at > 0, F.concat(head, F.substring_index(F.substring(low, at, F.length(low)), "\n", 1)))


def best_anchors(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """The anchor of each label of a page: with a box first, then the most confident, then the first."""
    return best(anchors, [*keys, "label"], [F.col("bbox").isNull(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("ord")])


def people(candidates: DataFrame, unit: list[str]) -> DataFrame:
    """candidates(unit, page, page_type, role, name, confidence, bbox, snippet, crm) -> one row for each role: patient
    first, then mother and provider among those who aren't the patient.

    A score is the confidence, more for a box, for a patient's full name and for a provider's registration, less for
    pages further down the ranks."""
    name = cut_at(F.col("name"), NAME_ENDS)
    rows = candidates.withColumn("name", name).where(checks.person_name(F.col("name"), stops=NO_NAMES)).withColumn("identity", identity_text("name"))
    rows = rows.where(F.when(F.col("role") == "patient", (F.size(F.split("name", " ")) >= 3) | F.col("bbox").isNotNull()).otherwise(True))
    sure = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.70))
    boxed = F.when(F.col("bbox").isNotNull(), 0.04).otherwise(0.0)
    provider = F.when(F.col("crm").isNotNull(), 0.08).otherwise(0.0) - 0.03 * page_rank(F.col("page_type"))
    person = F.when((F.col("role") == "patient") & (F.size(F.split("name", " ")) >= 3), 0.06).otherwise(0.0) - 0.04 * page_rank(F.col("page_type"))
    rows = rows.withColumn("sure", sure).withColumn("score", sure + boxed + F.when(F.col("role") == "provider", provider).otherwise(person))
    order = [F.col("score").desc(), F.col("bbox").isNull(), F.coalesce("page", F.lit(999)), F.col("name")]
    patient = best(rows.where("role = 'patient'"), unit, order)
    chosen = patient
    for role in ("mother", "provider"):
        chosen = chosen.unionByName(best_without(rows.where(F.col("role") == role), unit, "identity", patient, order))
    state = F.when((F.col("role") == "provider") & (F.col("bbox").isNull() | F.col("crm").isNull()), "needs_review").when(F.col("sure") >= 0.95, "auto_confirmed").otherwise("review_recommended")
    return chosen.select(*unit, "role", "name", "crm", F.round("sure", 3).alias("confidence"), state.alias("review_state"), "page", "bbox", F.when(F.col("bbox").isNotNull(), "exact").otherwise("text_fallback").alias("provenance_status"), F.coalesce("snippet", F.concat_ws(": ", "role", "name")).alias("snippet"))


def document_dates(candidates: DataFrame, unit: list[str]) -> DataFrame:
    """candidates(unit, page, page_type, page_text, ord, literal, date_iso, bbox, snippet) -> the day of each unit:
    never one beside a mark of birth; one with a box before all others, then the best score, then the first page."""
    rows = candidates.where("literal <> '' AND date_iso <> ''").withColumn("line", line_of(F.col("page_text"), F.col("literal")))
    said = F.coalesce("snippet", "literal")
    rows = rows.where(~F.lower(said).rlike(BIRTH_MARKERS) & ~F.coalesce(F.col("line").rlike(BIRTH_MARKERS), F.lit(False)))
    score = 0.70 + F.when(F.col("bbox").isNotNull(), 0.20).otherwise(0.0) + F.when(page_rank(F.col("page_type")) <= 1, 0.05).otherwise(0.0) + F.when(F.coalesce(F.col("line").rlike(EMISSION), F.lit(False)), 0.45).otherwise(0.0)
    rows = rows.withColumn("score", score).where("score > 0.20")
    found = best(rows, unit, [F.col("bbox").isNull(), F.col("score").desc(), F.coalesce("page", F.lit(999)), F.col("ord")])
    boxed = F.col("bbox").isNotNull()
    return found.select(*unit, "date_iso", "literal", "page", "bbox", said.alias("snippet"), F.when(boxed, 0.97).otherwise(F.round(F.greatest("score", F.lit(0.05)), 3)).alias("confidence"), F.when(boxed, "auto_confirmed").otherwise("review_recommended").alias("review_state"), F.when(boxed, "exact").otherwise("text_fallback").alias("provenance_status"))


def codes(found: DataFrame, unit: list[str]) -> DataFrame:
    """found(unit, page, page_rank, ord, code, bbox, page_text) -> each code once with its score, in order of page and
    code. A code that is the name of a city cut short, or that isn't whole, is left out."""
    whole = F.col("code").rlike(r"^[A-Z]\d{2}(\.\d)?$") & ~((F.col("code") == "S30") & F.lower("page_text").rlike("s30 paulo|sao paulo"))
    score = F.when(F.col("bbox").isNotNull(), 0.9).otherwise(0.7) - 0.03 * F.col("page_rank")
    once = best(found.where(whole).withColumn("score", score), [*unit, "code"], [F.col("score").desc(), F.col("ord")])
    return once.select(*unit, "code", F.round("score", 3).alias("score"), "page").orderBy(*unit, F.coalesce("page", F.lit(999)), "code")


def canonical_date(inferred: Column, estimate: Column, exif: Column, document_date: Column, resolved: Column, first_candidate: Column, is_birth) -> Column:
    """The order of sources of a document's date. A birth date among the inferred ones or the document's own is passed
    over; as the estimate it ends the search without a date."""
    return (
        F.when(inferred.isNotNull() & ~is_birth(inferred), inferred)
        .when(estimate.isNotNull() & is_birth(estimate), F.lit(None).cast("string"))
        .otherwise(F.coalesce(estimate, exif, F.when(document_date.isNotNull() & ~is_birth(document_date), document_date), resolved, first_candidate))
    )


def period(date: Column) -> Column:
    return F.when(date.rlike(r"^\d{4}-\d{2}"), F.substring(date, 1, 7))


def place(pages: DataFrame, unit: list[str]) -> DataFrame:
    """`city, UF` of the first page that names both."""
    return pages.where("city <> '' AND uf <> ''").groupBy(*unit).agg(F.min_by(F.concat_ws(", ", "city", "uf"), "page").alias("place"))


def tags(doc_type: Column, code_list: Column) -> Column:
    return F.array_distinct(F.concat(F.array_compact(F.array(doc_type)), F.coalesce(F.transform(code_list, lambda c: F.concat(F.lit("cid:"), c)), F.array().cast("array<string>"))))


def read_model(documents: DataFrame, events: DataFrame, review_items: DataFrame) -> DataFrame:
    """documents(document_id, media, doc_type, patient, provider, date_canonical, codes, text) with their events and review items ->
    the searchable row."""
    from .readmodel import executive_summary, title

    happened = events.groupBy("document_id").agg(F.array_sort(F.collect_set("event_type")).alias("event_types"), F.count("*").alias("n_events"))
    waiting = review_items.groupBy("document_id").agg(F.count("*").alias("n_review_items"))
    rows = documents.join(happened, "document_id", "left").join(waiting, "document_id", "left")
    empty = F.array().cast("array<string>")
    kinds, cids = F.coalesce("event_types", empty), F.coalesce("codes", empty)
    parts = [F.replace("doc_type", F.lit("_"), F.lit(" ")), F.concat(F.lit("Paciente: "), "patient"), F.concat(F.lit("Prestador: "), "provider"), F.concat(F.lit("Data: "), "date_canonical")]
    return rows.select(
        "document_id", title(F.col("doc_type"), F.col("patient"), F.col("media"), F.col("document_id")).alias("title"), executive_summary(parts, cids, "Documento sem síntese.").alias("summary"),
        "doc_type", "patient", "provider", "date_canonical", period(F.col("date_canonical")).alias("period_label"), cids.alias("cids"), kinds.alias("event_types"), tags(F.col("doc_type"), cids).alias("tags"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_review_items", F.lit(0)).alias("n_review_items"),
        F.lower(F.concat_ws(" ", "doc_type", "patient", "provider", cids, kinds, "text")).alias("search_text"),
    )


def review_items(events: DataFrame, people_rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """What a person has to look at, from events without an exact place, unsure people, and warnings."""
    from .readmodel import review_queue

    unsure = events.where(F.col("provenance_status").isin("estimated", "inferred") | ~F.exists("citations", lambda c: c["bbox"].isNotNull()))
    who = people_rows.where("review_state <> 'auto_confirmed'")
    item = lambda df, field, value: df.select("document_id", field.alias("field"), value.alias("value"))
    sources = [("event", item(unsure, F.col("event_type"), F.col("date_iso"))), ("person", item(who, F.col("role"), F.col("name"))), ("warning", item(warnings, F.col("code"), F.col("message")))]
    queue = review_queue(sources, ["document_id", "field", "value"])
    return keep_first(queue, ["document_id", "source", "field", "value"], ["source_ord"])


def narrative(date: Column, patient: Column, n_events: Column, n_review: Column, doc_type: Column) -> Column:
    """Five plain sentences on a document."""
    return F.concat_ws(
        " ", F.concat(F.lit("Documento do tipo "), F.coalesce(doc_type, F.lit("desconhecido")), F.lit(".")), F.when(date.isNull(), "Sem data canônica confirmada.").otherwise(F.concat(F.lit("Data canônica: "), date, F.lit("."))),
        F.when(patient.isNull(), "Paciente não identificado.").otherwise(F.concat(F.lit("Paciente: "), patient, F.lit("."))), F.concat(n_events.cast("string"), F.lit(" eventos registrados.")), F.concat(n_review.cast("string"), F.lit(" itens para revisão.")),
    )
