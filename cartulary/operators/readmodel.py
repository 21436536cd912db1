"""Read models: the searchable row, its filters, pages of results, text search, review queue, entity summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_score, snippet


def contains_ci(column: str | Column, wanted: str) -> Column:
    c = column if isinstance(column, Column) else F.col(column)
    return F.contains(F.lower(c), F.lit(wanted.lower()))


def any_contains_ci(array: str, wanted: str) -> Column:
    return F.exists(array, lambda x: F.contains(F.lower(x), F.lit(wanted.lower())))


def has_all(array: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), array)) == 0


def matches(q=None, period=None, event_type=None, tags=None, date=None, start=None, end=None, patient=None, provider=None, cid=None, doc_type=None) -> Column:
    """All filters of a search, each left out if it is None. Dates are compared as ISO strings."""
    tests = [F.lit(True)]
    if q is not None:
        tests.append(contains_ci("search_text", q))
    if period is not None:
        tests.append(F.col("period_label") == period)
    if event_type is not None:
        tests.append(any_contains_ci("event_types", event_type))
    if tags:
        tests.append(has_all(F.col("tags"), tags))
    if date is not None:
        tests.append(F.col("date_canonical") == date)
    if start is not None:
        tests.append(F.col("date_canonical") >= start)
    if end is not None:
        tests.append(F.col("date_canonical") <= end)
    for column, wanted in (("patient", patient), ("provider", provider)):
        if wanted is not None:
            tests.append(contains_ci(column, wanted))
    if cid is not None:
        tests.append(any_contains_ci("cids", cid))
    if doc_type is not None:
        tests.append(F.lower("doc_type") == doc_type.lower())
    out = tests[0]
    for t in tests[1:]:
        out = out & F.coalesce(t, F.lit(False))
    return out


def page(df: DataFrame, date: str, key: str, skip: int, limit: int) -> DataFrame:
    """Latest first, undated last, ties by key: a top-k and no full sort."""
    return df.orderBy(F.coalesce(F.col(date), F.lit("")).desc(), F.col(key)).offset(skip).limit(min(max(limit, 1), 200))


def search(df: DataFrame, key: str, text: str, query: str, limit: int, least: float = 0.15) -> DataFrame:
    """Hits of a text search, best first, with a snippet."""
    # The best rows are taken before the bound of the score and the snippet, so the score is computed once a row.
    found = df.where(F.col(key).isNotNull()).withColumn("score", search_score(F.col(text), query))
    return found.orderBy(F.col("score").desc(), key).limit(max(1, limit)).where(F.col("score") >= least).select(key, F.round("score", 6).alias("score"), snippet(F.col(text), F.lit(query)).alias("snippet"))


def title(doc_type: Column, patient: Column, media: Column, document_id: Column) -> Column:
    named = F.concat_ws(" - ", F.replace(doc_type, F.lit("_"), F.lit(" ")), F.nullif(patient, F.lit("")))
    return F.coalesce(F.nullif(named, F.lit("")), F.concat_ws(" ", media, F.left(document_id, F.lit(8))))


def executive_summary(parts: list[Column], codes: Column, default: str) -> Column:
    """Parts that are there, then the first three codes."""
    shown = F.when(F.size(codes) > 0, F.array_join(F.slice(codes, 1, 3), ", "))
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts, shown), F.lit("")), F.lit(default))


def review_queue(sources: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """UNION ALL of review items; each source has its name and its place."""
    out = None
    for i, (name, df) in enumerate(sources):
        df = df.select(F.lit(i).alias("source_ord"), F.lit(name).alias("source"), *columns)
        out = df if out is None else out.unionByName(df)
    return out


def entity_summary(facts: DataFrame, by: str) -> DataFrame:
    """facts(by, kind, ord, value) -> first value, and the distinct values in order, of each kind."""
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ord", "value")))), lambda x: x["value"])
    return facts.groupBy(by, "kind").agg(F.min_by(F.col("value"), F.when(F.col("value").isNotNull(), F.col("ord"))).alias("first_value"), F.array_join(F.array_distinct(values), ",").alias("all_values"))


def case_view(models: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document: its read model with its timeline in order, what waits for review, and counts. Lists are those
    of one document, so their size is bounded by it."""
    timeline = events.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("date_iso", "event_id", "event_type", "title", "confidence", "review_state", "provenance_status"))).alias("timeline"), F.count_if(F.col("provenance_status") == "exact").alias("n_exact"))
    waiting = items.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("source", "field", "value"))).alias("review"))
    rows = models.join(timeline, "document_id", "left").join(waiting, "document_id", "left")
    return rows.withColumn("n_exact", F.coalesce("n_exact", F.lit(0))).withColumn("n_waiting", F.coalesce(F.size("review"), F.lit(0)))


def assertion_of_dossier(provenance: Column) -> Column:
    return F.when(provenance == "estimated", "estimated").when(provenance.isin("inferred", "text_fallback", "snippet_only"), "inferred").otherwise("observed")


def dossier(events: DataFrame, rows_a_page: int = 40) -> DataFrame:
    """(document_id, line_no, page_no, line): the printed dossier, a line of at most 120 characters an event, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("date_iso", "event_id")
    line = F.left(F.concat_ws(" | ", "date_iso", "event_type", "title", assertion_of_dossier(F.col("provenance_status"))), F.lit(120))
    numbered = events.select("document_id", F.row_number().over(w).alias("line_no"), line.alias("line"))
    return numbered.withColumn("page_no", F.floor((F.col("line_no") - 1) / rows_a_page).cast("int") + 1)


def panel_row(events: DataFrame) -> DataFrame:
    """Public timeline rows: label, date as it is shown, and where the first citation leads."""
    first = F.try_element_at("citations", F.lit(1))
    return events.select("document_id", "event_id", F.col("event_type").alias("label"), "date_iso", F.coalesce(F.date_format(F.try_to_timestamp("date_iso"), "dd/MM/yyyy HH:mm"), "date_iso").alias("display_date"), first["page"].alias("page"), first["bbox"].alias("bbox"), F.transform("codes", lambda c: F.concat(F.lit("cid:"), c)).alias("tags"))
