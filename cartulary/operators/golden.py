"""Benchmark cases: what was expected of a document beside what came out, as a table of checks.

A case is a row with an expected and an actual struct. Each axis is a flat list of checks that are built by expressions
on the row, so a benchmark of any size is one projection, one explode and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scoring

_V = "STRUCT<source_path: STRING, page: INT, snippet: STRING, bbox: ARRAY<DOUBLE>, provenance_status: STRING, confidence: DOUBLE>"
_E = f"STRUCT<value: STRING, date_iso: STRING, code: STRING, provenance_status: STRING, status: STRING, review_state: STRING, confidence: DOUBLE, evidence: {_V}>"
SCHEMA = f"""id STRING, title STRING,
expected STRUCT<document_type: STRING, entities: STRUCT<patient: STRING, provider: STRING, mother: STRING, cids: ARRAY<STRING>, document_date: STRING>,
  forbidden_entities: STRUCT<patient: ARRAY<STRING>, provider: ARRAY<STRING>, mother: ARRAY<STRING>, cids: ARRAY<STRING>, document_date: ARRAY<STRING>>,
  events: ARRAY<STRUCT<event_type: STRING, date_iso: STRING>>, forbidden_events: ARRAY<STRUCT<event_type: STRING, date_iso: STRING>>,
  forbidden_document_dates: ARRAY<STRING>, legally_useful_event_types: ARRAY<STRING>>,
actual STRUCT<document_type: STRING, entities: STRUCT<patient: {_E}, provider: {_E}, mother: {_E}, document_date: {_E}, cids: ARRAY<{_E}>>,
  events: ARRAY<STRUCT<event_type: STRING, title: STRING, description: STRING, date_iso: STRING, provenance_status: STRING, status: STRING, review_state: STRING, confidence: DOUBLE,
    entities: STRUCT<patient: STRING, provider: STRING>, evidence: {_V}, citations: ARRAY<{_V}>>>,
  review_items: ARRAY<STRING>, warnings: ARRAY<STRING>, timeline_consistency: STRUCT<score: DOUBLE>, timeline_consistency_score: DOUBLE>"""

#: Fields that are compared, and the names of the three kinds of provenance.
FIELDS = ("patient", "provider", "mother", "cids", "document_date")
OBSERVED, INFERRED, ESTIMATED = ["observed", "exact", "confirmado", "confirmed"], ["inferred", "inferido"], ["estimated", "estimado"]
KNOWN = OBSERVED + INFERRED + ESTIMATED
#: Cases that must be clean, and cases that must still fail, for the gate.
CLEAN = ("001_atestado_afastamento", "002_parecer_cid", "005_documento_composto", "006_paciente_vs_mae", "010_divergencia_seed_layer3", "011_evento_estimado_com_explicacao")
SENTINELS = ("003_regressao_data_nascimento", "004_receituario_vs_atestado", "007_prestador_falso_positivo", "008_cid_espurio")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """`*.json` below path, a case each."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def _plain(value: Column) -> Column:
    return F.coalesce(F.upper(F.trim(F.regexp_replace(value, r"\s+", " "))), F.lit(""))


def _value(e: Column) -> Column:
    return F.coalesce(*[F.nullif(e[k], F.lit("")) for k in ("value", "date_iso", "code")])


def _status(item: Column) -> Column:
    own = F.coalesce(F.nullif(item["provenance_status"], F.lit("")), item["status"], item["evidence"]["provenance_status"])
    return F.lower(F.trim(own))


def _confidence(item: Column) -> Column:
    return F.coalesce(item["confidence"], item["evidence"]["confidence"])


def _complete(v: Column) -> Column:
    """Page, snippet and a box of four."""
    return F.coalesce(v["page"].isNotNull() & (F.length(v["snippet"]) > 0) & (F.size(v["bbox"]) == 4), F.lit(False))


def _evidence(event: Column) -> Column:
    return F.coalesce(event["evidence"], F.try_element_at(event["citations"], F.lit(1)))


def _check(axis: str, ok: Column, counts: bool = True) -> Column:
    """counts: whether a false check is a regression."""
    return F.struct(F.lit(axis).alias("axis"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(counts).alias("counts"))


_NONE = "array<struct<axis:string,ok:boolean,counts:boolean>>"


def _listed(array: Column, each) -> Column:
    """Checks of every element of an array that may be missing; each returns an array of checks."""
    return F.coalesce(F.flatten(F.transform(array, each)), F.array().cast(_NONE))


def _where(condition: Column, *made: Column) -> Column:
    return F.when(condition, F.array(*made)).otherwise(F.array().cast(_NONE))


def _found(required: Column) -> Column:
    """The first actual event of the required type and date; what a requirement leaves out matches all."""
    fits = lambda e: F.coalesce((F.nullif(required["event_type"], F.lit("")).isNull() | (e["event_type"] == required["event_type"])), F.lit(False)) & F.coalesce((F.nullif(required["date_iso"], F.lit("")).isNull() | (e["date_iso"] == required["date_iso"])), F.lit(False))
    return F.try_element_at(F.filter("actual.events", fits), F.lit(1))


def _scored_items() -> Column:
    """Every entity and event that is there, as (status, confidence, review_state)."""
    row = lambda x: F.struct(_status(x).alias("status"), _confidence(x).alias("confidence"), x["review_state"].alias("review_state"))
    single = F.array_compact(F.array(*[F.when(F.col(f"actual.entities.{f}").isNotNull(), row(F.col(f"actual.entities.{f}"))) for f in FIELDS if f != "cids"]))
    empty = F.array().cast("array<struct<status:string,confidence:double,review_state:string>>")
    many = [F.coalesce(F.transform(a, row), empty) for a in ("actual.entities.cids", "actual.events")]
    return F.concat(single, *many)


def checks(cases: DataFrame) -> DataFrame:
    """(case_id, axis, ok, counts) of all cases; axis human_review beside the five axes."""
    cases = cases.withColumn("items", _scored_items())
    ids, parts = F.col("id").alias("case_id"), []
    parts.append(_where(F.col("expected.document_type").isNotNull(), _check("entidades", _plain(F.col("actual.document_type")) == _plain(F.col("expected.document_type")))))
    for f in FIELDS:
        want, got = F.col(f"expected.entities.{f}"), F.col(f"actual.entities.{f}")
        if f == "cids":
            codes = F.coalesce(F.transform(got, lambda e: _plain(_value(e))), F.array().cast("array<string>"))
            ok = F.forall(F.transform(want, _plain), lambda w: F.array_contains(codes, w))
            anchors = F.when(want.isNotNull(), _listed(got, lambda e: F.array(_check("evidencia", _complete(e["evidence"]))))).otherwise(F.array().cast(_NONE))
            forbidden = lambda v: F.array(_check("entidades", ~F.array_contains(codes, _plain(v))))
        else:
            ok = _plain(_value(got)) == _plain(want)
            anchors = _where(want.isNotNull() & got.isNotNull(), _check("evidencia", _complete(got["evidence"])))
            forbidden = lambda v, got=got: F.array(_check("entidades", _plain(_value(got)) != _plain(v)))
        parts += [_where(want.isNotNull(), _check("entidades", ok)), anchors, _listed(F.col(f"expected.forbidden_entities.{f}"), _bound(forbidden))]
    parts.append(_listed(F.col("expected.events"), lambda r: F.array(_check("eventos", _found(r).isNotNull()))))
    parts.append(_listed(F.col("expected.forbidden_events"), lambda r: F.array(_check("eventos", _found(r).isNull()))))
    parts.append(_listed(F.col("expected.events"), lambda r: _where(_found(r).isNotNull(), _check("evidencia", _complete(_evidence(_found(r)))))))
    banned = F.col("expected.forbidden_document_dates")
    day = _value(F.col("actual.entities.document_date"))
    parts.append(_where(F.size(banned) > 0, _check("confiabilidade", ~F.coalesce(F.array_contains(banned, day), F.lit(False)))))
    sure = lambda c: c.isNull() | ((c >= 0.0) & (c <= 1.0))
    parts.append(_listed(F.col("items"), lambda x: F.array(_check("confiabilidade", x["status"].isin(KNOWN)), _check("confiabilidade", sure(x["confidence"])))))
    parts.append(_listed(F.col("actual.events"), lambda e: _where(F.contains(e["event_type"], F.lit("estimado")) & ~F.coalesce(_status(e).isin(ESTIMATED), F.lit(False)), _check("confiabilidade", F.lit(False)))))
    parts.append(_listed(F.col("expected.events"), _utility))
    review = lambda x: F.coalesce(x["status"].isin(INFERRED + ESTIMATED), F.lit(False)) | F.coalesce(x["review_state"].isin("needs_review", "review_recommended"), F.lit(False))
    parts.append(_listed(F.col("items"), lambda x: _where(review(x), _check("human_review", F.length(x["review_state"]) > 0))))
    unsure = F.exists(F.coalesce("actual.events", F.array().cast(cases.schema["actual"].dataType["events"].dataType)), lambda e: F.coalesce(_status(e).isin(INFERRED + ESTIMATED), F.lit(False)))
    parts.append(_where(unsure, _check("human_review", F.size("actual.review_items") > 0)))
    return cases.select(ids, F.explode_outer(F.concat(*parts)).alias("c")).select("case_id", "c.*")


def _bound(each):
    return lambda v: each(v)


def _utility(required: Column) -> Column:
    """Eight checks of a required event, four of which count as regressions; one false check where it is missing."""
    e, axis = _found(required), "utilidade_juridica"
    status, sure = _status(e), _confidence(e)
    exact, useful = _complete(_evidence(e)), F.col("expected.legally_useful_event_types")
    there = lambda c: F.length(c) > 0
    eight = [
        _check(axis, there(e["title"]), False), _check(axis, there(e["description"])), _check(axis, there(e["review_state"]), False), _check(axis, (sure >= 0.0) & (sure <= 1.0)), _check(axis, status.isin(KNOWN)),
        _check(axis, exact | status.isin(INFERRED + ESTIMATED)), _check(axis, F.when(F.size(useful) > 0, F.array_contains(useful, e["event_type"])).otherwise(True), False), _check(axis, there(e["entities"]["patient"]), False),
    ]
    return F.when(e.isNotNull(), F.array(*eight)).otherwise(F.array(_check(axis, F.lit(False), False)))


def evaluate(cases: DataFrame) -> DataFrame:
    """One row a case: five axes, score, human_review (100 without checks), timeline_consistency, regressions."""
    rows = checks(cases)
    axis = lambda a, none: F.round(F.coalesce(F.avg(F.when(F.col("axis") == a, 100.0 * F.col("ok").cast("int"))), F.lit(none)), 2).alias(a)
    scored = rows.groupBy("case_id").agg(*[axis(a, 0.0) for a in scoring.AXES], axis("human_review", 100.0), F.count_if(~F.col("ok") & F.col("counts")).alias("regressions"))
    diverges = F.exists(F.coalesce("actual.warnings", F.array().cast("array<string>")), lambda w: F.get_json_object(w, "$.code") == "timeline_seed_v2_layer3_divergence")
    given = F.coalesce("actual.timeline_consistency_score", "actual.timeline_consistency.score")
    consistency = F.round(scoring.bounded(F.coalesce(given, F.when(F.coalesce(diverges, F.lit(False)), 0.0).otherwise(100.0))), 2)
    mean = F.round(sum((F.col(a) for a in scoring.AXES), F.lit(0.0)) / len(scoring.AXES), 2)
    return scored.withColumn("score", mean).join(cases.select(F.col("id").alias("case_id"), consistency.alias("timeline_consistency")), "case_id")


def totals(scores: DataFrame) -> DataFrame:
    """Means over the cases, and the mean of the means of the axes."""
    means = scores.agg(*[F.round(F.avg(a), 2).alias(a) for a in (*scoring.AXES, "human_review", "timeline_consistency")], F.count("*").alias("cases"), F.sum("regressions").alias("regressions"))
    return means.withColumn("overall", F.round(sum((F.col(a) for a in scoring.AXES), F.lit(0.0)) / len(scoring.AXES), 2))
