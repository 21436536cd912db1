"""Small expressions on values: rounding, moments, paths, values with provenance, errors of stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it and whether or not that is within another
    function of arrays. Spark would compute it each time it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_half_even(value: Column, places: int = 2) -> Column:
    """Halves go to the even digit: what scores that are compared with published ones are rounded by."""
    return F.bround(value, places)


def moment(text: Column) -> Column:
    """A whole time stamp, else the day at the start of the text; null where neither can be read."""
    whole = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text))
    return F.coalesce(whole, F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10))))


def day_string(value: Column) -> Column:
    """The day of a time stamp or of a text that starts with one."""
    return F.date_format(moment(value.cast("string")), "yyyy-MM-dd")


def path(df: DataFrame, dotted: str, default: Column | None = None) -> Column:
    """A field within structs by its dotted path, or the default (null) where df has no such field."""
    kind, steps = df.schema, dotted.split(".")
    for step in steps:
        if not hasattr(kind, "fieldNames") or step not in kind.fieldNames():
            return F.lit(None) if default is None else default
        kind = kind[step].dataType
    found = F.col(f"`{steps[0]}`")
    for step in steps[1:]:
        found = found.getField(step)
    return found if default is None else F.coalesce(found, default)


def provenanced(value: Column, source: str, method: str, confidence: float = 1.0) -> Column:
    """A value with where it comes from; a missing one is insufficient and has no confidence."""
    there = value.isNotNull()
    return F.struct(value.alias("valor"), F.lit(source).alias("fonte"), F.lit(method).alias("metodo"), F.when(there, "confirmado").otherwise("insuficiente").alias("estado"), F.when(there, confidence).otherwise(0.0).alias("confianca"))


#: What an engine's time-out is reported as.
TIMEOUT_MARK = "tesseract process timeout"
TIMEOUT_SAID = (
    "OCR excedeu o timeout operacional no PDF escaneado. A extração foi interrompida de forma controlada; tente reduzir resolução/páginas ou executar OCR assíncrono."
)


def error_details(error_type: Column, message: Column) -> Column:
    """struct of a stage's error: a time-out of recognition is told in words, with a code and the cause."""
    said = F.coalesce(F.nullif(F.trim(message), F.lit("")), error_type)
    late = F.contains(F.lower(said), F.lit(TIMEOUT_MARK))
    return F.struct(
        error_type.alias("error_type"), F.when(late, TIMEOUT_SAID).otherwise(said).alias("message"), F.when(late, said).alias("cause_message"), F.when(late, "ocr_timeout").alias("code"), F.when(late, "error").alias("severity"),
    )


def inferred_offline(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """What a language model's inference gives without the model: no type, no periods, no entities, and the rule that says so."""
    none = F.array().cast("array<string>")
    return documents.select(key, F.lit(None).cast("string").alias("document_type"), none.alias("periods"), none.alias("entities"), F.array(F.lit("llm_offline_missing_api_key")).alias("rules"))
