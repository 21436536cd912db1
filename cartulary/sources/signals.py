"""Signals: JSON kept in strings under a key, decoded to typed tables, with warnings for what doesn't fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the signals that have one; other keys stay text.
SCHEMAS: dict[str, str] = {
    "page_evidence_v1": "array<struct<page:int,page_text:string,subdoc_id:string,page_taxonomy:struct<value:string>,people:struct<patient_name:string,patient_confidence:double,mother_name:string,provider_name:string>,date_candidates:array<struct<literal:string,date_iso:string,kind:string>>,clinical_entities:struct<cids:array<string>>>>",
    "timeline_seed_v2": "array<struct<seed_id:string,date_iso:string,event_hint:string,page:int,bbox:array<double>,snippet:string,subdoc_id:string,confidence:double,review_state:string,provenance_status:string>>",
    "layout_spans_v1": "array<struct<page:int,text:string,bbox:array<double>>>",
    "causal_link_v1": "array<struct<event_a_id:string,event_b_id:string,rule_id:string,confidence:double,explanation:string,weakening_factors:array<string>>>",
}


def decode(signals: DataFrame, key: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """signals(document_id, key, value) -> (document_id, item) and the warnings (document_id, key, warning): values that
    are no JSON give no item and a warning; nothing is rejected because of a missing field."""
    own = signals.where(F.col("key") == key)
    kind = schema or SCHEMAS[key]
    parsed = own.select("document_id", "value", F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("items"), F.try_parse_json("value").isNotNull().alias("is_json"))
    rows = parsed.select("document_id", F.posexplode_outer("items").alias("ord", "item")).where("item IS NOT NULL") if kind.startswith("array") else parsed.select("document_id", F.col("items").alias("item")).where("item IS NOT NULL")
    warnings = parsed.where(F.col("value").isNotNull() & (~F.coalesce("is_json", F.lit(False)) | F.col("items").isNull())).select("document_id", F.lit(key).alias("key"), F.when(~F.coalesce("is_json", F.lit(False)), "not JSON").otherwise("not of the schema").alias("warning"))
    return rows, warnings


def benchmark_cases(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Cases in `*.json` and `*/case.json` below path, with case_path and case_ord in the order of their paths. A case is a
    file that a person wrote, so the paths are sorted on the driver."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    df = (reader.schema(schema) if schema else reader).json(path).withColumn("case_path", F.input_file_name())
    paths = sorted(r[0] for r in df.select("case_path").distinct().collect())
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths, 1)], "case_path string, case_ord int")
    return df.join(order, "case_path")


def contract(df: DataFrame, key: str, *layers: str) -> DataFrame:
    """(key, contract): the outbound record as JSON, nulls included."""
    return df.select(key, F.to_json(F.struct(key, *layers), {"ignoreNullFields": "false"}).alias("contract"))
