"""Patterns of pages: what they skip at once changes nothing that they find."""

import random

from pyspark.sql import functions as F

from cartulary.operators import hard_entities, page_entities


def test_medicines_are_found_as_by_the_plain_pattern(spark):
    """The pattern looks ahead before it tries a name; what it finds is the same."""
    plain = page_entities.MEDICINE.replace(r"(?-iu:(?=[^0-9:;,.()/\[\]]{3,41}+\s*+[0-9]))", "")
    assert plain != page_entities.MEDICINE
    rng, parts = random.Random(7), ["Dipirona", " ", "  ", "\n", "500", "mg", "g", " ml", ",5", "1)", "-", "a", "é", "Ácido fólico", "x" * 20, ":", ".", "de", "(", "7", " " * 30]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    other = rows.select("t", page_entities.all_of(F.col("t"), plain, 0).alias("a"), page_entities.all_of(F.col("t"), page_entities.MEDICINE, 0).alias("b")).where("a <> b")
    assert other.count() == 0


def test_lines_with_signs_between_letters_are_no_names(spark):
    texts = ["ANA MARIA SOUZA", " |:ANA LIMA;. ", "Sr. Rui Braga", "Nome: Ana Lima", "Ana Lima 3", "Ana, Lima", "sr(a) Ana Lima", "Ana/Lima Reis", ": . Ana Lima ,"]
    rows = spark.createDataFrame([("\n".join(texts),)], "t string")
    assert rows.select(page_entities.name_lines(F.col("t")).alias("n")).first()["n"] == ["ANA MARIA SOUZA", "ANA LIMA", "Rui Braga"]


def test_a_text_is_cut_at_its_codes_once(spark):
    made = spark.range(1).select(hard_entities.codes_in_context(F.lit("x")).alias("c")).drop("id")
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(hard_entities.codes_in_context(F.col("t")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert made.first()["c"] == [] and plan.count("split(") == 1
