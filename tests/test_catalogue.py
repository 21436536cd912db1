"""Every query of the catalogue beside its oracle in DuckDB, on the smallest tables."""

import glob
import os

import pytest

from cartulary.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else glob.glob(path + '/*.parquet')[0]}'")
    return con


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted([tuple(plain(r[i]) for i in order) for r in table], key=repr)


def test_each_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_each_item_meets_the_documents_that_share_a_token(spark, tmp_path):
    """Whatever the ids: item 77 has no document of that id or of that rest by 40."""
    spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "nothing shared"), (77, "Alpha, beta! omega"), (78, "delta delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): (r["overlap"], r["jaccard"]) for r in catalogue.QUERIES["token_pairs_by_content"](spark, str(tmp_path)).collect()}
    assert got == {(1, 77): (0.666667, 0.5), (2, 78): (1.0, 1.0)}


def test_the_best_line_may_stand_in_any_document(spark, tmp_path):
    docs = [(1, "unrelated line\n\none two three"), (900, "x\nbefore The quick brown fox jumps over it after"), (901, "so the quick brown fox jumps over itself")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "he quick brown fox jumps over it"), (2, "three two one four"), (3, "absent")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["doc_id"], r["line_no"], r["score"]) for r in catalogue.QUERIES["span_best_line_of_all"](spark, str(tmp_path)).collect()}
    assert got == {1: (900, 1, 18.5714), 2: (1, 2, 10.0)}


def test_a_line_that_just_meets_the_bound_is_native(spark, duck, tmp_path):
    """66 letters of 90 characters: 0.3 for the length and 2.2 for the letters, 2.5 together. 84 of 120 likewise."""
    docs = [(1, "a" * 66 + "." * 24 + "\nxyz"), (2, "b" * 84 + "." * 36 + "\nxyz"), (3, "b" * 65 + "." * 25 + "\nxyz")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: r["n"] for r in catalogue.QUERIES["page_merge_quality"](spark, str(tmp_path)).collect()}
    want = duck.sql(catalogue.ORACLES["page_merge_quality"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert got == {"native": 2, "ocr": 1} == dict(want)


def test_costly_pages_are_dealt_out_whatever_the_file(spark):
    """A customer file of one row group is one task by itself."""
    from cartulary.plans import pages

    sizes = pages._pages(spark, SF).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 2


def test_people_of_pages_meet_once(spark):
    """Scores and names alone are shuffled, once; of equal scores the last name counts, and a mother isn't the patient."""
    from pyspark.sql import functions as F

    from cartulary.operators import page_entities

    kind = "d int, text string, basic struct<patient_name:string,mother_name:string,person_candidates:array<string>>, clinical struct<provider_name:string>"
    text = "Nome paciente: Ana Lima\nMãe: Bia Costa\nNome paciente: Eva Reis"
    rows = [(1, text, ("Ana Lima", "Bia Costa", ["Eva Reis"]), (None,)), (2, "nada", (None, None, []), (None,)), (3, "Mãe: Ana Lima", (None, "Ana Lima", []), (None,))]
    found = page_entities.people_of(spark.createDataFrame(rows, kind), ["d"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.d, r.role): r["name"] for r in found.collect()}
    assert got[1, "patient"] == "Eva Reis" and got[1, "mother"] == "Bia Costa" and got[3, "mother"] == "Ana Lima" and not [k for k in got if k[0] == 2]
    assert found.where(F.col("raw_score") <= 0).count() == 0


def test_names_of_all_roles_are_found_in_one_pass(spark):
    """One pass over the pages, one shuffle of each side; equal scores go to the first page, implausible names to none."""
    from cartulary.operators import stages

    person = "struct<name:string,confidence:double,review_state:string>"
    docs = spark.createDataFrame([(1, None, None, None), (2, None, None, None)], f"document_id int, patient {person}, mother {person}, provider {person}")
    pages = spark.createDataFrame(
        [(1, 2, "laudo_medico", {"patient": ("Bia Lima", 0.9, "s"), "provider": ("Rui Reis", 0.8, "s")}, (["1"],)), (1, 1, "laudo_medico", {"patient": ("Eva Lima", 0.9, "s"), "provider": ("Ivo Reis", 0.82, "s")}, ([],)), (2, 1, None, {"patient": ("Hospital 7", 0.9, "s")}, (None,)), (2, 2, None, None, None)],
        f"document_id int, page int, page_type string, people map<string,{person}>, basic struct<crm:array<string>>",
    )
    found = stages.names(docs, pages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan
    assert {r.document_id: (r.patient, r.mother, r.provider) for r in found.collect()} == {1: ("Eva Lima", None, "Rui Reis"), 2: (None, None, None)}
