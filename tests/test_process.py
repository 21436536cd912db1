"""The facade and the stages that the catalogue's queries don't show: files to read models, engines, sinks, and small
expressions with known values."""

import struct

import pytest
from pyspark.sql import functions as F

from cartulary.api import Collection
from cartulary.functions import values
from cartulary.operators import document_types, hard_entities, legal_fields, medico_legal, page_entities, process, readmodel, segment, stages
from cartulary.sources import files, recognition, sinks

NOTE = """ATESTADO MÉDICO
Nome paciente: ANA MARIA SOUZA Nascimento: 01/02/1980
Esteve internado(a) neste hospital do dia 01/03/2024 ao dia 05/03/2024 e fica afastado(a) por 15 dias.
CID F32.1, diagnosticado nesta data
São Paulo, 10 de março de 2024
Prestador: CARLOS EDUARDO LIMA
CRM-SP: 123456"""


@pytest.fixture(scope="module")
def collection(spark):
    pages = spark.createDataFrame([("d1", 1, NOTE), ("d1", 2, "folha em branco"), ("d2", 1, "PARECER MÉDICO\nPaciente: BEATRIZ LIMA COSTA\nCID M54.5 em 20/05/2024\nDr. Rui Melo Santos\nCRM 9999"), ("d3", 1, "")], "document_id string, page int, text string")
    spans = spark.createDataFrame([("d1", 1, 0, "Nome paciente: ANA MARIA SOUZA", [0.0, 0.0, 9.0, 9.0]), ("d1", 1, 1, "CID F32.1", [0.0, 9.0, 9.0, 18.0])], "document_id string, page int, span_ord int, text string, bbox array<double>")
    return Collection(pages=pages, spans=spans)


def test_from_pages_to_events(collection):
    t = collection.processed()
    docs = {r["document_id"]: r for r in t.documents.collect()}
    assert docs["d1"]["patient"]["name"] == "ANA MARIA SOUZA" and docs["d1"]["patient"]["bbox"] == [0.0, 0.0, 9.0, 9.0] and docs["d1"]["patient"]["provenance_status"] == "exact"
    assert docs["d1"]["document_type"] == "atestado_medico" and docs["d1"]["codes"] == ["F32.1"] and docs["d1"]["provider"]["crm"] == "123456" and docs["d1"]["leave_days"] == 15
    assert (docs["d1"]["stay_start"]["date_iso"], docs["d1"]["leave_end"]["date_iso"]) == ("2024-03-01", "2024-03-20")
    assert docs["d2"]["document_type"] == "parecer_medico" and docs["d3"]["patient"] is None and docs["d3"]["has_minimum_entities"] is False and "patient_unknown" in docs["d3"]["uncertainties"]
    events = {(r["document_id"], r["event_type"]): r["date_iso"] for r in t.events.collect()}
    assert events[("d1", "internacao_inicio")] == "2024-03-01" and events[("d1", "afastamento_fim_estimado")] == "2024-03-20" and events[("d2", "parecer_emitido")] == "2024-05-20"
    assert ("d1", "document_issue_date") not in events and ("d2", "registro_condicao_clinica") in events


def test_read_models_and_views(collection):
    t = collection.processed()
    models = {r["document_id"]: r for r in t.models.collect()}
    assert set(models) == {"d1", "d2", "d3"} and models["d1"]["title"] == "atestado medico - ANA MARIA SOUZA" and "cid:F32.1" in models["d1"]["tags"] and models["d1"]["timeline"]["total_events"] == 4
    assert models["d3"]["search_text"] and models["d3"]["timeline"]["total_events"] == 0
    assert {r["document_id"] for r in t.models.where(readmodel.matches(q="maria souza", cid="f32")).collect()} == {"d1"}
    told = collection.narrative("d1").first()["narrative"]
    assert told.startswith("Memória do tipo documento. Registrada em ") and told.count(".") == 5 and "ainda não classificado" not in told
    case = collection.case("d1").first()
    assert len(case["timeline"]) == 4 and "layer3.eventos_probatorios" in case["provenance"]["source_signals"] and case["total_canonical_fields"] >= 1
    dossier = collection.dossier("d1").first()
    assert dossier["version"] == "dossier_auditavel_v1" and len(dossier["timeline"]) == 4 and [e["sort_date"] for e in dossier["timeline"]] == sorted(e["sort_date"] for e in dossier["timeline"]) and len(dossier["disclaimers"]) == 2
    assert collection.infer_context("d2").first()["document_type"] == "parecer_medico" and [r["page"] for r in collection.extract("d1").collect()] == [1, 2]
    summary = {r["document_id"]: r for r in t.summary.collect()}
    assert summary["d1"]["patient"] == "ANA MARIA SOUZA" and summary["d1"]["crms"] == ["CRM 123456"] and summary["d3"]["patient"] is None
    events, links = collection.causal_timeline()
    assert [r["pos"] for r in events.orderBy("pos").collect()] == list(range(1, events.count() + 1)) and {r["rule_id"] for r in links.collect()} >= {"rule_mesmo_cid_multiplos_documentos"}


def test_models_are_saved_and_read(collection, tmp_path):
    assert collection.save(f"{tmp_path}/models").where("document_id = 'd2'").count() == 1


def test_files_to_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text(NOTE)
    (tmp_path / "b.txt").write_text(NOTE)
    (tmp_path / "c.txt").write_text("outro texto")
    got = Collection.of_files(spark, str(tmp_path))
    assert got.pages.count() == 2 and got.processed().models.where("patient = 'ANA MARIA SOUZA'").count() == 1
    assert Collection.health(spark).first()["status"] == "ok"


def test_hard_entities_of_a_note(collection):
    found = {(r["type"], r["role"], r["value"]): r for r in collection.processed().hard.where("document_id = 'd1'").collect()}
    assert ("date", "birth_date", "01/02/1980") in found and found[("date", "internacao_fim", "05/03/2024")]["confidence"] == 0.97 and ("crm", None, "123456") in found and ("cid", None, "F32.1") in found
    assert found[("patient_name", None, "ANA MARIA SOUZA")]["confidence"] == 0.98


def test_recognition_without_and_with_an_engine(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"page")
    (tmp_path / "b.bin").write_bytes(b"fail")
    words, pages = recognition.recognised(spark, str(tmp_path), None)
    assert words.count() == 0 and {r["status"] for r in pages.collect()} == {"skipped"}

    def engine(data):
        if data == b"fail":
            raise RuntimeError("timeout")
        return [(1, 0, "recognised text of a page", (0, 0, 1, 1), 90.0), (1, 0, "unsure", (0, 0, 1, 1), 10.0), (1, 0, " ", (0, 0, 1, 1), 99.0), (1, 0, "no box", (0, 0, 1), 99.0), (9, 0, "too far", (0, 0, 1, 1), 99.0)]

    words, pages = recognition.recognised(spark, str(tmp_path), engine)
    assert [r["text"] for r in words.collect()] == ["recognised text of a page"] and sorted(r["status"] for r in pages.collect()) == ["degraded", "success"]
    assert recognition.transcripts(spark, str(tmp_path), lambda data: [(0, 1.5, " hello ")]).collect()[0]["text"] == "hello"
    assert recognition.layout_spans(spark, str(tmp_path), lambda data: []).count() == 0
    assert recognition.Options.from_environment(source={"OCR_MAX_PAGES": "7", "OCR_ENABLED": "false", "OCR_DPI": "many"}) == recognition.Options(False, 20, 7, 200)
    scores = spark.createDataFrame([(0.7,), (0.69,), (None,)], "score double")
    assert [r["unsafe"] for r in recognition.safety(scores).collect()] == [True, False, False]


def _jpeg(when, lat):
    """A JPEG head with an EXIF block: time taken, and a southern latitude."""
    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    main = [entry(0x0132, 2, 20, struct.pack("<I", 200)), entry(0x8769, 4, 1, struct.pack("<I", 100)), entry(0x8825, 4, 1, struct.pack("<I", 130))]
    block = bytearray(300)
    block[0:8] = b"II*\0" + struct.pack("<I", 8)
    block[8 : 10 + 36] = struct.pack("<H", 3) + b"".join(main)
    block[100:114] = struct.pack("<H", 1) + entry(36867, 2, 20, struct.pack("<I", 220))
    block[130:156] = struct.pack("<H", 2) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", 250))
    block[200:220], block[220:240] = b"2001:02:03 04:05:06\0", when.encode() + b"\0"
    block[250:274] = struct.pack("<6I", lat[0], 1, lat[1], 1, lat[2], 1)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + bytes(block)


def test_exif_and_durations():
    data = _jpeg("2020:05:06 07:08:09", (23, 30, 36))
    assert files.exif_time(data) == "20200506 070809"
    latitude, longitude = files.gps_position(files.exif_tags(data))
    assert round(latitude, 4) == -23.51 and longitude is None
    assert files.exif_tags(data[:60]) is not None and files.exif_tags(b"none") == {}
    head = b"\0\0\0\x18ftypmp42" + b"\0\0\0\x6cmvhd" + b"\0" * 12 + struct.pack(">II", 600, 6600)
    assert files.mp4_seconds(head + b"\0" * 40) == 11.0 and files.mp4_seconds(b"ftyp") is None


def test_artefacts_are_stored_by_month(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"xx"), "2024-03-05"), ("b", bytearray(b"y"), None)], "id string, content binary, day string").withColumn("ingested_at", F.to_timestamp("day"))
    got = {r["id"]: r["logical_path"] for r in sinks.write_artefacts(rows, "id", f"{tmp_path}/blobs").collect()}
    assert got == {"a": "artefacts/2024/03/a", "b": "artefacts/0000/00/b"}
    assert bytes(sinks.read_artefact(spark, f"{tmp_path}/blobs", "id", "a").first()["content"]) == b"xx"
    sinks.write_artefacts(rows, "id", f"{tmp_path}/blobs")  # a rerun adds nothing
    assert spark.read.parquet(f"{tmp_path}/blobs").count() == 2
    assert sinks.read_artefact(spark, f"{tmp_path}/blobs", "id", "a", "artefacts/2024/03/a").count() == 1 and sinks.read_artefact(spark, f"{tmp_path}/blobs", "id", "a", "artefacts/2024/04/a").count() == 0
    sinks.without_artefact(spark, f"{tmp_path}/blobs", "id", "a", f"{tmp_path}/less")
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/less").collect()] == ["b"]


def test_small_expressions(spark):
    one = spark.range(1)
    of = lambda c: one.select(c.alias("x")).first()["x"]
    assert of(segment.box(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)))) == [1.0, 2.0, 3.0, 4.0] and of(segment.box(F.array(F.lit("1"), F.lit("x"), F.lit("3"), F.lit("4")))) is None and of(segment.box(F.array(F.lit(1)))) is None
    assert of(legal_fields.contract_gate(F.lit("CONTRATO. Cláusula 1"))) and not of(legal_fields.contract_gate(F.lit("contrato social")))
    assert of(stages.implausible_issue_date(F.lit("1949-12-31"), F.lit("document_issue_date"))) and not of(stages.implausible_issue_date(F.lit("1950-01-01"), F.lit("document_issue_date")))
    assert of(stages.daily_period(F.lit("2024-05-06T01:02"))) == "2024-05-06" and of(stages.transcription_wanted(F.lit("audio")))
    assert of(recognition.clean_text(F.lit("a\x00  b\n\n\n\nc "))) == "a b\n\nc"
    assert of(stages.provider_anchor_matches(F.lit("Dr. Rui Melo - CRM"), F.lit("Rui Melo"))) and not of(stages.provider_anchor_matches(F.lit("Ana"), F.lit("Rui Melo")))
    assert of(document_types.type_candidate(F.lit("a"), F.lit("a")))["confidence"] == 0.88 and of(document_types.type_candidate(F.lit("a"), F.lit("b")))["confidence"] == 0.78
    assert of(stages.escalation_details(F.lit("fast")))["to_mode"] == "standard" and of(stages.escalation_details(F.lit("forensic"))) is None
    assert of(recognition.reading_status(F.lit(None).cast("string"), F.lit("t")))["status"] == "skipped" and of(recognition.reading_status(F.lit("success"), F.lit(" ")))["status"] == "degraded"
    assert of(recognition.literal_confidence(F.lit("hybrid"), F.lit(True))) == 0.93
    assert of(hard_entities.stay(F.lit("internado(a) no hospital do dia 01/02/2003 ao dia 04/05/2006")))["end"] == "04/05/2006"
    assert of(F.size(page_entities.date_candidates(F.lit("01/02/2003, 1 de março de 2004, 2005-06-07T10:11")))) == 3
    text = medico_legal.explanation("{dias} dias")
    pair = spark.createDataFrame([("2024-01-01", "2024-01-11")], "a string, b string")
    sides = pair.select(F.struct(F.to_timestamp("a").alias("ts"), *[F.lit(None).cast("string").alias(c) for c in ("cid", "event_type", "document_activity")]).alias("a"), F.struct(F.to_timestamp("b").alias("ts"), *[F.lit(None).cast("string").alias(c) for c in ("cid", "event_type")]).alias("b"))
    assert sides.select(text).first()[0] == "10 dias"


def test_values(spark, tmp_path):
    df = spark.createDataFrame([(0.125, "2024-05-06T07:08:09", "Boom", "tesseract process timeout after 8 s"), (0.135, "2024-05-06 and more", "Boom", ""), (None, "2024-13-40", "Boom", None)], "x double, t string, e string, m string")
    assert [r[0] for r in df.select(values.round_half_even(F.col("x"))).collect()] == [0.12, 0.14, None]
    assert [r[0] for r in df.select(values.day_string(F.col("t"))).collect()] == ["2024-05-06", "2024-05-06", None]
    details = [r[0] for r in df.select(values.error_details(F.col("e"), F.col("m"))).collect()]
    assert details[0]["code"] == "ocr_timeout" and details[0]["cause_message"].startswith("tesseract") and details[1]["message"] == "Boom" and details[2]["code"] is None
    made = [r[0] for r in df.select(values.provenanced(F.col("x"), "s", "m", 0.9)).collect()]
    assert [m["estado"] for m in made] == ["confirmado", "confirmado", "insuficiente"]
    nested = df.select(F.struct(F.struct(F.col("t").alias("c")).alias("b")).alias("a"))
    assert nested.select(values.path(nested, "a.b.c")).first()[0] == "2024-05-06T07:08:09" and nested.select(values.path(nested, "a.x.c", F.lit("none"))).first()[0] == "none"
    assert values.inferred_offline(df, "t").first()["rules"] == ["llm_offline_missing_api_key"]
    old = sinks.upsert_buckets(spark.range(100).select(F.col("id"), F.lit("old").alias("v")), "id", f"{tmp_path}/t", 8)
    assert old.count() == 100
    now = sinks.upsert_buckets(spark.createDataFrame([(5, "new"), (500, "new")], "id long, v string"), "id", f"{tmp_path}/t", 8)
    assert now.count() == 101 and now.where("v = 'new'").count() == 2 and now.where("id = 5").count() == 1


def test_candidates_and_blocks(collection):
    docs = collection.processed().documents
    rows = {(r["document_id"], r["field"]): r for r in stages.candidates(docs, ["document_id"]).collect()}
    assert rows[("d1", "cid")]["confidence"] == 0.95 and rows[("d1", "patient")]["value"] == "ANA MARIA SOUZA" and ("d3", "patient") not in rows
    block = docs.where("document_id = 'd1'").select(stages.resolution_block("patient").alias("b")).first()["b"]
    assert block["assertion_level"] == "observed" and block["reason"] == "patient_canonical_value"
    refs = stages.evidence_refs(collection.processed().zones.withColumn("source_path", F.lit(None).cast("string")), ["document_id"]).where("document_id = 'd1'").first()["evidence_refs"]
    assert refs and {r["provenance_status"] for r in refs} == {"exact", "missing"}
    rows = stages.subdocument_rows(collection.processed().units)
    assert rows.where("document_id = 'd1'").count() >= 1 and stages.subdocument_notice(collection.processed().units).count() == 3
    assert process.flat(collection.processed().units).where("unit_ord = 1").count() == 3


def test_read_ntep(spark, tmp_path):
    (tmp_path / "ntep.csv").write_text("activity,code\nSoldador de arco,m54\nPintor,F3\n")
    assert medico_legal.read_ntep(spark, f"{tmp_path}/ntep.csv") == [("pintor", "F3"), ("soldador_de_arco", "M54")]


def test_a_picture_has_the_day_it_was_taken(spark):
    pages = spark.createDataFrame([("d1", 1, "Emitido em 01/02/2010"), ("d2", 1, "Data de nascimento: 03/04/1980\nEmitido em 01/02/2010"), ("d4", 1, "nascimento 03/04/1980")], "document_id string, page int, text string")
    facts = spark.createDataFrame(
        [("d1", "imagem", "20200102 101112", None), ("d2", "documento", None, "1980-04-03"), ("d3", "imagem", "20210102 000000", "2019-05-06"), ("d4", "documento", None, None)], "document_id string, media string, taken string, inferred_date string"
    ).selectExpr("*", "'upload' AS origin", "'u' AS artifact_uri", "1L AS width", "1L AS height", "CAST(NULL AS double) AS seconds")
    got = {r["document_id"]: r["date_canonical"] for r in Collection(pages=pages, facts=facts).processed().models.collect()}
    assert got == {"d1": "2020-01-02", "d2": "2010-02-01", "d3": "2019-05-06", "d4": None}


def test_alerts_activity_and_cases(spark):
    leave = "CARTEIRA DE TRABALHO\ncontrato de trabalho\nCargo: Digitador\nData de admissão: 01/02/2015\nPaciente: ANA MARIA SOUZA\nCID F32.1 em 05/02/2015"
    later = "ATESTADO MÉDICO\nNome paciente: ANA MARIA SOUZA\nCID M65.4, em 10/03/2024\nDr. Rui Melo Santos\nCRM 9999"
    other = "PARECER MÉDICO\nPaciente: BEATRIZ LIMA COSTA\nCID M54.5 em 20/05/2024\nDr. Rui Melo Santos\nCRM 9999"
    pages = spark.createDataFrame([("d1", 1, leave), ("d2", 1, later), ("d3", 1, other), ("d4", 1, "nada")], "document_id string, page int, text string")
    got = Collection(pages=pages, ntep=[("digitador", "M6"), ("digitador", "M5")])
    cases = {r["document_id"]: r["case_id"] for r in got.cases().collect()}
    assert cases["d1"] == cases["d2"] == "patient:ana maria souza" and cases["d3"] == "patient:beatriz lima costa" and cases["d4"] == "document:d4"
    assert [(r["document_id"], r["document_activity"].strip().lower()) for r in got.activities().collect()] == [("d1", "digitador")]
    events, links = got.causal_timeline(cases=got.cases())
    presumed = {(r["scope_id"], r["event_b"]) for r in links.where("rule_id = 'rule_presuncao_ntep'").collect()}
    ids = {r["event_id"]: r["document_id"] for r in events.collect()}
    assert {(s, ids[e]) for s, e in presumed} == {("patient:ana maria souza", "d2")}  # the other patient is another case
    whole = {ids[r["event_b"]] for r in got.causal_timeline()[1].where("rule_id = 'rule_presuncao_ntep'").collect()}
    assert whole == {"d2", "d3"}


def test_alerts_are_evaluated_in_the_case(spark):
    grant = "CARTA DE CONCESSÃO\nINSS benefício concedido\nEspécie: B31\nNB 123.456.789-0"
    sick = "ATESTADO MÉDICO\nNome paciente: ANA MARIA SOUZA\nCID F32.1"
    pages = spark.createDataFrame([("d1", 1, grant), ("d2", 1, sick)], "document_id string, page int, text string")
    got = Collection(pages=pages)
    cases = spark.createDataFrame([("d1", "c"), ("d2", "c")], "document_id string, case_id string")
    types = {r["document_id"]: r["doc_type"] for r in got.legal_fields().select("document_id", "doc_type").distinct().collect()}
    alerts = got.alerts(cases, F.to_date(F.lit("2024-06-01"))).collect()
    assert [a["alert"] for a in alerts] and all(a["case_id"] == "c" for a in alerts), types
    alone = got.case("d1").first()
    assert alone["total_alerts"] == got.alerts().where("case_id = 'd1'").count()


def test_scratch_tables_are_dropped(spark):
    from cartulary.session import kept, scratch

    with scratch(spark) as made:
        assert kept(spark.range(3), "some").count() == 3 and len(made) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(made[0])


def test_a_broken_import_within_the_package_is_told(monkeypatch):
    import __spark_entry__ as contract

    def fails(name):
        raise ModuleNotFoundError("x", name=name)

    for name, told in (("cartulary.llm", False), ("cartulary.llm.registry", False), ("public_tokenizers", False), ("cartulary.sesion", True)):
        monkeypatch.setattr(contract.importlib, "import_module", lambda _, name=name: fails(name))
        if told:
            with pytest.raises(ModuleNotFoundError):
                contract._llm()
        else:
            assert contract._llm() is None
