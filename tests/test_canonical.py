"""Resolution of people, dates and codes; read models; the seven alerts."""

import datetime

from pyspark.sql import functions as F

from cartulary.operators import canonical, legal

BOX = [0.0, 0.0, 1.0, 1.0]


def test_people(spark):
    kind = "document_id string, page int, page_type string, role string, name string, confidence double, bbox array<double>, snippet string, crm string"
    rows = [
        ("d", 1, "atestado_medico", "patient", "Ana Maria Souza CPF 123", 0.9, None, None, None), ("d", 2, "formulario_administrativo", "patient", "Bia Lima Costa", 0.98, None, None, None),
        ("d", 1, "atestado_medico", "mother", "ANA MARIA SOUZA", 0.99, BOX, None, None), ("d", 2, "x", "mother", "Clara Souza", 0.7, None, None, None),
        ("d", 1, "atestado_medico", "provider", "Hospital São Paulo", 0.99, BOX, None, None), ("d", 1, "atestado_medico", "provider", "Dr. João Silva", 0.8, BOX, "Dr. João", "CRM 1"), ("d", 1, "x", "provider", "Dr. Ivo Reis", 0.85, None, None, None),
        ("e", 1, "x", "patient", "Ana Souza", 0.0, BOX, None, None), ("f", 1, "x", "patient", "Ana Souza", 0.9, None, None, None), ("g", 1, "x", "patient", None, None, None, None, None),
    ]
    got = {(r.document_id, r.role): r for r in canonical.people(spark.createDataFrame(rows, kind), ["document_id"]).collect()}
    assert {k: r.name for k, r in got.items()} == {("d", "patient"): "Ana Maria Souza", ("d", "mother"): "Clara Souza", ("d", "provider"): "Dr. João Silva", ("e", "patient"): "Ana Souza"}
    assert got["e", "patient"].confidence == 0.7 and got["d", "provider"].review_state == "review_recommended" and got["d", "patient"].provenance_status == "text_fallback"


def test_document_dates(spark):
    kind = "document_id string, page int, page_type string, page_text string, ord int, literal string, date_iso string, bbox array<double>, snippet string"
    text = "Data de nascimento: 05/05/1980\nEmissão em 10/10/2024\noutra 11/11/2024"
    rows = [("d", 1, "laudo_medico", text, 0, "05/05/1980", "1980-05-05", BOX, None), ("d", 1, "laudo_medico", text, 1, "11/11/2024", "2024-11-11", None, None), ("d", 1, "laudo_medico", text, 2, "10/10/2024", "2024-10-10", None, None), ("e", 2, "x", "só 01/01/2024", 0, "01/01/2024", "2024-01-01", BOX, None), ("e", 1, "x", "data: 02/01/2024", 0, "02/01/2024", "2024-01-02", None, None), ("g", 1, "x", None, 0, None, None, None, None)]
    got = {r.document_id: (r.date_iso, r.confidence, r.review_state) for r in canonical.document_dates(spark.createDataFrame(rows, kind), ["document_id"]).collect()}
    assert got == {"d": ("2024-10-10", 1.2, "review_recommended"), "e": ("2024-01-01", 0.97, "auto_confirmed")}


def test_order_of_date_sources(spark):
    rows = [("1980-05-05", None, None, "2024-01-01", None, None), (None, "1980-05-05", "2023-01-01", "2024-01-01", None, None), (None, None, None, "1980-05-05", "2022-02-02", "x"), (None, None, None, None, None, "2021-01-01"), ("2020-01-01", "1980-05-05", None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    birth = lambda c: F.coalesce(c == "1980-05-05", F.lit(False))
    assert [r[0] for r in df.select(canonical.canonical_date(*[F.col(x) for x in "abcdef"], birth)).collect()] == ["2024-01-01", None, "2022-02-02", "2021-01-01", "2020-01-01"]


def test_codes_places_and_read_models(spark):
    found = [("d", 1, 0, 0, "S72.0", None, "x"), ("d", 1, 0, 1, "S72.0", BOX, "x"), ("d", 1, 0, 2, "S30", None, "Sao Paulo"), ("d", 2, 4, 0, "F32", None, "x"), ("d", 2, 4, 1, "F3", None, "x")]
    got = canonical.codes(spark.createDataFrame(found, "document_id string, page int, page_rank int, ord int, code string, bbox array<double>, page_text string"), ["document_id"])
    assert [(r.code, r.score) for r in got.collect()] == [("S72.0", 0.9), ("F32", 0.58)]
    pages = spark.createDataFrame([("d", 1, "X", None), ("d", 3, "Curitiba", "PR"), ("d", 2, "Recife", "PE")], "document_id string, page int, city string, uf string")
    assert [tuple(r) for r in canonical.place(pages, ["document_id"]).collect()] == [("d", "Recife, PE")]
    docs = spark.createDataFrame([("document-1", "documento", "laudo_medico", "Ana", None, "2024-01-02", ["S72", "F32", "M17", "M19"], "corpo"), ("document-2", "imagem", None, None, None, None, None, None)], "document_id string, media string, doc_type string, patient string, provider string, date_canonical string, codes array<string>, text string")
    citation = "citations array<struct<bbox:array<double>>>"
    events = spark.createDataFrame([("document-1", "alta", "2024-01-02", "inferred", [(None,)]), ("document-1", "exame", "2024-01-02", "exact", [(BOX,)])], f"document_id string, event_type string, date_iso string, provenance_status string, {citation}")
    who = spark.createDataFrame([("document-1", "patient", "Ana", "needs_review"), ("document-1", "patient", "Ana", "needs_review")], "document_id string, role string, name string, review_state string")
    items = canonical.review_items(events, who, spark.createDataFrame([("document-2", "ocr", "slow")], "document_id string, code string, message string"))
    assert sorted((r.document_id, r.source, r.field) for r in items.collect()) == [("document-1", "event", "alta"), ("document-1", "person", "patient"), ("document-2", "warning", "ocr")]
    models = {r.document_id: r for r in canonical.read_model(docs, events, items).collect()}
    one, two = models["document-1"], models["document-2"]
    assert one.title == "laudo medico - Ana" and one.summary == "laudo medico; Paciente: Ana; Data: 2024-01-02; S72, F32, M17" and one.tags == ["laudo_medico", "cid:S72", "cid:F32", "cid:M17", "cid:M19"]
    assert one.event_types == ["alta", "exame"] and one.period_label == "2024-01" and "corpo" in one.search_text and (one.n_events, one.n_review_items) == (2, 2)
    assert two.title == "imagem document" and two.summary == "Documento sem síntese." and two.tags == []


def test_seven_alerts(spark):
    kind = "case_id string, doc_type string, fields map<string,string>, cids array<string>"
    rows = [
        ("1", "TRAB_TRCT", {"Data_Demissao": "01/01/2020"}, []), ("1", "PREV_CARTA_CONCESSAO", {"Especie_Beneficio": "b92"}, []), ("1", "PREV_CARTA_CONCESSAO", {"Especie_Beneficio": "B92"}, []),
        ("2", "PREV_LAUDO_SABI", {"DCB": "2024-01-10"}, []), ("2", "SST_ASO_RETORNO", {"Data_ASO": "11/01/2024", "Resultado_ASO": "Inapto"}, []), ("2", "SST_ASO_RETORNO", {"Data_ASO": "09/01/2024", "Resultado_ASO": "inapto"}, []),
        ("3", "TRAB_CTPS", {"Data_Admissao": "2020-01-01"}, []), ("3", "MED_EXAME_IMAGEM", {"Data_Documento": "2019-01-01", "Conclusao_Exame": "Degenerativo"}, []), ("3", "MED_EXAME_IMAGEM", {"Data_Documento": "2021-01-01", "Conclusao_Exame": "lesão grave"}, []),
        ("4", "MED_ATESTADO", {}, ["M54", "H90.3"]), ("5", "MED_AUDIOMETRIA", {}, ["H90"]), ("5", "SST_FICHA_EPI", {"Data_Entrega_EPI": "2024-01-01", "Numero_CA_EPI": "1"}, []), ("5", "SST_FICHA_EPI", {"Data_Entrega_EPI": "2024-02-01", "Numero_CA_EPI": "1"}, []),
        ("6", "PREV_CARTA_CONCESSAO", {"Especie_Beneficio": "B31"}, []), ("6", "MED_ATESTADO", {}, ["F41.1"]), ("6", "SST_PCMSO", {"Texto": "riscos físicos"}, []),
        ("7", "PREV_CNIS", {}, []), ("7", "PREV_CARTA_CONCESSAO", {"Especie_Beneficio": "LOAS"}, []), ("7", "MED_PRONTUARIO_CLINICO", {"Texto": "Exposição a sílica"}, []),
        ("8", "PREV_CAT", {}, []), ("8", "PROVA_BOLETIM_OCORRENCIA", {"Relato": "acidente de TRAJETO"}, []), ("8", "PROVA_BOLETIM_OCORRENCIA", {"Relato": "trajeto"}, []),
        ("9", "PREV_CARTA_CONCESSAO", {"Especie_Beneficio": "B31"}, []), ("9", "MED_ATESTADO", {}, ["F41"]), ("9", "SST_PCMSO", {"Texto": "risco psicossocial"}, []),
    ]
    got = sorted((r.case_id, legal.ALERTS.index(r.alert)) for r in legal.case_alerts(spark.createDataFrame(rows, kind), F.lit(datetime.date(2024, 6, 1))).collect())
    assert got == [("1", 0), ("1", 0), ("2", 1), ("3", 2), ("4", 3), ("6", 4), ("7", 5), ("8", 6)]
