"""The medico-legal domain: causal cases whose links are known, seeds, events, segmentation, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from cartulary.api import Collection
from cartulary.functions import checks, dates, text
from cartulary.operators import extract, legal, medico_legal, relations, scoring
from cartulary.sources import files, signals, sinks
from cartulary.streaming import events as streams

NTEP = [("eletricista", "T20"), ("eletricista", "T21"), ("pedreiro", "S72"), ("pedreiro", "S73")]
EVENTS = "scope_id string, pos int, event_id string, event_type string, date_iso string, cid string, provider_activity string"


def links(spark, rows):
    df = spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], EVENTS).withColumn("ts", F.to_timestamp("date_iso"))
    return medico_legal.causal_links(df, NTEP).collect()


def test_electrician(spark):
    found = links(spark, [("e1", "acidente", "2024-06-15T10:30:00Z", "T20.0", "eletricista"), ("e2", "diagnostico", "2024-06-20T14:00:00Z", "T21.0", None), ("e3", "diagnostico", "2024-07-15T09:00:00Z", "M79.7", None), ("e4", "perícia", "2024-07-25T11:00:00Z", "T20.0", None)])
    assert sorted((r.event_a, r.event_b, r.rule_id) for r in found) == [
        ("e1", "e2", "rule_presuncao_ntep"), ("e1", "e3", "rule_progressao_anatomica"), ("e1", "e4", "rule_mesmo_cid_multiplos_documentos"), ("e1", "e4", "rule_pericia_confirma_anterior"),
        ("e1", "e4", "rule_presuncao_ntep"), ("e2", "e3", "rule_progressao_anatomica"),
    ]
    assert round(sum(r.confidence for r in found) / 6, 2) == 0.88 and not any(r.weakening_factors for r in found)
    assert [r.strength for r in found].count("strong") == 5 and [r.strength for r in found].count("medium") == 1


@pytest.mark.parametrize(
    "rows, factor",
    [
        ([("e1", "acidente", "2015-01-15", "T20.0", "eletricista"), ("e2", "diagnostico", "2021-06-15", "T21.0", None)], "diagnóstico_tardio"),
        ([("e1", "acidente", "2024-01-15", "T20.0", "eletricista"), ("e2", "diagnostico", "2024-02-15", "T20.1", "soldador")], "ocupações_conflitantes"),
        ([("e1", "acidente", "2020-01-15", "T20.0", "eletricista"), ("e2", "diagnostico", "2023-06-15", "T20.1", None)], "intervalo_sem_tratamento"),
        ([("e1", "acidente", "2024-06-15", "T20.0", "eletricista"), ("e2", "diagnostico", "2024-06-20", "T21.0", None)], None),
    ],
)
def test_weakening(spark, rows, factor):
    found = links(spark, rows)
    assert found and all((factor in r.weakening_factors and r.review_state == "needs_review") if factor else not r.weakening_factors for r in found)
    if factor == "intervalo_sem_tratamento":
        assert any(r.is_conflict and r.confidence == 0.0 for r in found)


def test_case_of_three_documents(spark):
    kind = "event_id string, event_type string, date_iso string, cid string, provider_activity string"
    docs = [spark.createDataFrame([r], kind).withColumn("ts", F.to_timestamp("date_iso")) for r in [("x", "perícia", "2024-07-25", "T20.0", None), ("y", "acidente", "2024-06-15", "T20.0", "eletricista"), ("z", "diagnostico", "2024-06-20", "T21.0", None), ("y", "acidente", "2024-06-15", "T20.0", "eletricista")]]
    case = medico_legal.merged_case(docs, "case")
    assert [r.event_id for r in case.orderBy("pos").collect()] == ["y", "z", "x"]
    found = medico_legal.causal_links(case, NTEP)
    assert any(r.rule_id == "rule_pericia_confirma_anterior" and r.confidence >= 0.8 for r in found.collect())
    shown = medico_legal.causal_timeline(case, found).collect()
    assert all("/" in r.display_date for r in shown) and sum(r.n_links for r in shown) == 2 * found.count()


def units(spark):
    day = lambda d, s=None, b=None, c=None: (d, d, s, b, 1, c) if d else None
    item = "struct<date_iso:string,literal:string,snippet:string,bbox:array<double>,page:int,confidence:double>"
    kind = f"document_id string, unit_id string, unit_ord int, page int, document_type string, patient string, provider string, codes array<string>, stay_start {item}, stay_end {item}, leave_start {item}, leave_end {item}, document_date {item}"
    none = (None, None, None, None)
    rows = [
        ("d1", "subdoc_001", 1, 1, "atestado_medico", "Ana Maria Souza", "João Silva", ["S72.0"], day("2024-01-02", "internado do dia", [0.0, 0.0, 1.0, 1.0]), day("2024-01-10"), None, day("2024-02-10"), day("2024-01-11")),
        ("d1", "subdoc_002", 2, 2, "parecer_medico", None, None, ["F32.1", "F41"], *none, day("2024-03-01", "emitido em")),
        ("d2", "subdoc_001", 1, 1, "receituario", None, None, None, *none, day("1980-05-05", "Data de nascimento")),
        ("d3", "subdoc_001", 1, 1, "atestado_medico", None, None, None, *none, day("2024-05-05", None, None, 0.0)),
    ]
    return spark.createDataFrame(rows, kind)


def test_seeds_and_events(spark):
    c = Collection(units=units(spark), zones=spark.createDataFrame([("d1", 1, i, f"l{i}", f"zone {i}", None, 0.9, "core_probative") for i in range(3)], "document_id string, page int, ord int, label string, snippet string, bbox array<double>, confidence double, zone string"))
    found = {(r.document_id, r.event_hint): r for r in c.seeds().collect()}
    assert set(found) == {("d1", "internacao_inicio"), ("d1", "internacao_fim"), ("d1", "afastamento_fim_estimado"), ("d1", "parecer_emitido"), ("d1", "registro_condicao_clinica"), ("d3", "document_issue_date")}
    assert found["d1", "internacao_inicio"].assertion_level == "observed" and found["d1", "afastamento_fim_estimado"].assertion_level == "inferred"
    assert found["d3", "document_issue_date"].confidence == 0.84 and found["d1", "registro_condicao_clinica"].snippet == "F32.1, F41"
    made = {(r.document_id, r.event_type): r for r in c.events().collect()}
    first = made["d1", "internacao_inicio"]
    assert first.provenance_status == "exact" and first.review_state == "auto_confirmed" and len(first.citations) == 3
    assert first.title == "Início da internação — João Silva" and "referente a Ana Maria Souza" in first.description
    assert made["d1", "afastamento_fim_estimado"].provenance_status == "estimated"
    assert [r.event_type for r in c.timeline("d1").collect()][:2] == ["internacao_inicio", "internacao_fim"]
    assert {r.document_id: r.total for r in c.timeline_summary().collect()} == {"d1": 5, "d3": 1}


def test_page_types_and_subdocuments(spark):
    rows = [("d", 1, "ATESTADO: internado por diagnóstico, CID S72"), ("d", 2, "xyz"), ("d", 3, "receituário com posologia"), ("d", 4, "laudo do exame e receituário com posologia"), ("d", 5, "paciente")]
    c = Collection(pages=spark.createDataFrame(rows, "document_id string, page int, text string"))
    assert [r.page_type for r in c.page_types().orderBy("page").collect()] == ["atestado_medico", "unknown", "receituario", "documento_composto", "documento_medico"]
    assert [(r.unit_id, r.first_place, r.n_pages, r.kind) for r in c.subdocuments().orderBy("unit_id").collect()] == [("subdoc_001", 1, 2, "ATESTADO_MEDICO"), ("subdoc_002", 3, 1, "RECEITUARIO"), ("subdoc_003", 4, 1, "DOCUMENTO_COMPOSTO"), ("subdoc_004", 5, 1, "DOCUMENTO_MEDICO")]


def test_relations_of_units(spark):
    kind = "document_id string, unit_ord int, unit_id string, patient string, provider string, document_date date, codes array<string>, has_gap boolean"
    rows = [("d", 1, "a", "Ana Souza", "João", None, ["S72"], False), ("d", 2, "b", "ANA SOUZA", "João", None, ["S72"], False), ("d", 3, "c", "Bia", None, None, None, False), ("d", 4, "e", None, None, None, None, True)]
    got = {(r["source"], r["target"], r["relation_type"]) for r in relations.unit_relations(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("a", "b", k) for k in ("same_patient", "same_provider", "same_episode", "same_document_continuation")} | {("a", "c", "conflict"), ("b", "c", "conflict")} | {(x, "e", "unknown") for x in "abc"}


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(checks.cpf_valid(F.lit("529.982.247-25"))) and not one(checks.cpf_valid(F.lit("529.982.247-24"))) and not one(checks.cpf_valid(F.lit("111.111.111-11"))) and not one(checks.cpf_valid(F.lit("12")))
    assert one(checks.cnpj_valid(F.lit("11.222.333/0001-81"))) and not one(checks.cnpj_valid(F.lit("11.222.333/0001-80")))
    assert str(one(dates.textual_day(F.lit("São Paulo, 10 de março de 2024")))) == "2024-03-10" and one(dates.textual_day(F.lit("31 de fevereiro de 2024"))) is None
    assert one(dates.iso_of_day_first(F.lit("99/99/2024"))) == "2024-99-99" and one(dates.parse_day(F.lit("99/99/2024"))) is None
    assert one(text.accent_fold(F.lit(" ÇÃo É"))) == "cao e" and one(text.identity_text(F.lit("Dr. João  da-Silva"))) == "joão da silva"
    assert one(text.trim_marks(F.lit(" - Nome:  X | "))) == "Nome: X" and one(text.cut_at(F.lit("Ana Souza CPF 1"), ["CPF"])) == "Ana Souza"
    assert str(one(extract.money(F.lit("1.234,56")))) == "1234.56"
    stay = one(extract.leave(F.lit("esteve internado(a) do dia 01/02/2024 ao dia 05/02/2024 e afastado(a) por 30 dias")))
    assert (str(stay.stay_start), str(stay.stay_end), stay.leave_days) == ("2024-02-01", "2024-02-05", 30)
    assert one(checks.person_name(F.lit("Ana Maria Souza"))) and not one(checks.person_name(F.lit("Rua 7 de Abril")))


def test_alerts_and_scores(spark):
    checks_df = spark.createDataFrame([("a", "entidades", True), ("a", "entidades", False), ("a", "eventos", True), ("b", "eventos", True)], "case_id string, axis string, ok boolean")
    cases = {r.case_id: r for r in scoring.case_scores(checks_df).collect()}
    assert cases["a"].entidades == 50.0 and cases["a"].evidencia == 0.0 and cases["a"].score == 30.0 and cases["a"].regressions == 1
    totals = scoring.roll_up(scoring.case_scores(checks_df))
    assert totals.first()["overall"] == 25.0
    assert "| a | 30.00" in sinks.markdown_report(scoring.case_scores(checks_df), totals, scoring.AXES)
    rows = spark.createDataFrame([("c1", "2024-01-01", True), ("c1", "2024-09-01", True), ("c2", "2024-01-01", False), ("c3", "2024-01-01", True)], "case_id string, day string, ca boolean").withColumn("day", F.to_timestamp("day"))
    assert {r.case_id for r in legal.gap_alert(rows, "case_id", "day", 180, ~F.col("ca"), "EPI_IRREGULAR").collect()} == {"c1", "c2"}
    fields = legal.fields(spark.createDataFrame([("d", "x", ["S72", "S73"])], "k string, a string, cids array<string>"), "k", {"A": F.col("a"), "B": F.lit(None)}, {"CID": F.col("cids")})
    assert sorted((r.field, r.ord, r.value) for r in fields.collect()) == [("A", 0, "x"), ("CID", 0, "S72"), ("CID", 1, "S73")]


def test_files(spark, tmp_path):
    import wave
    import zipfile

    (tmp_path / "a.txt").write_text("olá")
    (tmp_path / "b.txt").write_text("olá")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.heic").write_bytes(b"x")
    (tmp_path / "e.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    with wave.open(str(tmp_path / "f.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0" * 32000)
    with zipfile.ZipFile(tmp_path / "g.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>um</w:t></w:r></w:p><w:p><w:t>dois</w:t></w:p></w:document>')
    (tmp_path / "h.pdf").write_bytes(b"broken")
    status = {r.filename: r.status for r in files.ingest(spark, str(tmp_path)).collect()}
    assert status == {"a.txt": "accepted", "b.txt": "duplicate", "d.heic": "rejected: unsupported media", "e.png": "accepted", "f.wav": "accepted", "g.docx": "accepted", "h.pdf": "accepted"}
    texts = {r.path.rsplit("/", 1)[1]: r for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert texts["a.txt"].text == "olá" and texts["g.docx"].text == "um\ndois" and texts["h.pdf"].warning and texts["h.pdf"].text is None
    facts = {r.path.rsplit("/", 1)[1]: r for r in files.media_facts(spark, str(tmp_path)).collect()}
    assert (facts["e.png"].width, facts["e.png"].height) == (640, 480) and facts["f.wav"].seconds == 2.0


def test_signals_and_sinks(spark, tmp_path):
    rows = [("d1", "layout_spans_v1", json.dumps([{"page": 1, "text": "x", "bbox": [0, 0, 1, 1]}, {"page": 2}])), ("d2", "layout_spans_v1", "{broken"), ("d3", "layout_spans_v1", None)]
    good, bad = signals.decode(spark.createDataFrame(rows, "document_id string, key string, value string"), "layout_spans_v1")
    assert good.count() == 2 and [(r.document_id, r.warning) for r in bad.collect()] == [("d2", "not JSON")]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in sinks.upsert(old, new, "k", str(tmp_path / "t")).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in sinks.latest(old.union(new), "k", "v").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in sinks.merge_columns(old, spark.createDataFrame([("b", 9)], "k string, w int"), "k").collect()} == {("a", 1, None), ("b", 1, 9)}
    assert json.loads(signals.contract(spark.createDataFrame([("d", None)], "k string, layer1 string"), "k", "layer1").first()[1]) == {"k": "d", "layer1": None}
    log = sinks.processing_events(old, "k", "extract", "ocr", {"page": F.lit(3), "note": F.lit(None).cast("string"), "n": F.col("v")}).first()
    assert log.page == 3 and json.loads(log.details) == {"n": 1}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 2.0, 7), (1, "2024-01-01 00:10:00", "a", 2.0, 7), (2, "2024-01-01 01:20:00", "a", 3.0, 7), (3, "2024-01-02 05:00:00", "b", 4.0, 8)], "event_id long, ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return [tuple(r) for r in spark.table(name).collect()]

    assert len(run(streams.once(read(), "event_id", "ts"), "once", "append")) == 3
    windows = run(streams.tumbling(read(), "ts", ["event_type"]).select(F.date_format("window.start", "dd HH"), "event_type", "n", "total"), "tumbling", "append")
    assert ("01 00", "a", 2, 4.0) in windows and ("01 01", "a", 1, 3.0) in windows
    assert {(r[0], r[1]) for r in run(streams.growing_timelines(read().select("user_id", "event_id", "ts"), "user_id"), "growing", "update")} == {(7, 2), (8, 1)}


def test_case_view_and_dossier(spark):
    from cartulary.operators import canonical, readmodel

    c = Collection(units=units(spark))
    events = c.events()
    docs = spark.createDataFrame([("d1", "documento", "atestado_medico", "Ana", None, "2024-01-11", ["S72.0"], "x"), ("d9", "imagem", None, None, None, None, None, None)], "document_id string, media string, doc_type string, patient string, provider string, date_canonical string, codes array<string>, text string")
    items = canonical.review_items(events, spark.createDataFrame([], "document_id string, role string, name string, review_state string"), spark.createDataFrame([("d9", "ocr", "slow")], "document_id string, code string, message string"))
    view = {r.document_id: r for r in readmodel.case_view(canonical.read_model(docs, events, items), events, items).collect()}
    assert [t.event_type for t in view["d1"].timeline][0] == "internacao_inicio" and view["d1"].n_exact == 1 and view["d1"].n_waiting == 4
    assert view["d9"].timeline is None and view["d9"].n_waiting == 1
    lines = readmodel.dossier(events.where("document_id = 'd1'"), 2).orderBy("line_no").collect()
    assert [r.page_no for r in lines] == [1, 1, 2, 2, 3] and lines[0].line.startswith("2024-01-02 | internacao_inicio") and all(len(r.line) <= 120 for r in lines)
    rows = {r.label: r for r in readmodel.panel_row(events.where("document_id = 'd1'")).collect()}
    assert rows["internacao_inicio"].display_date == "02/01/2024 00:00" and rows["internacao_inicio"].bbox and rows["parecer_emitido"].tags == ["cid:F32.1", "cid:F41"]
