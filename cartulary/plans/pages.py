"""Queries on pages and papers: entities, names and anchors of rendered pages, types of documents, fields of legal papers.

Rendered pages are made of columns of the star schema, so what an extractor must find is known: oracles compute it from
the columns and not by patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..operators import document_types, hard_entities, legal_fields, page_entities, segment
from ..session import dealt
from ..sources import recognition
from .registry import query, table

_FIRST = ["ANA MARIA", "BEATRIZ ELENA", "CARLA SOFIA", "DIANA LUIZA", "ELISA REGINA", "FABIANA TERESA", "GLORIA ISABEL"]
_LAST = ["SOUZA", "LIMA PEREIRA", "COSTA", "ALMEIDA", "ROCHA NETO"]
_CODES = ["F32.1", "M54", "T20.0", "S72", "H90.3", "J45.0"]


def _pick(values, k, shift=0):
    return F.get(F.array(*[F.lit(v) for v in values]), (k + shift) % len(values))


def _pick_sql(values, k, shift=0):
    return f"([{', '.join(repr(v) for v in values)}])[1 + ({k} + {shift}) % {len(values)}]"


def _name(k):
    return F.concat_ws(" ", _pick(_FIRST, k), _pick(_LAST, k))


def _name_sql(k):
    return f"{_pick_sql(_FIRST, k)} || ' ' || {_pick_sql(_LAST, k)}"


def _pages(spark, sf):
    """A sick note a customer: labels, numbers with right check digits, codes, dates and medicines."""
    k = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1500).cast("int")), "dd/MM/yyyy")
    born = F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (k % 15000).cast("int")), "dd/MM/yyyy")
    cpf = checks.with_check_digits(F.lpad(((k + 1) * 7919 % 999999937).cast("string"), 9, "0"), checks.CPF_WEIGHTS)
    shown = F.concat(F.substring(cpf, 1, 3), F.lit("."), F.substring(cpf, 4, 3), F.lit("."), F.substring(cpf, 7, 3), F.lit("-"), F.substring(cpf, 10, 2))
    text = F.concat(
        F.lit("ATESTADO MEDICO\nNome paciente: "), _name(k), F.lit(" Nascimento: "), born, F.lit("\nNome da mãe: "), _name(k + 3), F.lit("\nSexo: Feminino\nIdade: "), (k % 90 + 1).cast("string"), F.lit("\nRGHC: HC"), (k + 100000).cast("string"),
        F.lit("\nCPF "), shown, F.lit(" e CPF 111.111.111-11\nPrestador: "), _name(k + 5), F.lit("\nServiço: atendimento geral\nEspecialidade: Ortopedia\nCRM-SP: "), (k + 10000).cast("string"),
        F.lit("\nCID "), _pick(_CODES, k), F.lit(" e CID "), _pick(_CODES, k, 1), F.lit(", diagnosticado em "), day, F.lit("\n1) Dipirona 500 mg\n2) Losartana 50 mg\nData/Hora atendimento: "), day, F.lit(" 10:30\nTelefone (11) 98765-4321\nCEP 01234-567\n"),
    )
    customers = dealt(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return customers.select(k.alias("document_id"), F.lit(1).alias("page"), text.alias("text"), cpf.alias("cpf"), day.alias("day"))


_DAY = "strftime(DATE '2020-01-01' + CAST(c_custkey % 1500 AS INT), '%d/%m/%Y')"
_BORN = "strftime(DATE '1950-01-01' + CAST(c_custkey % 15000 AS INT), '%d/%m/%Y')"


@query(f"""SELECT c_custkey AS document_id, {_name_sql('c_custkey')} AS patient_name, {_name_sql('(c_custkey + 3)')} AS mother_name, {_BORN} AS birth_date, 'Feminino' AS sex, CAST(c_custkey % 90 + 1 AS VARCHAR) AS age, 'HC' || (c_custkey + 100000) AS rghc,
          CAST(c_custkey + 10000 AS VARCHAR) AS crm, '(11) 98765-4321' AS phones, '01234-567' AS cep, 1 AS n_cpf, {_BORN} || ',' || {_DAY} AS dates FROM customer""")
def page_basic_entities(spark, sf):
    e = page_entities.basic_entities(F.col("text"))
    rows = _pages(spark, sf).select("document_id", e.alias("e"))
    joined = lambda c: F.array_join(f"e.{c}", ",").alias(c)
    return rows.select("document_id", "e.patient_name", "e.mother_name", "e.birth_date", "e.sex", "e.age", "e.rghc", joined("crm"), joined("phones"), "e.cep", F.size("e.cpf").alias("n_cpf"), joined("dates"))


@query(f"""SELECT c_custkey AS document_id, {_pick_sql(_CODES, 'c_custkey')} || ',' || {_pick_sql(_CODES, 'c_custkey', 1)} AS cids, 'Dipirona:500 mg,Losartana:50 mg' AS medications, {_name_sql('(c_custkey + 5)')} AS provider_name,
          'Ortopedia' AS specialty, 'atendimento geral' AS service, {_DAY} || ' 10:30' AS attendance FROM customer""")
def page_clinical_entities(spark, sf):
    rows = _pages(spark, sf).select("document_id", page_entities.clinical_entities(F.col("text")).alias("e"))
    medicines = F.array_join(F.transform("e.medications", lambda m: F.concat_ws(":", m["name"], m["dose"])), ",")
    return rows.select("document_id", F.array_join("e.cids", ",").alias("cids"), medicines.alias("medications"), "e.provider_name", "e.specialty", "e.service", F.concat_ws(" ", "e.attendance.date", "e.attendance.time").alias("attendance"))


@query(f"""SELECT c_custkey AS document_id, role, name FROM customer, (SELECT unnest(['patient', 'mother', 'provider']) AS role), LATERAL (SELECT CASE role WHEN 'patient' THEN {_name_sql('c_custkey')} WHEN 'mother' THEN {_name_sql('(c_custkey + 3)')}
          ELSE {_name_sql('(c_custkey + 5)')} END AS name)""")
def page_people_roles(spark, sf):
    """The names of three roles by scores of candidates; every page names each under its label."""
    return page_entities.page_people(_pages(spark, sf), ["document_id", "page"]).select("document_id", "role", "name")


@query(f"""SELECT c_custkey AS document_id, count(*) AS n_anchors, count(DISTINCT label) AS n_labels, count(*) FILTER (zone = 'core_probative') AS n_core FROM (
  SELECT c_custkey, unnest(['patient', 'mother', 'provider', 'service', 'specialty', 'crm', 'cid', 'cid', 'date', 'date']) AS label FROM customer) t,
  LATERAL (SELECT CASE WHEN label = 'date' THEN 'institutional_context' ELSE 'core_probative' END AS zone) GROUP BY c_custkey""")
def page_anchor_zones(spark, sf):
    _, zones = page_entities.analyse(_pages(spark, sf).select("document_id", "page", "text"), ["document_id", "page"])
    return zones.groupBy("document_id").agg(F.count("*").alias("n_anchors"), F.count_distinct("label").alias("n_labels"), F.count_if(F.col("zone") == "core_probative").alias("n_core"))


@query(f"""SELECT c_custkey AS document_id, type, count(*) AS n FROM (SELECT c_custkey, unnest(['cpf', 'crm', 'cid', 'cid', 'patient_name', 'mother_name', 'provider_name']) AS type FROM customer) GROUP BY ALL""")
def hard_entity_counts(spark, sf):
    """Checked numbers, codes in context and people of rendered pages, each once."""
    pages = _pages(spark, sf).select("document_id", "page", "text")
    evidence, zones = page_entities.analyse(pages, ["document_id", "page"])
    found = hard_entities.hard_entities(pages.select("document_id", "text"), evidence, zones.withColumnRenamed("ord", "anchor_ord"))
    return found.where("type NOT IN ('date', 'duration_days')").groupBy("document_id", "type").agg(F.count("*").alias("n"))


@query(f"""SELECT c_custkey AS document_id, role, value_iso FROM (SELECT c_custkey, 'birth_date' AS role, strftime(DATE '1950-01-01' + CAST(c_custkey % 15000 AS INT), '%Y-%m-%d') AS value_iso FROM customer
          UNION SELECT c_custkey, 'attendance_date', strftime(DATE '2020-01-01' + CAST(c_custkey % 1500 AS INT), '%Y-%m-%d') FROM customer)""")
def hard_entity_dates(spark, sf):
    pages = _pages(spark, sf).select("document_id", "page", "text")
    evidence, zones = page_entities.analyse(pages, ["document_id", "page"])
    found = hard_entities.hard_entities(pages.select("document_id", "text"), evidence.withColumn("dates", F.slice("dates", 1, 0)), zones.withColumnRenamed("ord", "anchor_ord"))
    return found.where("type = 'date'").select("document_id", "role", "value_iso")


@query(f"""SELECT c_custkey AS document_id, CASE c_custkey % 3 WHEN 0 THEN {_pick_sql(_CODES, 'c_custkey')} WHEN 1 THEN '' ELSE {_pick_sql(_CODES, 'c_custkey')} END AS codes FROM customer""")
def code_context(spark, sf):
    """Codes with a good term beside them, in an address, and in a bare line."""
    k = F.col("c_custkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("diagnostico "), _pick(_CODES, k))).when(k % 3 == 1, F.concat(F.lit("rua Alfa, sala "), _pick(_CODES, k))).otherwise(F.concat(F.lit("consta "), _pick(_CODES, k)))
    text = F.concat(F.repeat(F.lit("x"), F.lit(200)), F.lit("\n"), line, F.lit("\n"), F.repeat(F.lit("y"), F.lit(200)))
    return table(spark, sf, "customer").select(k.alias("document_id"), F.array_join(hard_entities.codes_in_context(text), ",").alias("codes"))


# --- types -----------------------------------------------------------------------------------------------------------


def _first_best_sql(sets: dict[str, list[str]], low: str, otherwise: str) -> str:
    """Label and score by SQL: the first of the highest sums of contained words."""
    scores = {k: " + ".join(f"CASE WHEN contains({low}, '{w}') THEN 1 ELSE 0 END" for w in words) for k, words in sets.items()}
    listed = ", ".join(f"{{'s': {s}, 'o': {-i}, 'label': '{k}'}}" for i, (k, s) in enumerate(scores.items()))
    return f"SELECT doc_id, CASE WHEN top.s > 0 THEN top.label ELSE '{otherwise}' END AS label, top.s AS s FROM (SELECT doc_id, list_aggregate([{listed}], 'max') AS top FROM typed)"


def _worded(spark, sf, sets):
    """Whole documents, each behind some words of one of the sets, all in lower case."""
    words = [", ".join(w[: 1 + i % len(w)]) for i, w in enumerate(sets.values())]
    return table(spark, sf, "documents").select("doc_id", F.concat(_pick(words, F.col("doc_id")), F.lit("\n"), F.col("text")).alias("text"))


def _worded_sql(sets):
    words = [", ".join(w[: 1 + i % len(w)]) for i, w in enumerate(sets.values())]
    return f"WITH typed AS (SELECT doc_id, lower({_pick_sql(words, 'doc_id')} || chr(10) || text) AS low FROM documents)"


@query(_worded_sql(document_types.LEGAL_TYPES) + f" SELECT doc_id, label AS doc_type, CASE WHEN s = 0 THEN 0.10 ELSE least(0.50 + 0.10 * s, 0.97) END :: DOUBLE AS confidence FROM ({_first_best_sql(document_types.LEGAL_TYPES, 'low', 'UNKNOWN')})")
def legal_doc_type(spark, sf):
    rows = _worded(spark, sf, document_types.LEGAL_TYPES).select("doc_id", document_types.legal_type(F.col("text")).alias("t"))
    return rows.select("doc_id", F.col("t.value").alias("doc_type"), F.round("t.confidence", 2).alias("confidence"))


@query(_worded_sql(document_types.PAGE_HEADERS) + f" SELECT doc_id, CASE WHEN label <> 'UNKNOWN' THEN label WHEN contains(low, 'hospital') OR contains(low, 'crm') OR contains(low, 'paciente') THEN 'MED_PRONTUARIO_CLINICO' ELSE 'UNKNOWN' END AS doc_type FROM ({_first_best_sql(document_types.PAGE_HEADERS, 'low', 'UNKNOWN')}) JOIN typed USING (doc_id)")
def page_header_type(spark, sf):
    return _worded(spark, sf, document_types.PAGE_HEADERS).select("doc_id", document_types.header_type(F.col("text")).alias("doc_type"))


_KINDS = ["cnis", "x", "audiometria", "x", "x", "ata notarial"]


@query(f"""WITH p AS (SELECT o_custkey, o_orderkey, {_pick_sql(['PREV', 'U', 'AUD', 'U', 'U', 'ATA'], 'o_orderkey')} AS t FROM orders),
 c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, last_value(nullif(t, 'U') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
 SELECT o_custkey, 1 + count(*) FILTER (rn > 1 AND t <> 'U' AND t <> coalesce(before, 'U')) AS n_subdocs FROM c GROUP BY o_custkey""")
def header_subdocs(spark, sf):
    """Orders of a customer as pages: runs of one header type, unknown pages joining the run before them."""
    words = ["carta de concessao", "x", "audiometria", "x", "x", "ata notarial"]
    pages = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("page"), _pick(words, F.col("o_orderkey")).alias("text"))
    return document_types.header_subdocuments(pages, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n_subdocs"))


def _has(low, words):
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


@query(f"""SELECT doc_id, text <> '' AS has_text, {_has('lower(text)', document_types.DATE_WORDS)} AS has_dates, {_has('lower(text)', document_types.CURRENCY_WORDS)} AS has_currency, {_has('lower(text)', document_types.IDENTIFIER_WORDS)} AS has_identifiers,
          CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' END AS file_extension FROM documents""")
def document_signals(spark, sf):
    uri = F.when(F.col("doc_id") % 3 == 0, "files/a.b/x.PDF").when(F.col("doc_id") % 3 == 1, "x.png").otherwise("x")
    rows = table(spark, sf, "documents").select("doc_id", document_types.signals(F.col("text"), uri, F.lit("documento")).alias("s"))
    return rows.select("doc_id", "s.has_text", "s.has_dates", "s.has_currency", "s.has_identifiers", "s.file_extension")


_PAPERS = {"a": ["DANFE", "nota fiscal"], "b": ["ATESTADO", "CID"], "c": ["recibo de pagamento"], "d": ["PARECER", "CRM"], "e": ["Receituário"], "f": ["x"], "g": ["identidade"], "h": ["LAUDO de exame"]}
_LOW = "lower(t)"
_GENERIC = f"""CASE WHEN {_has(_LOW, document_types.INVOICE[0])} THEN {{'l': 'nota_fiscal', 'c': 0.90}}
  WHEN {_has(_LOW, document_types.IDENTITY[0])} THEN {{'l': 'identidade', 'c': 0.88}} WHEN {_has(_LOW, document_types.RECEIPT[0])} THEN {{'l': 'recibo', 'c': 0.82}}
  WHEN {_has(_LOW, document_types.INVOICE[1])} AND {_has(_LOW, document_types.CURRENCY_WORDS)} THEN {{'l': 'nota_fiscal', 'c': 0.80}}
  WHEN {_has(_LOW, document_types.IDENTITY[1])} THEN {{'l': 'identidade', 'c': 0.78}} END"""
_PAPER_WORDS = [" ".join(w) for w in _PAPERS.values()]


@query(f"""WITH p AS (SELECT doc_id, {_pick_sql(_PAPER_WORDS, 'doc_id')} || ' ' || text AS t FROM documents), g AS (SELECT doc_id, t, {_GENERIC} AS g FROM p)
 SELECT doc_id, CASE WHEN contains(upper(t), 'ATESTADO') AND (contains(upper(t), 'CID') OR contains(upper(t), 'CRM')) THEN 'atestado_medico' WHEN contains(upper(t), 'PARECER') AND contains(upper(t), 'CRM') THEN 'parecer_medico'
   WHEN contains(upper(t), 'RECEITU') AND contains(upper(t), 'CRM') THEN 'receituario' WHEN contains(upper(t), 'LAUDO') AND (contains(upper(t), 'CRM') OR contains(upper(t), 'EXAME')) THEN 'laudo_medico'
   WHEN g IS NOT NULL THEN g.l WHEN contains(upper(t), 'RECEITU') THEN 'receituario' WHEN contains(upper(t), 'RECIBO') THEN 'recibo' END AS document_type FROM g""")
def inferred_document_type(spark, sf):
    text = F.concat_ws(" ", _pick(_PAPER_WORDS, F.col("doc_id")), "text")
    return table(spark, sf, "documents").select("doc_id", document_types.inferred_type(text, F.lit(None).cast("string"))["value"].alias("document_type"))


@query(f"""WITH p AS (SELECT doc_id, {_pick_sql(_PAPER_WORDS, 'doc_id')} || ' ' || text AS t FROM documents)
 SELECT doc_id, CASE WHEN contains(upper(t), 'ATESTADO') AND (contains(upper(t), 'CID') OR contains(upper(t), 'CRM')) THEN 'atestado_medico' WHEN contains(upper(t), 'PARECER') AND contains(upper(t), 'CRM') THEN 'parecer_medico' WHEN contains(upper(t), 'RECEITU') THEN 'receituario'
   WHEN doc_id % 5 = 1 THEN 'recibo' WHEN doc_id % 3 = 0 THEN 'laudo_medico' ELSE 'documento_composto' END AS document_type,
   CASE WHEN contains(lower(t), 'danfe') OR contains(lower(t), 'nota fiscal') THEN 'nota_fiscal' END AS invoice FROM p""")
def canonical_document_type(spark, sf):
    text = F.concat_ws(" ", _pick(_PAPER_WORDS, F.col("doc_id")), "text")
    inferred = F.when(F.col("doc_id") % 5 == 1, "recibo").when(F.col("doc_id") % 5 == 2, "identidade")
    best = F.when(F.col("doc_id") % 3 == 0, "laudo_medico")
    return table(spark, sf, "documents").select("doc_id", document_types.canonical_type(text, inferred, best).alias("document_type"), document_types.invoice_label(text)["value"].alias("invoice"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pagina_receituario' WHEN 1 THEN 'pagina_laudo' WHEN 2 THEN 'pagina_parecer' ELSE 'pagina_documental' END AS label, CASE doc_id % 4 WHEN 0 THEN 0.90 WHEN 1 THEN 0.80 WHEN 2 THEN 0.82 ELSE 0.65 END :: DOUBLE AS confidence
          FROM documents WHERE NOT regexp_matches(upper(text), 'RECEITU|ATESTADO|LAUDO|PARECER|PRONTUARIO|RELATORIO')""")
def page_label_by_snippets(spark, sf):
    k = F.col("doc_id")
    core = F.when(k % 4 == 0, "um receituário, com laudo: RECEITUARIO").when(k % 4 == 3, "nada")
    anchors = F.when(k % 4 == 1, "Laudo de exame").otherwise("Atestado")
    text = F.when(k % 4 == 2, F.concat(F.lit("parecer "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").where(~F.upper("text").rlike("RECEITU|ATESTADO|LAUDO|PARECER|PRONTUARIO|RELATORIO"))
    found = rows.select("doc_id", document_types.page_label(core, F.when(k % 4 != 2, anchors), text).alias("l"))
    return found.select("doc_id", F.col("l.value").alias("label"), "l.confidence")


# --- legal -----------------------------------------------------------------------------------------------------------

_TYPES = ["TRAB_TRCT", "PREV_CARTA_CONCESSAO", "MED_ATESTADO", "SST_ASO_RETORNO", "DOC_PESSOAL_RG", "PREV_CARTA_INDEFERIMENTO"]


def _papers(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    texts = [
        F.concat(F.lit("TERMO DE RESCISÃO\nCargo: Soldador\nData de admissão: "), day, F.lit("\nData de demissão: 01/02/2003\nRemuneração: R$ 1.234,56")),
        F.concat(F.lit("CARTA DE CONCESSÃO NB: 123.456.789-0 espécie B92\nDIB: "), day, F.lit(" DCB: 31/12/2010 CID M54.5")),
        F.concat(F.lit("Atesto 15 dias de afastamento. CRM-SP 123456, CID F32.1. Visto em 01/01/2001 e em "), day),
        F.concat(F.lit("ASO de retorno ao trabalho. Data do ASO: "), day, F.lit(" Resultado: INAPTO. Exposto a ruído. CA: 12345")),
        F.concat(F.lit("Nome completo: MARIA DA SILVA Nascimento "), day, F.lit(" RG: 12.345.678-9 CPF 123.456.789-09\nRua Alfa, 12 CEP 01234-567")),
        F.lit("INDEFERIMENTO do pedido NB 1234567890"),
    ]
    text = texts[-1]
    for i, t in enumerate(texts[:-1]):
        text = F.when(k % 6 == i, t).otherwise(text)
    return table(spark, sf, "orders").select(k.alias("document_id"), _pick(_TYPES, k).alias("doc_type"), text.alias("text"))


_ODAY = "strftime(o_orderdate, '%d/%m/%Y')"


@query(f"""SELECT o_orderkey AS document_id, f.field, f.value FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 6
   WHEN 0 THEN [{{'field': 'Cargo', 'value': 'Soldador' || chr(10) || 'Data de admissão'}}, {{'field': 'Data_Admissao', 'value': {_ODAY}}}, {{'field': 'Data_Demissao', 'value': '01/02/2003'}}, {{'field': 'Ultima_Remuneracao', 'value': '1.234,56'}}]
   WHEN 1 THEN [{{'field': 'Numero_Beneficio', 'value': '123.456.789-0'}}, {{'field': 'Especie_Beneficio', 'value': 'B92'}}, {{'field': 'DIB', 'value': {_ODAY}}}, {{'field': 'DCB', 'value': '31/12/2010'}}, {{'field': 'CID_INSS', 'value': 'B92'}}]
   WHEN 2 THEN [{{'field': 'Data_Documento', 'value': {_ODAY}}}, {{'field': 'CRM_Medico', 'value': '123456'}}, {{'field': 'CID_Atestado', 'value': 'F32.1'}}, {{'field': 'Dias_Afastamento', 'value': '15'}}]
   WHEN 3 THEN [{{'field': 'Data_ASO', 'value': {_ODAY}}}, {{'field': 'Resultado_ASO', 'value': 'INAPTO'}}, {{'field': 'Agente_Nocivo', 'value': 'ruído'}}, {{'field': 'Numero_CA_EPI', 'value': '12345'}}, {{'field': 'Data_Entrega_EPI', 'value': {_ODAY}}}]
   WHEN 4 THEN [{{'field': 'Nome_Completo', 'value': 'MARIA DA SILVA'}}, {{'field': 'Data_Nascimento', 'value': {_ODAY}}}, {{'field': 'Numero_RG', 'value': '12.345.678-9'}}, {{'field': 'Numero_CPF', 'value': '123.456.789-09'}}, {{'field': 'CEP', 'value': '01234-567'}}, {{'field': 'Endereco_Completo', 'value': 'Rua Alfa, 12 CEP 01234-567'}}]
   ELSE [{{'field': 'Numero_Beneficio', 'value': '1234567890'}}, {{'field': 'Motivo_Indeferimento', 'value': 'motivo não estruturado'}}] END) AS f FROM orders)""")
def legal_text_fields(spark, sf):
    return legal_fields.text_fields(_papers(spark, sf)).select("document_id", "field", "value")


@query("""SELECT o_orderkey AS document_id, f.t AS fact_type, f.d AS date FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 6
   WHEN 0 THEN [{'t': 'data_admissao', 'd': CAST(o_orderdate AS DATE)}, {'t': 'data_demissao', 'd': DATE '2003-02-01'}] WHEN 1 THEN [{'t': 'dib_beneficio', 'd': CAST(o_orderdate AS DATE)}, {'t': 'dcb_beneficio', 'd': DATE '2010-12-31'}]
   WHEN 2 THEN [{'t': 'data_documento_medico', 'd': CAST(o_orderdate AS DATE)}] WHEN 3 THEN [{'t': 'data_aso', 'd': CAST(o_orderdate AS DATE)}, {'t': 'data_entrega_epi', 'd': CAST(o_orderdate AS DATE)}]
   WHEN 4 THEN [{'t': 'data_nascimento', 'd': CAST(o_orderdate AS DATE)}] ELSE [] END) AS f FROM orders)""")
def legal_facts_of_texts(spark, sf):
    """Fields of the papers' texts that are facts of a timeline, by the twelve mappings."""
    return legal_fields.facts(legal_fields.text_fields(_papers(spark, sf))).select("document_id", "fact_type", "date")


def _case_rows(spark, sf):
    """Orders of a customer as the papers of a case: type, fields and codes by the order's priority and status."""
    p, late = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus") == "F"
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    kind = F.when(p == "1", F.when(late, "PREV_CARTA_CONCESSAO").otherwise("PREV_CNIS")).when(p == "2", F.when(late, "MED_EXAME_IMAGEM").otherwise("TRAB_FICHA_REGISTRO")).when(p == "3", F.when(late, "MED_ATESTADO").otherwise("SST_FICHA_EPI")).when(p == "4", F.when(late, "PREV_CAT").otherwise("PROVA_BOLETIM_OCORRENCIA")).otherwise(F.when(late, "TRAB_TRCT").otherwise("SST_PCMSO"))
    k = F.col("o_orderkey")
    fields = F.create_map(
        F.lit("Especie_Beneficio"), F.when(k % 3 == 0, "B92").when(k % 3 == 1, "b31").otherwise("LOAS"), F.lit("Data_Demissao"), day, F.lit("Data_Admissao"), day, F.lit("Data_Documento"), day, F.lit("Data_Entrega_EPI"), day,
        F.lit("Numero_CA_EPI"), F.when(k % 4 == 0, "").otherwise("12345"), F.lit("Conclusao_Exame"), F.when(k % 2 == 0, "degenerativo").otherwise("grave"), F.lit("Nota"), F.when(k % 5 == 0, "acidente de trajeto com ruído").otherwise("nada"),
    )
    cids = F.array(F.when(k % 3 == 0, "H90").when(k % 3 == 1, "F32.1").otherwise("M54"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("document_id"), kind.alias("doc_type"), fields.alias("fields"), cids.alias("cids"))


_CASES = """r AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE o_orderpriority[1] || CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'x' END WHEN '1F' THEN 'PREV_CARTA_CONCESSAO' WHEN '1x' THEN 'PREV_CNIS' WHEN '2F' THEN 'MED_EXAME_IMAGEM' WHEN '2x' THEN 'TRAB_FICHA_REGISTRO'
   WHEN '3F' THEN 'MED_ATESTADO' WHEN '3x' THEN 'SST_FICHA_EPI' WHEN '4F' THEN 'PREV_CAT' WHEN '4x' THEN 'PROVA_BOLETIM_OCORRENCIA' WHEN '5F' THEN 'TRAB_TRCT' ELSE 'SST_PCMSO' END AS t FROM orders),
 hired AS (SELECT c, max(d) AS h FROM r WHERE t = 'TRAB_FICHA_REGISTRO' GROUP BY c),
 gear AS (SELECT c, max(d - before) AS gap, count(*) FILTER (k % 4 = 0) AS bad FROM (SELECT c, k, d, lag(d) OVER (PARTITION BY c ORDER BY d) AS before FROM r WHERE t = 'SST_FICHA_EPI') GROUP BY c),
 deaf AS (SELECT DISTINCT c FROM r WHERE t = 'MED_ATESTADO' AND k % 3 = 0)"""


@query(f"""WITH {_CASES},
 a AS (SELECT a.c, 'ALERTA_PRESCRICAO_SUSPENSAO_B92' AS alert FROM r a JOIN r b ON a.c = b.c WHERE a.t = 'TRAB_TRCT' AND a.d < DATE '2024-01-01' - 730 AND b.t = 'PREV_CARTA_CONCESSAO' AND b.k % 3 = 0
  UNION ALL SELECT DISTINCT h.c, 'ALERTA_CONCAUSA_AGRAVAMENTO' FROM hired h JOIN r e ON e.c = h.c AND e.t = 'MED_EXAME_IMAGEM' AND e.k % 2 = 0 AND e.d < h JOIN r g ON g.c = h.c AND g.t = 'MED_EXAME_IMAGEM' AND g.k % 2 = 1 AND g.d >= h
  UNION ALL SELECT DISTINCT deaf.c, 'ALERTA_EPI_IRREGULAR' FROM deaf LEFT JOIN gear ON gear.c = deaf.c WHERE gear.c IS NULL OR gap > 180 OR bad > 0
  UNION ALL SELECT DISTINCT a.c, 'ALERTA_CONFLITO_NEXO_B31' FROM r a JOIN r b ON a.c = b.c WHERE a.t = 'PREV_CARTA_CONCESSAO' AND a.k % 3 = 1 AND b.t = 'MED_ATESTADO' AND b.k % 3 = 1
  UNION ALL SELECT DISTINCT a.c, 'ALERTA_LOAS_TRABALHO_INFORMAL' FROM r a JOIN r b ON a.c = b.c JOIN r e ON e.c = a.c WHERE a.t = 'PREV_CARTA_CONCESSAO' AND a.k % 3 = 2 AND b.t = 'PREV_CNIS' AND e.t = 'MED_EXAME_IMAGEM' AND e.k % 5 = 0
  UNION ALL SELECT DISTINCT a.c, 'ALERTA_ACIDENTE_TRAJETO_POS_REFORMA' FROM r a JOIN r b ON a.c = b.c WHERE a.t = 'PREV_CAT' AND b.t = 'PROVA_BOLETIM_OCORRENCIA' AND b.k % 5 = 0)
 SELECT c AS case_id, alert, CASE WHEN alert = 'ALERTA_ACIDENTE_TRAJETO_POS_REFORMA' THEN 'média' ELSE 'alta' END AS severity, count(*) AS n FROM a GROUP BY ALL""")
def legal_alerts_all(spark, sf):
    """Six of the seven alerts on the same cases, with their severity (the other is domain_limbo_alert)."""
    found = legal_fields.alert_payloads(_case_rows(spark, sf), F.lit("2024-01-01").cast("date"))
    return found.groupBy("case_id", "alert", "severity").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Alfa Ltda' END AS contracting, CASE WHEN doc_id % 4 = 0 THEN '12 meses' END AS validity, CASE WHEN doc_id % 4 = 0 THEN 'R$ 1.234,56' END AS amounts
          FROM documents WHERE NOT (contains(lower(text), 'contrato') AND regexp_matches(lower(text), 'contratante|contratada|cl[áa]usula'))""")
def contract_blocks(spark, sf):
    head = F.when(F.col("doc_id") % 4 == 0, "CONTRATO\nContratante: Alfa Ltda, com sede\nContratada: Beta\nVigência de 12 meses, R$ 1.234,56 até o dia 01/02/2003\n").when(F.col("doc_id") % 4 == 1, "contrato\n").otherwise("")
    rows = table(spark, sf, "documents").where(~(F.contains(F.lower("text"), F.lit("contrato")) & F.lower("text").rlike("contratante|contratada|cl[áa]usula")))
    found = rows.select("doc_id", legal_fields.contract_block(F.concat(head, "text")).alias("b"))
    return found.select("doc_id", "b.contracting", "b.validity", F.array_join("b.amounts", ",").alias("amounts"))


# --- layout and recognition ------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey % 7, o_orderkey % 5, o_orderkey) AS text FROM orders GROUP BY o_custkey""")
def spans_by_position(spark, sf):
    """Orders of a customer as spans of a page, read from top to bottom and from left to right."""
    k = F.col("o_orderkey")
    spans = table(spark, sf, "orders").select("o_custkey", k.alias("span_ord"), k.cast("string").alias("text"), F.array((k % 5).cast("double"), (k % 7).cast("double"), F.lit(9.0), F.lit(9.0)).alias("bbox"))
    return segment.spans_text(spans, ["o_custkey"]).select("o_custkey", "text")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 90 ELSE 0 END AS angle FROM orders""")
def page_orientation(spark, sf):
    """Three readings of each page: one in four is a landscape page that reads best when it is turned."""
    k = F.col("o_orderkey")
    wide = k % 4 < 2
    said = F.when((k % 4 == 0) & (F.col("angle") == 90), "atestado do paciente com nome").when((k % 4 != 0) & (F.col("angle") == 0), "nome do paciente").when(k % 4 == 2, "nome do paciente atestado hospital com mais palavras").otherwise("~~ ^^ x")
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(90), F.lit(270))).alias("angle"))
    rows = rows.withColumn("text", said).withColumn("width", F.when(wide, 1200).otherwise(800)).withColumn("height", F.when(wide, 800).otherwise(1200))
    return recognition.best_orientation(rows, ["o_orderkey"], ["paciente", "atestado"]).select("o_orderkey", "angle")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'strategy_native_text' WHEN 1 THEN 'strategy_image_only' ELSE 'wanted' END AS status FROM documents) GROUP BY status""")
def pages_to_recognise(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id")
    strategies = pages.where("doc_id % 5 < 4").withColumn("strategy", F.when(F.col("doc_id") % 5 == 0, "native_text").when(F.col("doc_id") % 5 == 1, "image_only").when(F.col("doc_id") % 5 == 2, "ocr_light").otherwise("ocr_heavy"))
    wanted, skipped = recognition.pages_to_recognise(pages, strategies, ["doc_id"])
    rows = wanted.select(F.lit("wanted").alias("status")).unionByName(skipped.select(F.col("warning").alias("status")))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CRM ' || (c_custkey + 10000) || ' SP' WHEN c_custkey % 3 = 1 THEN 'CRM ' || (c_custkey + 10000) END AS display, CASE c_custkey % 3 WHEN 0 THEN 'Ana Lima' WHEN 1 THEN 'Ana Lima' ELSE 'Ana Lima' END AS name, CASE WHEN c_custkey % 3 < 2 THEN 'Médica clínica geral' END AS role FROM customer""")
def provider_lines(spark, sf):
    """Registrations and lines of providers in their parts."""
    k = F.col("c_custkey")
    crm = F.when(k % 3 == 0, F.concat(F.lit("CRM/SP "), k + 10000)).when(k % 3 == 1, F.concat(F.lit("CRM: "), k + 10000)).otherwise("sem registro")
    line = F.when(k % 3 < 2, "Ana  Lima Médica clínica geral").otherwise("Ana Lima")
    rows = table(spark, sf, "customer").select("c_custkey", page_entities.crm_parts(crm).alias("c"), page_entities.name_and_role(line).alias("n"))
    return rows.select("c_custkey", "c.display", "n.name", "n.role")
