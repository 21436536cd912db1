"""Fields of legal documents: patterns by family of document, the projection of a canonical record, facts and what an
alert says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import legal, page_entities

# --- fixed values ----------------------------------------------------------------------------------------------------

#: Families of document types that share fields.
FAMILIES = {
    "pessoal": ["DOC_PESSOAL_RG", "DOC_PESSOAL_CPF", "DOC_PESSOAL_CNH", "DOC_COMPROVANTE_RESIDENCIA"],
    "trabalho": ["TRAB_CTPS", "TRAB_TRCT", "TRAB_HOLERITE", "TRAB_FICHA_REGISTRO"],
    "previdencia": ["PREV_CAT", "PREV_CNIS", "PREV_CARTA_CONCESSAO", "PREV_CARTA_INDEFERIMENTO", "PREV_LAUDO_SABI", "PREV_PROCESSO_ADM_INTEGRAL"],
    "medico": ["MED_ATESTADO", "MED_RECEITUARIO", "MED_PRONTUARIO_CLINICO", "MED_EXAME_IMAGEM", "MED_AUDIOMETRIA", "MED_LAUDO_ASSISTENTE_TECNICO"],
    "seguranca": ["SST_ASO_ADMISSIONAL", "SST_ASO_DEMISSIONAL", "SST_ASO_RETORNO", "SST_ASO_PERIODICO", "SST_PCMSO", "SST_PGR_PPRA", "SST_AET", "SST_LTCAT", "SST_PPP", "SST_FICHA_EPI"],
}
_DAY = r"(\b\d{2}/\d{2}/\d{4}\b)"
_CODE = r"\b([A-TV-Z][0-9]{2}(?:\.[0-9A-Z]{1,2})?)\b"
#: Fixed values: (pattern, which match counts: 0 the first, -1 the last) of each field; group 1 is the value.
PATTERNS = {
    "pessoal": {
        "Nome_Completo": (r"(?iu)(?:nome(?:\s+completo)?|nome\s+paciente)[:;\s]+([A-ZÁÀÃÂÉÊÍÓÔÕÚÇ][A-ZÁÀÃÂÉÊÍÓÔÕÚÇ\s]{5,}?)(?=\s+Nascimento|\s+Sexo|\n|$)", 0),
        "Data_Nascimento": (_DAY, 0),
        "Numero_RG": (r"(?iu)\bRG[:\s\-]*([0-9A-Z\.\-]{5,20})\b", 0),
        "Numero_CPF": (r"(\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d{11}\b)", 0),
        "CEP": (r"(\b\d{5}-\d{3}\b)", 0),
        "Endereco_Completo": (r"(?iu)((?:Avenida|Rua|Travessa|Alameda|Rodovia)\s+[A-Za-zÀ-ÿ0-9\s,\-]+)", 0),
    },
    "trabalho": {
        "CNPJ_Empregador": (r"(\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b)", 0),
        "Razao_Social": (r"(?iu)\b(?:raz[aã]o\s+social|empregador)[:\s\-]*([A-Za-zÀ-ÿ0-9\s\.\-\/]{4,120})", 0),
        "Cargo": (r"(?iu)\b(?:cargo|fun[cç][aã]o)[:\s\-]*([A-Za-zÀ-ÿ\s]{3,60})", 0),
        "Data_Admissao": (r"(?iu)\bdata\s+de\s+admiss[aã]o[:\s\-]*([0-9]{2}/[0-9]{2}/[0-9]{4})", 0),
        "Data_Demissao": (r"(?iu)\bdata\s+de\s+(?:demiss[aã]o|afastamento)[:\s\-]*([0-9]{2}/[0-9]{2}/[0-9]{4})", 0),
        "Ultima_Remuneracao": (r"(?iu)\b(?:ultima\s+remunera[cç][aã]o|remunera[cç][aã]o)[:\s\-]*R?\$?\s*([0-9\.\,]+)", 0),
    },
    "previdencia": {
        "Numero_Beneficio": (r"(?iu)\bNB[:\s\-]*([0-9\.\-]{8,20})\b", 0),
        "Especie_Beneficio": (r"(?iu)\b(B31|B91|B92|B87|LOAS)\b", 0),
        "DIB": (r"(?iu)\bDIB[:\s\-]*([0-9]{2}/[0-9]{2}/[0-9]{4})\b", 0),
        "DCB": (r"(?iu)\bDCB[:\s\-]*([0-9]{2}/[0-9]{2}/[0-9]{4})\b", 0),
        "CID_INSS": (_CODE, 0),
    },
    "medico": {
        "Data_Documento": (_DAY, -1),
        "CRM_Medico": (r"(?iu)\bCRM(?:\s*[-:/]?\s*[A-Z]{0,2})?\s*[-:]?\s*(\d{4,8})\b", 0),
        "CID_Atestado": (_CODE, 0),
        "Dias_Afastamento": (r"(?iu)\b(\d{1,3})\s+dias?\s+de\s+afastamento\b", 0),
    },
    "seguranca": {
        "Data_ASO": (r"(?iu)\b(?:data\s+aso|data\s+do\s+aso|em)\s*[:\-]?\s*([0-9]{2}/[0-9]{2}/[0-9]{4})", 0),
        "Resultado_ASO": (r"(?iu)\b(apto|inapto)\b", 0),
        "Numero_CA_EPI": (r"(?iu)\bCA[:\s\-]*([0-9]{3,12})\b", 0),
        "Data_Entrega_EPI": (_DAY, 0),
    },
}
#: Fields whose value is the first of these terms that the text holds.
TERMS = {"medico": ("Conclusao_Exame", ["degenerativo", "extrusão discal", "extrusao discal", "pairo"]), "seguranca": ("Agente_Nocivo", ["ruído", "ruido", "sílica", "silica", "postura", "agrotóxicos", "agrotoxicos"])}
REFUSAL = ("PREV_CARTA_INDEFERIMENTO", "Motivo_Indeferimento", "motivo não estruturado")
#: Confidence of fields, 0.85 where none is named.
FIELD_CONFIDENCE = {"Conclusao_Exame": 0.75, "Agente_Nocivo": 0.70, "Data_Entrega_EPI": 0.65, "Motivo_Indeferimento": 0.40}
#: Fields that are facts of a timeline.
FACTS = {
    "Data_Nascimento": "data_nascimento", "Data_Admissao": "data_admissao", "Data_Demissao": "data_demissao", "DIB": "dib_beneficio", "DCB": "dcb_beneficio", "Data_Documento": "data_documento_medico",
    "Data_ASO": "data_aso", "Data_Entrega_EPI": "data_entrega_epi", "Internacao_Inicio": "internacao_inicio", "Internacao_Fim": "internacao_fim", "Afastamento_Inicio": "afastamento_inicio", "Afastamento_Fim_Estimado": "afastamento_fim_estimado",
}
#: Title, severity and message of the alerts, and the types of the documents that support them.
ALERT_TEXTS = {
    "ALERTA_PRESCRICAO_SUSPENSAO_B92": ("Contrato Suspenso por B92", "alta", "Contrato suspenso por B92. Prescrição conta a partir da concessão do benefício.", ["TRAB_TRCT", "PREV_CARTA_CONCESSAO"]),
    "ALERTA_LIMBO_PREVIDENCIARIO": ("Limbo Previdenciário Identificado", "alta", "INSS deu alta, empresa recusou retorno.", ["PREV_CARTA_CONCESSAO", "PREV_LAUDO_SABI", "SST_ASO_RETORNO"]),
    "ALERTA_CONCAUSA_AGRAVAMENTO": ("Possível Concausa", "alta", "Doença preexistente agravada. Falta de Análise Ergonômica (AET) na documentação.", ["MED_EXAME_IMAGEM"]),
    "ALERTA_EPI_IRREGULAR": ("Ineficácia / irregularidade de EPI", "alta", "EPI documentado de forma irregular. Forte tese para afastar neutralização do ruído.", ["SST_FICHA_EPI"]),
    "ALERTA_CONFLITO_NEXO_B31": ("Conflito de Nexo", "alta", "INSS não reconheceu acidente, mas há indícios de omissão no PCMSO patronal.", ["PREV_CARTA_CONCESSAO", "MED_ATESTADO", "SST_PCMSO"]),
    "ALERTA_LOAS_TRABALHO_INFORMAL": ("LOAS x Doença Ocupacional", "alta", "Trabalho informal. Recebimento de LOAS por culpa patronal na sonegação previdenciária.", ["PREV_CARTA_CONCESSAO", "PREV_CNIS"]),
    "ALERTA_ACIDENTE_TRAJETO_POS_REFORMA": ("Acidente in itinere pós-reforma", "média", "Há estabilidade, mas não há responsabilidade civil do empregador.", ["PREV_CAT", "PROVA_BOLETIM_OCORRENCIA"]),
}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def family(doc_type: Column) -> Column:
    return F.try_element_at(_map({t: name for name, types in FAMILIES.items() for t in types}), doc_type)


def text_fields(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """documents(key, doc_type, text) -> (key, doc_type, field, ord, value, confidence): the fields of each document's
    family that its text has."""
    t = F.coalesce("text", F.lit(""))
    low = F.lower(t)

    def match(pattern: str, which: int) -> Column:
        if which == 0:
            return F.regexp_extract(t, pattern, 1)
        return F.element_at(F.coalesce(F.nullif(F.regexp_extract_all(t, F.lit(pattern), 1), F.array().cast("array<string>")), F.array(F.lit(""))), which)

    def term(words: list[str]) -> Column:
        out = F.lit(None).cast("string")
        for w in reversed(words):
            out = F.when(F.contains(low, F.lit(w)), w).otherwise(out)
        return out

    rows = documents.withColumn("__family", family(F.col("doc_type")))
    item = lambda name, c: F.struct(F.lit(name).alias("field"), F.nullif(F.trim(c), F.lit("")).alias("value"))
    made = None
    for name, patterns in PATTERNS.items():
        items = [item(field, match(*p)) for field, p in patterns.items()]
        if name in TERMS:
            items.append(item(TERMS[name][0], term(TERMS[name][1])))
        if name == "previdencia":
            items.append(item(REFUSAL[1], F.when(F.col("doc_type") == REFUSAL[0], REFUSAL[2])))
        made = F.when(F.col("__family") == name, F.array(*items)) if made is None else made.when(F.col("__family") == name, F.array(*items))
    sure = F.coalesce(F.try_element_at(_map(FIELD_CONFIDENCE), F.col("field")), F.lit(0.85))
    found = rows.select(key, "doc_type", F.posexplode(made).alias("ord", "f")).select(key, "doc_type", "f.field", "ord", "f.value").where("value IS NOT NULL")
    return found.withColumn("confidence", sure)


def canonical_fields(units: DataFrame, key: str = "document_id") -> DataFrame:
    """units(key, document_type, patient, mother, provider, crm, document_date and stay and leave dates as
    struct(date_iso, literal, confidence, bbox), leave_days, codes, has_warnings) -> (key, field, ord, value,
    normalized_value, assertion_level, provenance_status, review_state): one row a field, one a code."""
    level = {"Tipo_Documento": "inferred", "Afastamento_Inicio": "inferred", "Afastamento_Fim_Estimado": "estimated"}
    day = lambda c: (F.coalesce(F.col(c)["literal"], F.col(c)["date_iso"]), F.col(c)["date_iso"], F.col(c)["bbox"].isNotNull())
    plain = lambda c: (F.nullif(F.trim(c), F.lit("")), F.nullif(F.trim(c), F.lit("")), F.lit(False))
    named = {
        "Tipo_Documento": plain("document_type"), "Nome_Paciente": plain("patient"), "Nome_Mae": plain("mother"), "Nome_Medico": plain("provider"), "CRM_Medico": plain("crm"), "Data_Documento": day("document_date"),
        "Internacao_Inicio": day("stay_start"), "Internacao_Fim": day("stay_end"), "Dias_Afastamento": plain("leave_days"), "Afastamento_Inicio": day("leave_start"), "Afastamento_Fim_Estimado": day("leave_end"),
    }
    kind = "struct<field:string,ord:int,value:string,normalized_value:string,boxed:boolean>"
    item = lambda n, i, v, norm, boxed: F.struct(F.lit(n), F.lit(i) if isinstance(i, int) else i, v, norm, boxed).cast(kind)
    single = F.array(*[item(n, 0, *parts) for n, parts in named.items()])
    codes = F.transform(F.coalesce("codes", F.array().cast("array<string>")), lambda c, i: item("CID_Atestado", i, c, c, F.lit(False)))
    rows = units.select(key, "has_warnings", F.inline(F.concat(single, codes))).where("normalized_value IS NOT NULL")
    how = F.when(F.col("boxed"), "exact").when(F.col("field") == "Tipo_Documento", "inferred").when(F.col("field").rlike("^(Internacao|Afastamento|Dias)"), "text_fallback").otherwise("snippet_only")
    state = F.when((F.col("field") == "Tipo_Documento") & ~F.coalesce("has_warnings", F.lit(False)), "auto_confirmed").when(F.col("boxed"), "auto_confirmed").otherwise("review_recommended")
    return rows.select(key, "field", "ord", "value", "normalized_value", F.coalesce(F.try_element_at(_map(level), F.col("field")), F.lit("observed")).alias("assertion_level"), how.alias("provenance_status"), state.alias("review_state"))


def facts(fields: DataFrame, key: str = "document_id") -> DataFrame:
    """fields(key, field, value) -> (key, fact_type, date), in the order of dates and types."""
    mapping = fields.sparkSession.createDataFrame(list(FACTS.items()), "field string, fact_type string")
    return legal.facts(fields, mapping, key).orderBy(key, "date", "fact_type")


def field_map(fields: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, fields map): of a field that stands several times the last value counts."""
    last = fields.groupBy(key, "field").agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def alert_payloads(rows: DataFrame, today: Column, case: str = "case_id", document: str = "document_id") -> DataFrame:
    """legal.case_alerts with title, severity, message and the documents of the case that support the alert."""
    spark = rows.sparkSession
    texts = spark.createDataFrame([(code, *t) for code, t in ALERT_TEXTS.items()], "alert string, title string, severity string, message string, types array<string>")
    found = legal.case_alerts(rows, today, case).join(texts, "alert")
    kinds = found.select(case, "alert", F.explode("types").alias("doc_type")).distinct()
    support = rows.select(case, "doc_type", F.col(document).cast("string").alias("d")).join(kinds, [case, "doc_type"]).groupBy(case, "alert").agg(F.array_sort(F.collect_set("d")).alias("supporting_documents"))
    return found.drop("types").join(support, [case, "alert"], "left")


def legal_section(fields: DataFrame, fact_rows: DataFrame, alerts: DataFrame, key: str = "document_id") -> DataFrame:
    """Counts of a document's fields, facts and alerts."""
    counted = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    out = counted(fields, "total_canonical_fields").join(counted(fact_rows, "total_timeline_facts"), key, "full").join(counted(alerts, "total_alerts"), key, "full")
    return out.na.fill(0, ["total_canonical_fields", "total_timeline_facts", "total_alerts"])


def contract_gate(value: Column) -> Column:
    """Whether a text is that of a contract with its parts."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.contains(low, F.lit("contrato")) & low.rlike("contratante|contratada|cláusula|clausula")


def contract_block(value: Column) -> Column:
    """struct of parties, validity, values and deadlines of a contract's text, null where it is none."""
    t = F.coalesce(value, F.lit(""))
    first = lambda p: page_entities.first_of(t, p)
    found = F.struct(
        first(r"(?iu)contratante\s*:\s*([^\n,;]+)").alias("contracting"), first(r"(?iu)contratad[oa]\s*:\s*([^\n,;]+)").alias("contracted"),
        first(r"(?iu)(?:vig[êe]ncia|prazo)[^\n]*?(\d{1,4}\s+(?:dias?|meses|m[êe]s|anos?))").alias("validity"), F.regexp_extract_all(t, F.lit(r"(R\$\s*\d{1,3}(?:\.\d{3})*,\d{2})"), 1).alias("amounts"),
        F.regexp_extract_all(t, F.lit(r"(?iu)at[ée]\s+(?:o\s+dia\s+)?(\d{2}/\d{2}/\d{4})"), 1).alias("deadlines"),
    )
    return F.when(contract_gate(t), found)
