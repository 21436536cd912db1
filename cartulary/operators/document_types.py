"""Types of documents and pages: vocabularies of legal documents, page headers, generic kinds of papers, and the decisions
that weigh them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import let
from . import classify, segment

# --- fixed values: vocabularies in order of precedence ---------------------------------------------------------------

LEGAL_TYPES = {
    "DOC_PESSOAL_RG": ["registro geral", "rg", "secretaria de seguranca"],
    "DOC_PESSOAL_CPF": ["cadastro de pessoas fisicas", "cpf", "receita federal"],
    "DOC_PESSOAL_CNH": ["carteira nacional de habilitacao", "permissao para dirigir", "categoria"],
    "DOC_COMPROVANTE_RESIDENCIA": ["cep", "logradouro", "codigo do cliente", "vencimento"],
    "DOC_PROCURACAO": ["outorgante", "outorgado", "procuração", "poderes"],
    "DOC_CONTRATO_HONORARIOS": ["contrato de honorarios", "honorários advocatícios", "clausula"],
    "DOC_DECLARACAO_HIPOSSUFICIENCIA": ["declaro", "hipossuficiência", "não possuo condições"],
    "TRAB_CTPS": ["carteira de trabalho", "contrato de trabalho", "admissão", "remuneração"],
    "TRAB_TRCT": ["termo de rescisão", "rescisao", "data de afastamento", "verbas rescisórias"],
    "TRAB_HOLERITE": ["recibo de pagamento", "salário base", "líquido", "descontos"],
    "TRAB_FICHA_REGISTRO": ["ficha de registro", "empregado", "cargo", "admissão"],
    "PREV_CAT": ["comunicacao de acidente de trabalho", "cat", "emitente"],
    "PREV_CNIS": ["cnis", "cadastro nacional de informações sociais", "competência"],
    "PREV_CARTA_CONCESSAO": ["carta de concessão", "nb", "dib", "rmi"],
    "PREV_CARTA_INDEFERIMENTO": ["indeferimento", "motivo", "pedido negado"],
    "PREV_LAUDO_SABI": ["sabi", "perícia médica federal", "conclusão pericial"],
    "PREV_PROCESSO_ADM_INTEGRAL": ["processo administrativo", "inss", "recurso", "decisão"],
    "MED_ATESTADO": ["atesto para os devidos fins", "dias de afastamento", "cid"],
    "MED_RECEITUARIO": ["receituario", "orientacao ao paciente", "retencao da farmacia"],
    "MED_PRONTUARIO_CLINICO": ["prontuário", "evolução", "anamnese", "atendimento"],
    "MED_EXAME_IMAGEM": ["ressonância", "tomografia", "radiografia", "laudo", "impressão diagnóstica"],
    "MED_AUDIOMETRIA": ["audiometria", "limiar auditivo", "perda auditiva"],
    "MED_LAUDO_ASSISTENTE_TECNICO": ["assistente técnico", "parecer técnico", "quesitos"],
    "SST_ASO_ADMISSIONAL": ["aso", "admissional", "apto", "inapto"],
    "SST_ASO_DEMISSIONAL": ["aso", "demissional", "apto", "inapto"],
    "SST_ASO_RETORNO": ["aso", "retorno ao trabalho", "apto", "inapto"],
    "SST_ASO_PERIODICO": ["aso", "periódico", "apto", "inapto"],
    "SST_PCMSO": ["pcmso", "programa de controle médico de saúde ocupacional"],
    "SST_PGR_PPRA": ["pgr", "ppra", "programa de prevenção de riscos ambientais"],
    "SST_AET": ["análise ergonômica", "aet", "ergonomia"],
    "SST_LTCAT": ["ltcat", "laudo técnico das condições ambientais do trabalho"],
    "SST_PPP": ["perfil profissiográfico previdenciário", "ppp"],
    "SST_FICHA_EPI": ["ficha de epi", "ca", "equipamento de proteção individual"],
    "PROVA_BOLETIM_OCORRENCIA": ["boletim de ocorrência", "delegacia", "histórico da ocorrência"],
    "PROVA_PRINT_MENSAGEM": ["whatsapp", "mensagem", "conversa"],
    "PROVA_FOTO_AMBIENTE": ["imagem", "fotografia", "ambiente"],
    "PROVA_ATA_NOTARIAL": ["ata notarial", "tabelião", "fé pública"],
}
PAGE_HEADERS = {
    "MED_RECEITUARIO": ["receituario", "orientacao ao paciente", "retencao da farmacia"],
    "PREV_CAT": ["comunicacao de acidente de trabalho", "cat"],
    "PREV_CARTA_CONCESSAO": ["carta de concessão", "carta de concessao", "nb", "dib"],
    "PREV_CARTA_INDEFERIMENTO": ["indeferimento", "pedido negado", "benefício indeferido", "beneficio indeferido"],
    "MED_PRONTUARIO_CLINICO": ["prontuário", "prontuario", "evolução", "evolucao", "anamnese", "atendimento"],
    "MED_EXAME_IMAGEM": ["ressonância", "ressonancia", "tomografia", "radiografia", "impressão diagnóstica", "impressao diagnostica"],
    "MED_AUDIOMETRIA": ["audiometria", "limiar auditivo", "perda auditiva"],
    "SST_ASO_ADMISSIONAL": ["aso", "admissional"],
    "SST_ASO_DEMISSIONAL": ["aso", "demissional"],
    "SST_ASO_RETORNO": ["aso", "retorno ao trabalho"],
    "SST_ASO_PERIODICO": ["aso", "periódico", "periodico"],
    "SST_PPP": ["perfil profissiográfico previdenciário", "perfil profissiografico previdenciario", "ppp"],
    "SST_FICHA_EPI": ["ficha de epi", "equipamento de proteção individual", "equipamento de protecao individual", "ca "],
    "TRAB_TRCT": ["termo de rescisão", "termo de rescisao", "verbas rescisórias", "verbas rescisorias"],
    "TRAB_HOLERITE": ["recibo de pagamento", "liquido", "salário base", "salario base"],
    "TRAB_CTPS": ["carteira de trabalho", "contrato de trabalho"],
    "PROVA_BOLETIM_OCORRENCIA": ["boletim de ocorrência", "boletim de ocorrencia", "delegacia"],
    "PROVA_ATA_NOTARIAL": ["ata notarial", "tabelião", "tabeliao"],
}
#: Fixed values: (label, strong words, supporting words, confidence by strong and by supporting words).
INVOICE = (["danfe", "nota fiscal", "nf-e", "nfe", "chave de acesso", "protocolo de autorização", "protocolo de autorizacao"], ["cnpj", "inscrição estadual", "inscricao estadual", "emitente", "destinatário", "destinatario"], 0.90, 0.80)
IDENTITY = (["carteira de identidade", "registro geral", "identidade", "passaporte", "carteira nacional de habilitação", "cnh"], ["rg", "cpf", "data de nascimento", "nascimento", "naturalidade", "filiação", "filiacao"], 0.88, 0.78)
RECEIPT = (["recibo", "comprovante", "bilhete eletr", "pagamento", "transação", "transacao"], [], 0.82, 0.82)
#: Labels of pages by the first word that their snippets hold.
PAGE_LABELS = {"RECEITU": ("pagina_receituario", 0.85), "ATESTADO": ("pagina_atestado", 0.85), "LAUDO": ("pagina_laudo", 0.80), "PARECER": ("pagina_parecer", 0.82), "PRONTUARIO": ("pagina_prontuario", 0.78), "RELATORIO": ("pagina_relatorio", 0.75)}
#: Words that signal a date, a currency and an identifier.
DATE_WORDS, CURRENCY_WORDS, IDENTIFIER_WORDS = ["data", "date", "/20", "-20"], ["r$", "$", "usd", "eur", "€"], ["cpf", "cnpj", "rg", "id", "invoice"]
#: Types of a document that hold whatever its text says, with their confidence; and those that an identity doesn't displace.
STRONG_TYPES = {"atestado_medico": 0.97, "parecer_medico": 0.96, "laudo_medico": 0.93, "receituario": 0.92, "documento_composto": 0.90, "prontuario": 0.90, "relatorio_medico": 0.89, "recibo": 0.82}
MEDICAL_PAPERS = ["documento_composto", "receituario", "laudo_medico", "prontuario", "relatorio_medico", "atestado_medico", "parecer_medico"]
#: The words of medical pages, as a label of their own.
MEDICAL = "medical page"


def _low(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def _any(low: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return found


def _typed(label: Column | str, confidence: Column | float) -> Column:
    put = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(put(label).alias("value"), put(confidence).cast("double").alias("confidence"))


def legal_type(value: Column) -> Column:
    """struct(value, confidence): the legal type with most of its words in the text, the first among equals."""
    best = F.array_max(classify.ranked_counts(_low(value), LEGAL_TYPES))
    return let(best, lambda top: F.when(top["s"] == 0, _typed("UNKNOWN", 0.10)).otherwise(_typed(top["label"], F.least(0.50 + 0.10 * top["s"], F.lit(0.97)))))


def header_type(value: Column) -> Column:
    """The type of a page by the words of headers; a page that only looks medical is a clinical record."""

    def decide(found: Column) -> Column:
        top, medical = F.array_max(F.filter(found, lambda x: x["label"] != MEDICAL)), F.exists(found, lambda x: (x["label"] == MEDICAL) & (x["s"] > 0))
        return F.when(top["s"] > 0, top["label"]).when(medical, "MED_PRONTUARIO_CLINICO").otherwise("UNKNOWN")

    return let(classify.ranked_counts(_low(value), PAGE_HEADERS | {MEDICAL: ["hospital", "crm", "paciente"]}), decide)


def header_subdocuments(pages: DataFrame, by: str, page: str = "page", value: str = "text") -> DataFrame:
    """Runs of pages of one header type: (by, subdoc_id, doc_type, pages, text). Unknown pages join the run before them."""
    typed = pages.withColumn("kind", header_type(F.col(value)))
    runs = segment.page_runs(typed, by, [page], "kind", "UNKNOWN").withColumn("subdoc_id", segment.subdoc_id(F.col("segment")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col("kind").alias("kind"), F.coalesce(F.col(value), F.lit("")).alias("text"))))
    made = runs.groupBy(by, "subdoc_id").agg(parts.alias("p"))
    return made.select(by, "subdoc_id", F.get("p", F.lit(0))["kind"].alias("doc_type"), F.transform("p", lambda x: x["page"]).alias("pages"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def signals(value: Column, uri: Column, media: Column) -> Column:
    """struct of what a document shows before it is classified."""
    low = _low(value)
    has = value.isNotNull() & (value != "")
    when = lambda words: F.when(has, _any(low, words))
    extension = F.nullif(F.lower(F.regexp_extract(uri, r"\.([^.]+)$", 1)), F.lit(""))
    return F.struct(has.alias("has_text"), when(DATE_WORDS).alias("has_dates"), when(CURRENCY_WORDS).alias("has_currency"), when(IDENTIFIER_WORDS).alias("has_identifiers"), extension.alias("file_extension"), media.alias("media_type"))


def generic_type(value: Column) -> Column:
    """struct(confidence, label) of invoice, identity paper or receipt; null if it is none of them."""
    return let(_low(value), _generic)


def _generic(low: Column) -> Column:
    def rule(label: str, words: tuple, supported: Column) -> classify.Rule:
        strong, _, sure, less = words
        return classify.Rule(label, _any(low, strong) | supported, F.when(_any(low, strong), sure).otherwise(less))

    return classify.best_rule([rule("nota_fiscal", INVOICE, _any(low, INVOICE[1]) & _any(low, CURRENCY_WORDS)), rule("identidade", IDENTITY, _any(low, IDENTITY[1])), rule("recibo", RECEIPT, F.lit(False))])


def invoice_label(value: Column) -> Column:
    """struct(value, confidence) of the least of taxonomies: an invoice, or null."""
    return F.when(_any(_low(value), ["danfe", "nota fiscal"]), _typed("nota_fiscal", 0.82))


def inferred_type(value: Column, canonical: Column) -> Column:
    """struct(value, confidence): a strong canonical type first, then words of medical papers, then the generic kinds, of which
    an identity paper doesn't displace a medical one."""
    up = F.upper(F.coalesce(value, F.lit("")))
    has = lambda x: F.contains(up, F.lit(x))
    kept = F.try_element_at(F.create_map(*[F.lit(x) for kv in STRONG_TYPES.items() for x in kv]), canonical)
    generic = generic_type(value)
    guarded = F.when((generic["label"] == "identidade") & canonical.isin(MEDICAL_PAPERS), _typed(canonical, 0.88)).when(generic.isNotNull(), _typed(generic["label"], generic["confidence"]))
    return (
        F.when(kept.isNotNull(), _typed(canonical, kept))
        .when(has("ATESTADO") & (has("CID") | has("CRM")), _typed("atestado_medico", 0.97))
        .when(has("PARECER") & has("CRM"), _typed("parecer_medico", 0.95))
        .when(has("RECEITU") & has("CRM"), _typed("receituario", 0.92))
        .when(has("LAUDO") & (has("CRM") | has("EXAME")), _typed("laudo_medico", 0.90))
        .when(guarded.isNotNull(), guarded)
        .when(has("RECEITU"), _typed("receituario", 0.90))
        .when(has("RECIBO"), _typed("recibo", 0.75))
    )


def canonical_type(value: Column, inferred: Column, best_page_type: Column) -> Column:
    """The type of a unit: by its text, else as it was inferred (but for identity papers), else that of its best page."""
    up = F.upper(F.coalesce(value, F.lit("")))
    has = lambda x: F.contains(up, F.lit(x))
    return (
        F.when(has("ATESTADO") & (has("CID") | has("CRM")), "atestado_medico").when(has("PARECER") & has("CRM"), "parecer_medico").when(has("RECEITU"), "receituario")
        .when(inferred.isNotNull() & (inferred != "identidade"), inferred).otherwise(F.coalesce(best_page_type, F.lit("documento_composto")))
    )


def page_label(core_snippets: Column, anchor_snippets: Column, value: Column) -> Column:
    """struct(value, confidence) of a page by its snippets, core ones first; these make it a little surer."""
    none = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    up = F.upper(F.coalesce(none(core_snippets), none(anchor_snippets), value, F.lit("")))
    label, sure = F.lit("pagina_documental"), F.lit(0.60)
    for word, (name, c) in reversed(PAGE_LABELS.items()):
        label, sure = F.when(F.contains(up, F.lit(word)), name).otherwise(label), F.when(F.contains(up, F.lit(word)), c).otherwise(sure)
    return _typed(label, F.when(none(core_snippets).isNotNull(), F.round(F.least(sure + 0.05, F.lit(1.0)), 3)).otherwise(sure))


def type_candidate(page_type: Column, document_type: Column) -> Column:
    """struct(value, confidence) of a page as a candidate for the type of its document."""
    value = F.coalesce(document_type, page_type)
    return F.when(value.isNotNull(), _typed(value, F.when(value == page_type, 0.88).otherwise(0.78)))


def best_page_type(pages: DataFrame, unit: list[str], rank: Column) -> DataFrame:
    """(unit, best_page_type): of the page of the least rank, then the first."""
    w = Window.partitionBy(*unit).orderBy(rank, "page")
    return pages.where("page_type IS NOT NULL").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*unit, F.col("page_type").alias("best_page_type"))
