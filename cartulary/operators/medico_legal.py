"""The medico-legal domain on top of the generic operators: page taxonomy, timeline seeds, probatory events, the causal
rules of social-security law and what weakens a link, case merging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import confidence, hashing
from ..functions.dates import display, floor_days
from . import causal, classify, timeline

# --- fixed values ---------------------------------------------------------------------------------------------------

#: Keywords of page types, in order of precedence.
PAGE_TYPES = {
    "atestado_medico": ["atestado", "declaro para devidos fins", "afastado(a)", "afastado", "internado(a)", "internado", "diagnostico", "diagnóstico", "cid"],
    "notificacao_receita": ["notificacao de receita", "medicamentos ou substancias", "identificacao do emitente"],
    "receituario": ["receituario", "receituário", "orientacao ao paciente", "orientação ao paciente", "retencao da farmacia", "retenção da farmácia", "comprimido", "posologia"],
    "registro_atendimento": ["data/hora atendimento", "prestador", "servico", "serviço", "convenio", "convênio", "internacao", "internação"],
    "cabecalho_hospitalar": ["hospital das clinicas", "hospital das clínicas", "faculdade de medicina", "fmusp", "hospital santa isabel"],
    "formulario_administrativo": ["identificacao do comprador", "identificação do comprador", "carimbo do fornecedor", "nome do vendedor"],
    "laudo_medico": ["laudo", "impressao diagnostica", "impressão diagnóstica", "exame", "ressonancia", "ressonância", "tomografia", "radiografia"],
    "documento_previdenciario": ["beneficio", "benefício", "nb", "dib", "indeferimento", "carta de concessao", "carta de concessão"],
}
GENERIC_MEDICAL = ["crm", "paciente", "hospital", "receituario", "receituário", "atestado"]

#: Types of events with their priority in a timeline; those of 900 and more stay out of it.
EVENT_PRIORITY = {
    "internacao_inicio": 10, "internacao_fim": 20, "document_issue_date": 40, "parecer_emitido": 45, "encaminhamento_clinico": 50, "registro_condicao_clinica": 55,
    "afastamento_inicio": 60, "afastamento_fim_estimado": 70, "document_date_candidate": 900, "birth_date": 999,
}
EVENT_LABELS = {
    "birth_date": "Data de nascimento", "internacao_inicio": "Início da internação", "internacao_fim": "Fim da internação", "afastamento_inicio": "Início do afastamento",
    "afastamento_fim_estimado": "Fim estimado do afastamento", "document_issue_date": "Data de emissão", "parecer_emitido": "Emissão de parecer médico",
    "encaminhamento_clinico": "Encaminhamento clínico", "registro_condicao_clinica": "Registro de condição clínica",
}
INTERVAL_TYPES = ["internacao_inicio", "internacao_fim", "afastamento_inicio", "afastamento_fim_estimado"]
MEDICAL_TYPES = ["parecer_medico", "atestado_medico", "receituario", "laudo_medico", "documento_composto"]
MEDICAL_PAGES = ["documento_medico", "laudo_medico", "receituario", "atestado_medico", "parecer_medico"]
BIRTH_MARKERS = "nascimento|nascto|data de nascimento|idade"
#: Pairs of code prefixes where the second may follow from the first.
PROGRESSION = [("S72", "S73"), ("S73", "M17"), ("T20", "L89"), ("T20", "M79"), ("T21", "M79"), ("M17", "M19"), ("M65", "M67")]
#: Confidence of each rule.
RULE_CONFIDENCE = {
    "rule_presuncao_ntep": 0.99, "rule_afastamento_prolongado": 0.85, "rule_mesmo_cid_multiplos_documentos": 0.78, "rule_progressao_anatomica": 0.82,
    "rule_conflito_datas_cids": 0.0, "rule_pericia_confirma_anterior": 0.88,
}


def _mapped(table: dict, key: Column, kind: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key).cast(kind)


def page_type(text: Column) -> Column:
    """struct(value, confidence) of a page."""
    return classify.taxonomy(F.lower(F.coalesce(text, F.lit(""))), PAGE_TYPES, GENERIC_MEDICAL, "documento_composto", "documento_medico", "unknown")


def segment_type(text: Column) -> Column:
    """The kind of a page for runs of pages: DOCUMENTO where it is unknown, so that the page joins the run before it."""
    value = page_type(text)["value"]
    return F.when(value == "unknown", "DOCUMENTO").otherwise(F.upper(value))


# --- seeds ----------------------------------------------------------------------------------------------------------


def seeds(units: DataFrame) -> DataFrame:
    """units(document_id, unit_id, unit_ord, page, document_type, and dates stay_start, stay_end, leave_start, leave_end,
    document_date as struct(date_iso, literal, snippet, bbox, page, confidence), and codes) -> seeds.

    A sick note gives a seed for each end of its stay and its leave, and nothing else if it gives any. All others give
    the day they were issued, unless that looks like a birth date, and opinions with codes one more."""
    of = lambda hint, item, base: F.when(F.col(item)["date_iso"].isNotNull(), _seed(F.lit(hint), F.col(item), base, F.col(item)["snippet"]))
    intervals = F.array_compact(F.array(of("internacao_inicio", "stay_start", 0.96), of("internacao_fim", "stay_end", 0.96), of("afastamento_inicio", "leave_start", 0.90), of("afastamento_fim_estimado", "leave_end", 0.80)))
    day = F.col("document_date")
    birth = F.lower(F.concat_ws(" ", day["snippet"], day["literal"])).rlike(BIRTH_MARKERS)
    opinion = F.coalesce(F.col("document_type") == "parecer_medico", F.lit(False))
    dated = day["date_iso"].isNotNull() & ~birth
    issued = F.when(dated, _seed(F.when(opinion, "parecer_emitido").otherwise("document_issue_date"), day, 0.84, day["snippet"]))
    condition = F.when(dated & opinion & (F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0), _seed(F.lit("registro_condicao_clinica"), day, None, F.array_join("codes", ", ")))
    general = F.array_compact(F.array(issued, condition))
    note = F.coalesce(F.col("document_type") == "atestado_medico", F.lit(False)) & (F.size(intervals) > 0)
    rows = units.select("document_id", "unit_id", "unit_ord", F.col("page").alias("unit_page"), "document_type", F.inline(F.when(note, intervals).otherwise(general)))
    rows = rows.withColumn("page", F.coalesce("page", "unit_page")).drop("unit_page")
    rows = rows.withColumn("priority", F.coalesce(_mapped(EVENT_PRIORITY, F.col("event_hint"), "int"), F.lit(500))).withColumn("include_in_timeline", F.col("priority") < 900)
    rows = rows.withColumn("review_state", confidence.review_state(F.col("confidence"))).withColumn("provenance_status", F.when(F.col("bbox").isNotNull(), "exact").otherwise("inferred"))
    level = F.when(F.col("event_hint") == "afastamento_fim_estimado", "inferred").otherwise(confidence.assertion_level(F.col("bbox").isNotNull(), F.col("provenance_status")))
    rows = rows.withColumn("assertion_level", level)
    return rows.withColumn("seed_id", hashing.seed_id(F.col("date_iso"), F.col("event_hint"), F.col("page"), F.col("unit_id"), F.col("snippet"), F.lit("units")))


def _seed(hint: Column, item: Column, base: float | None, snippet: Column) -> Column:
    sure = F.lit(0.92) if base is None else F.coalesce(F.nullif(item["confidence"], F.lit(0.0)), F.lit(base))
    return F.struct(hint.alias("event_hint"), item["date_iso"].alias("date_iso"), item["literal"].alias("date_literal"), snippet.alias("snippet"), item["bbox"].alias("bbox"), item["page"].alias("page"), sure.alias("confidence"))


# --- events ---------------------------------------------------------------------------------------------------------


def events(seed_rows: DataFrame, units: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Probatory events from seeds: those of the timeline, with the people and codes of their unit, title, description,
    confidence, provenance and the seed and up to two core zones of its page as citations.

    units(document_id, unit_id, patient, provider, codes); zones(document_id, page, ord, label, snippet, bbox,
    confidence, zone)."""
    rows = seed_rows.where(F.col("include_in_timeline") & F.col("date_iso").isNotNull() & ~F.col("event_hint").isin("birth_date", "document_date_candidate"))
    rows = rows.join(units.select("document_id", "unit_id", "patient", "provider", "codes"), ["document_id", "unit_id"], "left")
    citation = "struct<source:string,page:int,snippet:string,bbox:array<double>,provenance_status:string>"
    own = F.struct(F.lit("timeline_seed_v2").alias("source"), F.col("page").cast("int").alias("page"), F.coalesce("snippet", "date_literal").alias("snippet"), F.col("bbox").cast("array<double>").alias("bbox"), "provenance_status").cast(citation)
    if zones is None:
        rows = rows.withColumn("citations", F.array(own))
    else:
        core = zones.where("zone = 'core_probative'").withColumn("__rn", F.row_number().over(Window.partitionBy("document_id", "page").orderBy("ord"))).where("__rn <= 2")
        made = F.struct(F.lit("page_evidence_v1").alias("source"), F.col("page").cast("int").alias("page"), "snippet", F.col("bbox").cast("array<double>").alias("bbox"), F.when(F.col("bbox").isNotNull(), "exact").otherwise("snippet_only").alias("provenance_status")).cast(citation)
        core = core.groupBy("document_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", made.alias("c")))), lambda x: x["c"]).alias("zones"))
        rows = rows.join(core, ["document_id", "page"], "left").withColumn("citations", F.concat(F.array(own), F.coalesce("zones", F.array().cast(f"array<{citation}>")))).drop("zones")
    boxed = F.exists("citations", lambda c: c["bbox"].isNotNull())
    exact = F.exists("citations", lambda c: c["provenance_status"] == "exact")
    has_codes = F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0
    sure = confidence.event_confidence(F.col("confidence"), F.col("event_hint"), F.col("document_type"), F.col("bbox").isNotNull(), F.col("patient").isNotNull(), has_codes, INTERVAL_TYPES, MEDICAL_TYPES)
    rows = rows.withColumn("__c", sure).withColumn("provenance", confidence.event_provenance(boxed, exact, F.col("event_hint"), ["afastamento_fim_estimado"]))
    label = F.coalesce(_mapped(EVENT_LABELS, F.col("event_hint"), "string"), F.initcap(F.replace("event_hint", F.lit("_"), F.lit(" "))))
    codes = lambda k: F.array_join(F.slice("codes", 1, k), ", ")
    title = F.when(F.col("provider").isNotNull(), F.concat_ws(" — ", label, "provider")).when(has_codes, F.concat(label, F.lit(" ("), codes(2), F.lit(")"))).otherwise(label)
    said = F.coalesce("snippet", "date_literal")
    parts = [label, F.concat(F.lit("em "), "date_iso"), F.concat(F.lit("referente a "), "patient"), F.concat(F.lit("por "), "provider"), F.when(has_codes, F.concat(F.lit("CIDs: "), codes(3))), F.concat(F.lit('Evidência: "'), F.left(said, F.lit(160)), F.lit('"'))]
    return rows.select(
        "document_id", "unit_id", hashing.event_id(F.col("event_hint"), F.col("date_iso"), F.col("page"), F.col("document_id"), F.col("seed_id")).alias("event_id"), F.col("event_hint").alias("event_type"),
        "date_iso", title.alias("title"), F.concat_ws(" | ", *parts).alias("description"), "patient", "provider", "codes", "citations",
        F.when(F.col("provenance") == "exact", F.greatest("__c", F.lit(0.95))).otherwise(F.col("__c")).alias("confidence"),
        F.when(F.col("provenance") == "exact", "auto_confirmed").otherwise(confidence.review_state(F.col("__c"))).alias("review_state"), F.col("provenance").alias("provenance_status"), "assertion_level", "priority", "seed_id",
    )


# --- causes ---------------------------------------------------------------------------------------------------------


#: Arrows of links are grey as in a timeline that names no colour, those of conflicts red.
LINK_COLOUR, CONFLICT_COLOUR = "#6b7280", "#dc2626"
#: What a rule says of a link, and the law that it rests on.
NO_CODE = "N/A"
LEGAL_BASIS = {
    "rule_presuncao_ntep": "Lei 8.213/1991 Art. 20; Decreto 3.048/1999; Tabela CEREST",
    "rule_afastamento_prolongado": "TNU; Jurisprudência dominante em benefícios previdenciários",
    "rule_mesmo_cid_multiplos_documentos": "Princípio de coerência probatória",
    "rule_progressao_anatomica": "Critério médico-pericial: dose-resposta e progressão temporal",
    "rule_conflito_datas_cids": "Coerência probatória e análise de documentos contraditórios",
    "rule_pericia_confirma_anterior": "Jurisprudência STJ: peso probatório da perícia em benefícios previdenciários",
}
EXPLANATIONS = {
    "rule_presuncao_ntep": "Presunção legal: {atividade} + {cid} está na tabela NTEP (Lei 8.213/91 Art. 20)",
    "rule_afastamento_prolongado": "Afastamento de {dias} dias após acidente indica nexo causal (Jurisprudência TNU)",
    "rule_mesmo_cid_multiplos_documentos": "CID {cid} confirmado em múltiplos documentos ({doc_a} e {doc_b}), validando diagnóstico",
    "rule_progressao_anatomica": "Progressão anatômica: {cid_a} (lesão inicial) → {cid_b} (complicação) indica nexo da lesão inicial",
    "rule_conflito_datas_cids": "⚠ CONFLITO: {cid} em {data_a} vs {data_b} (diferença: {dias} dias). Requer revisão.",
    "rule_pericia_confirma_anterior": "Perícia INSS (data: {data_pericia}) confirma {cid} diagnosticado anteriormente, reforçando nexo causal",
}


def explanation(template: str) -> Column:
    """A template with the values of the events a and b; values that are missing read as such."""
    of = lambda c, otherwise: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(otherwise))
    day = lambda side: F.coalesce(F.date_format(f"{side}.ts", "dd/MM/yyyy"), F.lit(NO_CODE))
    values = {
        "cid": of("b.cid", NO_CODE), "cid_a": of("a.cid", NO_CODE), "cid_b": of("b.cid", NO_CODE), "atividade": of("a.document_activity", NO_CODE),
        "dias": F.coalesce(floor_days(F.col("a.ts"), F.col("b.ts")).cast("string"), F.lit(NO_CODE)), "data_a": day("a"), "data_b": day("b"), "data_pericia": day("b"),
        "doc_a": of("a.event_type", "Evento A"), "doc_b": of("b.event_type", "Evento B"),
    }
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def read_ntep(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The table of occupational presumption from CSV files with columns activity and code: some hundred pairs."""
    rows = spark.read.option("header", True).csv(path).select(F.lower("activity"), F.upper("code")).distinct().collect()
    return sorted((r[0].replace(" ", "_"), r[1]) for r in rows)


def _rules(with_ntep: bool) -> list[causal.Rule]:
    prefix, own = F.col("prefix"), F.array_compact(F.array("prefix"))
    later, days = F.col("a.ts") < F.col("b.ts"), floor_days(F.col("a.ts"), F.col("b.ts"))
    says = lambda word: F.contains(F.lower("event_type"), F.lit(word))
    tests = {
        "rule_presuncao_ntep": causal.Test(later, F.col("ntep_reach"), F.col("ntep_offers")),
        "rule_afastamento_prolongado": causal.Test(days > 30, second=says("afastamento")),
        "rule_mesmo_cid_multiplos_documentos": causal.Test(later, own),
        "rule_progressao_anatomica": causal.Test(later, causal.next_codes(prefix, PROGRESSION), own),
        "rule_conflito_datas_cids": causal.Test(F.abs(days) > 60, own),
        "rule_pericia_confirma_anterior": causal.Test(later & F.contains(F.lower("b.event_type"), F.lit("perícia")), own),
    }
    # The codes of the same-code rules are compared by their prefix too.
    tests = {k: causal.Test(t.condition, t.reach, t.offers if t.offers is not None or t.reach is None else own, t.second) for k, t in tests.items()}
    return [causal.Rule(k, t, RULE_CONFIDENCE[k], explanation(EXPLANATIONS[k]), LEGAL_BASIS[k]) for k, t in tests.items() if with_ntep or k != "rule_presuncao_ntep"]


def _activity(name: str) -> Column:
    return F.nullif(F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")), F.lit(""))


def causal_links(events_df: DataFrame, ntep: list[tuple[str, str]], scope: str = "scope_id") -> DataFrame:
    """events(scope, pos, event_id, event_type, ts, cid, provider_activity, and if there are such document_activity and
    citations) -> links with confidence, explanation, citations, weakening factors, review state, level and thickness of display.

    ntep: pairs of an activity and a fragment of a code. A pair speaks for a link if its activity is within that of the
    first event (or, where that has none, of its document), spaces read as underscores, and its fragment within the
    first three characters of the second event's code. Conflicts have confidence 0 and stay."""
    rows = events_df.withColumn("prefix", F.nullif(F.left("cid", F.lit(3)), F.lit(""))).withColumn("code", F.col("cid"))
    for name, kind in (("document_activity", "string"), ("citations", "array<struct<source:string,page:int,snippet:string,bbox:array<double>,provenance_status:string>>")):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    if ntep:
        rows = rows.withColumn("__activity", F.coalesce(_activity("provider_activity"), _activity("document_activity")))
        acts = rows.select("__activity").distinct().withColumn("ntep_reach", causal.reached(F.col("__activity"), ntep))
        codes = rows.select("prefix").distinct().withColumn("ntep_offers", causal.held(F.col("prefix"), [c for _, c in ntep]))
        rows = rows.join(acts, "__activity", "left").join(codes, "prefix", "left")
    cited = F.array_compact(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{side}.event_id").alias("event_id"), F.try_element_at(f"{side}.citations", F.lit(1)).alias("citation")) for side, kind in (("a", "source_event"), ("b", "target_event"))]))
    found = causal.links(rows, [scope], _rules(bool(ntep)), more={"citations": F.filter(cited, lambda c: c["citation"].isNotNull())})
    coded = rows.where("prefix IS NOT NULL")
    busy = causal.conflicting_values(coded, [scope, "prefix"], "provider_activity").select(scope, F.col("prefix").alias("__pb"), F.col("conflicting"))
    gap = causal.gaps(coded, [scope, "prefix"], "ts", 730).select(scope, F.col("prefix").alias("__pa"), F.col("has_gap"))
    out = found.withColumn("__pa", F.left("code_a", F.lit(3))).withColumn("__pb", F.left("code_b", F.lit(3))).join(busy, [scope, "__pb"], "left").join(gap, [scope, "__pa"], "left")
    late = floor_days(F.col("ts_a"), F.col("ts_b")) > 1825
    factors = F.array_compact(F.array(F.when(late, "diagnóstico_tardio"), F.when(F.col("conflicting"), "ocupações_conflitantes"), F.when(F.col("has_gap"), "intervalo_sem_tratamento")))
    c = F.col("confidence")
    return out.select(
        scope, "event_a", "event_b", "ts_a", "ts_b", "rule_id", "confidence", "explanation", "legal_basis", "citations", factors.alias("weakening_factors"), (F.col("rule_id") == "rule_conflito_datas_cids").alias("is_conflict"),
        F.when(F.size(factors) > 0, "needs_review").otherwise(confidence.review_state(c)).alias("review_state"), confidence.causal_level(c).alias("level"), confidence.link_strength(c).alias("strength"),
        F.when(c >= 0.9, 3).when(c >= 0.75, 2).otherwise(1).alias("thickness"), F.when(F.col("rule_id") == "rule_conflito_datas_cids", CONFLICT_COLOUR).otherwise(LINK_COLOUR).alias("arrow_colour"),
    )


def with_citations(events_df: DataFrame, document: str = "document_id") -> DataFrame:
    """events with a citation each: those that have none point at the first page of their document, as inferred."""
    kind = "array<struct<source:string,page:int,snippet:string,bbox:array<double>,provenance_status:string>>"
    said = F.coalesce("description", "title", F.lit(""))
    stand_in = F.array(F.struct(F.concat(F.lit("document://"), F.coalesce(F.col(document).cast("string"), F.lit("unknown"))), F.lit(1), said, F.lit(None).cast("array<double>"), F.lit("inferred"))).cast(kind)
    return events_df.withColumn("citations", F.when(F.size(F.coalesce("citations", F.array().cast(kind))) > 0, F.col("citations")).otherwise(stand_in))


def merged_case(documents: list[DataFrame], scope: str) -> DataFrame:
    """Events of several documents as one case: each event once, in order of dates, undated ones last."""
    merged = timeline.merge(documents, "event_id", "ts").withColumn("scope_id", F.lit(scope))
    return timeline.in_order(merged, ["scope_id"], [F.col("ts").asc_nulls_last(), F.col("event_id")], "pos")


def causal_timeline(events_df: DataFrame, links: DataFrame, scope: str = "scope_id") -> DataFrame:
    """Events with the date as it is shown and the number of links they are in."""
    ends = links.select(scope, F.explode(F.array("event_a", "event_b")).alias("event_id")).groupBy(scope, "event_id").agg(F.count("*").alias("n_links"))
    shown = events_df.join(ends, [scope, "event_id"], "left")
    return shown.withColumn("display_date", display(F.col("ts"), F.col("date_iso"))).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
