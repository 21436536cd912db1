"""Queries on stages: presumptions and explanations of links, canonical units, context of documents, projections, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, hard_entities, legal_fields, medico_legal, page_entities, relations, stages, timeline
from ..session import dealt
from .pages import _CODES, _name_sql, _pages, _pick, _pick_sql
from .registry import query, table

_ACTS = ["Eletricista industrial", "soldador de arco", "eletricista", "e", "", "pintor"]
_CIDS = ["T20.0", "M54.5", "F32", "S72.1", "T21"]
_NTEP = [("eletricista", "T2"), ("soldador_de", "M54"), ("pintor", "F3"), ("eletricista_industrial_chefe", "S72"), ("eletricista", "T20")]


def _case_events(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("scope_id"), k.alias("pos"), k.alias("event_id"), F.lit("diagnostico").alias("event_type"), F.col("o_orderdate").cast("timestamp").alias("ts"), _pick(_CIDS, k).alias("cid"),
        _pick(_ACTS, k).alias("provider_activity"), F.lit("Pintor predial").alias("document_activity"), k.cast("string").alias("document_id"),
    )


_EV = f"SELECT o_custkey, o_orderkey, o_orderdate, {_pick_sql(_CIDS, 'o_orderkey')} AS cid, replace(lower(CASE WHEN {_pick_sql(_ACTS, 'o_orderkey')} = '' THEN 'Pintor predial' ELSE {_pick_sql(_ACTS, 'o_orderkey')} END), ' ', '_') AS act FROM orders"
_NTEP_SQL = ", ".join(f"('{a}', '{c}')" for a, c in _NTEP)


@query(f"""SELECT DISTINCT a.o_custkey, a.o_orderkey AS event_a, b.o_orderkey AS event_b FROM ({_EV}) a JOIN ({_EV}) b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.o_orderdate
          JOIN (VALUES {_NTEP_SQL}) t(x, y) ON contains(a.act, t.x) AND contains(left(b.cid, 3), t.y)""")
def domain_ntep_links(spark, sf):
    """The presumption by activity and code: the table's activity within the event's, or within the document's where the
    event has none. `eletricista industrial` is listed by `eletricista`; `e` is not, nor is what the table alone has more of."""
    found = medico_legal.causal_links(_case_events(spark, sf), _NTEP).where("rule_id = 'rule_presuncao_ntep'")
    return found.select(F.col("scope_id").alias("o_custkey"), "event_a", "event_b")


@query(f"""SELECT a.o_custkey, a.o_orderkey AS event_a, b.o_orderkey AS event_b, 'CID ' || b.cid || ' confirmado em múltiplos documentos (diagnostico e diagnostico), validando diagnóstico' AS explanation, 'Princípio de coerência probatória' AS legal_basis
          FROM ({_EV}) a JOIN ({_EV}) b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.o_orderdate AND left(a.cid, 3) = left(b.cid, 3)""")
def link_explanations(spark, sf):
    found = medico_legal.causal_links(_case_events(spark, sf), []).where("rule_id = 'rule_mesmo_cid_multiplos_documentos'")
    return found.select(F.col("scope_id").alias("o_custkey"), "event_a", "event_b", "explanation", "legal_basis")


@query(f"""SELECT a.o_custkey, a.o_orderkey AS event_a, b.o_orderkey AS event_b, 2 AS n_citations, 'document://' || a.o_orderkey || ',document://' || b.o_orderkey AS sources
          FROM ({_EV}) a JOIN ({_EV}) b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND left(a.cid, 3) || '>' || left(b.cid, 3) IN ({', '.join(f"'{x}>{y}'" for x, y in [*medico_legal.PROGRESSION, ('T20', 'T20')])})
          AND a.o_orderdate < b.o_orderdate AND left(a.cid, 3) = 'T20' AND left(b.cid, 3) = 'T20'""")
def link_citations(spark, sf):
    """Links between events of one code cite both, by stand-ins that point at their documents."""
    kind = "array<struct<source:string,page:int,snippet:string,bbox:array<double>,provenance_status:string>>"
    bare = _case_events(spark, sf).withColumn("citations", F.lit(None).cast(kind)).withColumn("description", F.lit("x")).withColumn("title", F.lit("y"))
    found = medico_legal.causal_links(medico_legal.with_citations(bare), []).where("rule_id = 'rule_mesmo_cid_multiplos_documentos'")
    codes = _case_events(spark, sf).where("left(cid, 3) = 'T20'").select(F.col("event_id").alias("event_b"))
    found = found.join(codes, "event_b", "left_semi")
    return found.select(F.col("scope_id").alias("o_custkey"), "event_a", "event_b", F.size("citations").alias("n_citations"), F.array_join(F.transform("citations", lambda c: c["citation"]["source"]), ",").alias("sources"))


@query("""SELECT o_custkey AS scope_id, o_orderkey AS event_a, o_orderkey + 1 AS event_b, 'r' AS rule_id, max(l_quantity) AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def links_once(spark, sf):
    """Repeated links of a rule: the most confident of each stays."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("scope_id"), F.col("o_orderkey").alias("event_a"), (F.col("o_orderkey") + 1).alias("event_b"), F.lit("r").alias("rule_id"), F.col("l_quantity").alias("confidence"))
    return causal.once(rows, ["scope_id"])


@query(f"""SELECT c_custkey AS document_id, {_name_sql('c_custkey')} AS patient, {_name_sql('(c_custkey + 5)')} AS provider, {_name_sql('(c_custkey + 3)')} AS mother, 'atestado_medico' AS document_type,
          strftime(DATE '2020-01-01' + CAST(c_custkey % 1500 AS INT), '%Y-%m-%d') AS date_iso, list_sort([{_pick_sql(_CODES, 'c_custkey')}, {_pick_sql(_CODES, 'c_custkey', 1)}])[1] AS first_code FROM customer""")
def canonical_units(spark, sf):
    """Documents of one page each, from their text to people, day, codes and type."""
    evidence, zones = page_entities.analyse(_pages(spark, sf).select("document_id", "page", "text"), ["document_id", "page"])
    rows = stages.units(stages.with_context(evidence), zones, ["document_id"])
    return rows.select("document_id", F.col("patient.name").alias("patient"), F.col("provider.name").alias("provider"), F.col("mother.name").alias("mother"), "document_type", F.col("document_date.date_iso").alias("date_iso"), F.get("codes", F.lit(0)).alias("first_code"))


@query(f"""SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 'no_anchors' WHEN c_custkey % 4 = 1 THEN 'low_exact_rate' WHEN c_custkey % 3 = 0 THEN 'clinical_without_people' END AS reason FROM customer""")
def escalation_reasons(spark, sf):
    k = F.col("c_custkey")
    person = F.create_map(F.lit("patient"), F.struct(F.lit("x").alias("name"), F.lit(0.9).alias("confidence"), F.lit("s").alias("review_state")))
    docs = table(spark, sf, "customer").select(k.alias("document_id"))
    pages = docs.select("document_id", F.lit("um laudo").alias("text"), F.when(F.col("document_id") % 3 > 0, person).alias("people"))
    boxes = F.when(F.col("document_id") % 4 == 1, F.array(F.lit(0), F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1), F.lit(0)))
    anchors = docs.where("document_id % 4 > 0").select("document_id", F.explode(F.when(F.col("document_id") % 4 == 1, boxes).otherwise(F.array(F.lit(1), F.lit(1), F.lit(0)))).alias("n"), (F.col("document_id") % 4 == 1).alias("few"))
    anchors = anchors.select("document_id", F.when(F.when(F.col("few"), F.col("n") == 0).otherwise(F.col("n") == 1), F.array(F.lit(0.0))).alias("bbox"))
    return stages.escalation(pages, anchors).select("document_id", "reason")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'given' WHEN 1 THEN 'birth_date' WHEN 2 THEN 'internacao_inicio' WHEN 3 THEN 'internacao_fim' WHEN 4 THEN 'afastamento_inicio' WHEN 5 THEN 'afastamento_fim_estimado' WHEN 6 THEN 'document_issue_date' END AS event_type FROM events""")
def seed_event_types(spark, sf):
    k = F.col("event_id")
    said = [None, "Nascto 1950", "internado do dia 01/02/2003", "ao dia 05/02/2003", "a partir desta data", "afastado por 3 dia(s)", "São Paulo, 10 de maio", "nada"]
    rows = table(spark, sf, "events")
    return rows.select("event_id", stages.event_type(F.when(k % 8 == 0, "given"), _pick(said, k), F.lit("01/02/2003"), F.lit("numeric")).alias("event_type"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c_name WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'unit ' || o_orderkey END AS patient FROM orders JOIN customer ON o_custkey = c_custkey""")
def unit_or_document(spark, sf):
    """Seeds of a known unit, whose people may be missing, and of none, which take those of the document."""
    k = F.col("o_orderkey")
    seeds = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), k.alias("o_orderkey"), F.when(k % 3 > 0, k.cast("string")).otherwise("none").alias("unit_id"))
    units = seeds.where("unit_id <> 'none'").select("document_id", "unit_id", F.when((k % 3 == 1) & (k % 2 == 0), F.concat(F.lit("unit "), "unit_id")).alias("patient"))
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("patient"))
    return stages.with_unit_or_document(seeds, units, docs, ["patient"]).select("o_orderkey", "patient")


@query("""SELECT user_id AS document_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS observed, min(strftime(ts, '%Y-%m-%d')) AS first_date FROM events WHERE event_id % 5 > 0 GROUP BY user_id""")
def public_seed_rows(spark, sf):
    """Seeds with and without a date as rows of the public timeline."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").cast("string").alias("seed_id"), F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("date_iso"), "event_type", F.lit(None).cast("string").alias("event_hint"),
        F.lit("u").alias("unit_id"), F.lit(0.9).alias("confidence"), F.lit("auto_confirmed").alias("review_state"), F.when(F.col("event_type") == "click", "exact").otherwise("inferred").alias("provenance_status"), F.lit(None).cast("string").alias("assertion_level"),
        F.lit(1).alias("page"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("s").alias("snippet"),
    )
    found = stages.public_rows(rows)
    return found.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("assertion_level") == "observed").alias("observed"), F.min("date").alias("first_date"))


def _domain_events(spark, sf):
    k = F.col("event_id")
    kinds = ["document_issue_date", "internacao_inicio", "afastamento_inicio", "nota_livre"]
    cited = F.array(F.struct(F.lit("s").alias("source"), F.lit(1).alias("page"), F.lit("t").alias("snippet"), F.when(k % 3 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("bbox"), F.lit("exact").alias("provenance_status")))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("document_id"), k.cast("string").alias("event_id"), _pick(kinds, k).alias("event_type"), F.date_format("ts", "yyyy-MM-dd").alias("date_iso"), F.when(k % 2 == 0, "t").alias("title"), F.lit("d").alias("description"),
        (0.5 + (k % 50) / 100).alias("confidence"), F.when(k % 5 == 0, "needs_review").when(k % 5 == 1, "review_recommended").otherwise("auto_confirmed").alias("review_state"), F.when(k % 4 == 0, "exact").when(k % 4 == 1, "estimated").otherwise("observed").alias("provenance_status"),
        F.array(F.concat(F.lit("C"), k % 3)).alias("codes"), F.when(k % 7 == 0, "Ana Lima").alias("patient"), F.when(k % 11 == 0, "Rui Melo").alias("provider"), cited.alias("citations"),
    )


@query("""WITH e AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS d, [40, 10, 60, 500][1 + event_id % 4] AS p, CAST(event_id AS VARCHAR) AS id FROM events)
 SELECT user_id AS document_id, count(*) AS total_events, count(*) FILTER (event_id % 5 < 2) AS needs_review_count, arg_min(id, {'d': d, 'p': p, 'id': id}) AS first_event, CASE WHEN user_id % 2 = 0 THEN 0.0 ELSE 100.0 END :: DOUBLE AS score FROM e GROUP BY user_id""")
def timeline_documents(spark, sf):
    events = _domain_events(spark, sf)
    warned = events.where("document_id % 2 = 0").select("document_id")
    rows = stages.timeline_v1(events, warned)
    return rows.select("document_id", "total_events", "needs_review_count", F.get("events", F.lit(0))["event_id"].alias("first_event"), F.col("timeline_consistency_score").alias("score"))


def _canonical_documents(spark, sf):
    k = F.col("user_id")
    empty = "struct<name:string,confidence:double,review_state:string,page:int,bbox:array<double>,snippet:string,crm:string,provenance_status:string>"
    person = lambda name, on: F.when(on, F.struct(F.lit(name), F.lit(0.9), F.lit("review_recommended"), F.lit(1), F.lit(None).cast("array<double>"), F.lit("s"), F.lit("12345"), F.lit("text_fallback"))).cast(empty)
    day = F.struct(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("date_iso"), F.lit("x").alias("literal"), F.lit("s").alias("snippet"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(1).alias("page"), F.lit(0.97).alias("confidence"), F.lit("auto_confirmed").alias("review_state"), F.lit("exact").alias("provenance_status"))
    code = F.array(F.struct(F.lit("F32").alias("code"), F.lit(1).alias("page"), F.lit(None).cast("array<double>").alias("bbox")))
    return table(spark, sf, "events").select("user_id").distinct().select(
        k.alias("document_id"), person("Bia Reis", k % 3 == 0).alias("patient"), person("Eva Reis", k % 3 == 1).alias("mother"), person("Leo Nunes", k % 2 == 0).alias("provider"), F.when(k % 5 > 0, day).alias("document_date"), F.array(F.lit("F32")).alias("codes"), code.alias("code_evidence"),
    )


@query("""WITH u AS (SELECT DISTINCT user_id AS k FROM events), d AS (SELECT k, '2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') AS day FROM u WHERE k % 5 > 0),
 issued AS (SELECT user_id AS k, list(DISTINCT strftime(ts, '%Y-%m-%d')) AS days FROM events WHERE event_id % 4 = 0 GROUP BY user_id)
 SELECT document_id, item_type, suggested_action, count(*) AS n FROM (
   SELECT k AS document_id, 'person' AS item_type, 'confirm_with_document_evidence' AS suggested_action FROM u WHERE k % 3 < 2 UNION ALL SELECT k, 'person', 'confirm_with_document_evidence' FROM u WHERE k % 2 = 0
   UNION ALL SELECT k, 'document_date', 'confirm_with_document_evidence' FROM d UNION ALL SELECT k, 'clinical_code', 'confirm_with_document_evidence' FROM u
   UNION ALL SELECT user_id, 'event', CASE WHEN event_id % 4 = 1 THEN 'confirm_estimated_event_bounds' ELSE 'confirm_event_with_exact_evidence' END FROM events WHERE event_id % 4 = 1 OR event_id % 3 > 0
   UNION ALL SELECT k, 'conflict', 'reconcile_document_date_sources' FROM d JOIN issued USING (k) WHERE NOT list_contains(days, day)
   UNION ALL SELECT k, 'conflict', 'reconcile_timeline_sources' FROM u WHERE k % 4 = 0) GROUP BY ALL""")
def review_items_of_six_sources(spark, sf):
    docs = _canonical_documents(spark, sf)
    items = stages.review_items(docs, _domain_events(spark, sf), docs.where("document_id % 4 = 0"))
    return items.groupBy("document_id", "item_type", "suggested_action").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id AS k, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS p, count(*) FILTER (event_id % 11 = 0) AS r, list_distinct(list('C' || (event_id % 3) ORDER BY strftime(ts, '%Y-%m-%d'), CAST(event_id AS VARCHAR))) AS c FROM events GROUP BY user_id)
 SELECT k AS document_id, CASE WHEN k % 3 = 0 THEN 'Bia Reis' WHEN k % 4 = 0 THEN 'Page Name' WHEN p > 0 THEN 'Ana Lima' END AS patient, CASE WHEN k % 3 = 1 THEN 'Eva Reis' END AS mother, CASE WHEN k % 2 = 0 THEN 'Leo Nunes' WHEN r > 0 THEN 'Rui Melo' END AS provider,
   2 + len(c) AS n_cids, CASE WHEN k % 2 = 0 THEN 'CRM 12345' END AS crm FROM e""")
def entity_summaries(spark, sf):
    """People and codes over canonical records, pages, hard entities and events."""
    docs, events = _canonical_documents(spark, sf), _domain_events(spark, sf)
    name = F.create_map(F.lit("patient"), F.struct(F.lit("Page Name").alias("name"), F.lit(0.9).alias("confidence"), F.lit("s").alias("review_state")))
    pages = docs.select("document_id", F.lit(1).alias("page"), F.when(F.col("document_id") % 4 == 0, name).alias("people"))
    hard = docs.select("document_id", F.lit("cid").alias("type"), F.explode(F.array(F.lit("F32"), F.lit("M54"))).alias("value"), F.lit(1).alias("page"))
    rows = stages.entity_summary(docs, pages, hard, events)
    return rows.select("document_id", "patient", "mother", "provider", F.size("cids").alias("n_cids"), F.nullif(F.array_join("crms", ","), F.lit("")).alias("crm"))


@query("""SELECT user_id AS document_id, count(*) AS total_events, count(*) FILTER (event_id % 3 = 0) AS anchored_events, count(*) FILTER (event_id % 4 = 1) AS estimated FROM events GROUP BY user_id""")
def dossier_payloads(spark, sf):
    docs, events = _canonical_documents(spark, sf), _domain_events(spark, sf)
    none = F.array().cast("array<string>")
    summary = docs.select("document_id", *[F.col(r)["name"].alias(r) for r in ("patient", "mother", "provider")], F.col("codes").alias("cids"), none.alias("crms"))
    items = stages.review_items(docs, events, docs.limit(0))
    rows = stages.dossier_payload(docs, events, summary, items)
    estimated = F.size(F.filter("timeline", lambda e: e["assertion_level"] == "estimated")).cast("long")
    return rows.select("document_id", F.col("summary.total_events").alias("total_events"), F.col("summary.anchored_events").alias("anchored_events"), estimated.alias("estimated"))


@query("""SELECT o_custkey AS scope_id, count(DISTINCT o_orderpriority) AS n_documents, count(*) AS n_events, count(*) FILTER (o_orderkey % 2 = 0) AS n_links FROM orders GROUP BY o_custkey""")
def case_aggregate(spark, sf):
    events = table(spark, sf, "orders").select(F.col("o_custkey").alias("scope_id"), F.col("o_orderpriority").alias("document_id"), F.col("o_orderkey").alias("event_id"))
    return stages.case_totals(events, events.where("event_id % 2 = 0")).select("scope_id", "n_documents", "n_events", "n_links")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2024-05-06' WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN '2020-02-03' ELSE '2019-01-02' END AS date_canonical, CASE WHEN doc_id % 4 = 0 THEN '2024-05' WHEN doc_id % 4 = 2 THEN '2020-02' WHEN doc_id % 4 = 3 THEN '2019-01' END AS period_label,
          'Campinas, SP' AS place, 'laudo,cid:F32' AS tags FROM documents""")
def normalised_documents(spark, sf):
    """Dates by the order of their sources, an estimate that is a birth date ending the search; period, place and tags."""
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    day = lambda on, d: F.when(on, d)
    docs = table(spark, sf, "documents").select(
        k, F.when(k % 4 == 0, "2024-05-06").when(k % 4 == 3, "1950-01-01").alias("inferred_date"), day(k % 4 == 1, "1950-01-01").alias("estimated_date"), day(k % 4 == 2, "2020-02-03").alias("exif_date"), F.struct(day(k % 4 == 3, "2019-01-02").alias("date_iso")).alias("document_date"),
        F.lit("2000-01-01").alias("first_candidate"), F.lit("laudo").alias("document_type"), F.array(F.lit("F32")).alias("codes"), none.alias("x"),
    )
    pages = docs.select("doc_id", F.explode(F.array(F.lit(2), F.lit(1), F.lit(3))).alias("page")).withColumn("basic", F.struct(F.when(F.col("page") > 1, F.when(F.col("page") == 2, "Campinas").otherwise("Santos")).alias("city"), F.lit("SP").alias("uf")))
    rows = stages.normalised(docs, pages, lambda d: d == "1950-01-01", "doc_id")
    return rows.select("doc_id", "date_canonical", "period_label", "place", F.array_join("tags", ",").alias("tags"))


@query("""SELECT user_id AS document_id, count(DISTINCT event_type) + 1 AS n FROM events GROUP BY user_id""")
def canonical_entity_list(spark, sf):
    """Entities of the context, each once, and the best patient of the pages."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.lit("cid").alias("kind"), F.col("event_type").alias("value"), (F.col("event_id") % 1000).alias("ord"))
    person = lambda n, c: F.create_map(F.lit("patient"), F.struct(F.lit(n).alias("name"), F.lit(c).alias("confidence"), F.lit("s").alias("review_state")))
    pages = rows.select("document_id").distinct().select("document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page")).withColumn("people", F.when(F.col("page") == 1, person("Ana Lima", 0.9)).otherwise(person("Bia Lima", 0.88))).withColumn("page_type", F.when(F.col("page") == 2, "laudo_medico").otherwise("x"))
    found = stages.canonical_people(rows, pages)
    return found.where("kind = 'cid' OR value = 'Bia Lima'").groupBy("document_id").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS document_id, count(*) AS n, count(*) FILTER (p = 'exact') AS exact FROM (SELECT c_custkey, unnest(['snippet_only', 'inferred', 'text_fallback', 'snippet_only', CASE WHEN c_custkey % 2 = 0 THEN 'exact' ELSE 'snippet_only' END]) AS p FROM customer) GROUP BY c_custkey""")
def legal_canonical_rows(spark, sf):
    """A canonical record as named fields, one row a field and a code."""
    k = F.col("c_custkey")
    day = F.struct(F.lit("2024-01-02").alias("date_iso"), F.lit("02/01/2024").alias("literal"), F.lit(0.9).alias("confidence"), F.when(k % 2 == 0, F.array(F.lit(0.0))).alias("bbox"))
    none, nobody = F.lit(None).cast("string"), F.lit(None).cast("struct<date_iso:string,literal:string,confidence:double,bbox:array<double>>")
    units = table(spark, sf, "customer").select(
        k.alias("document_id"), F.lit("atestado_medico").alias("document_type"), F.col("c_name").alias("patient"), none.alias("mother"), none.alias("provider"), none.alias("crm"), day.alias("document_date"), nobody.alias("stay_start"), nobody.alias("stay_end"),
        nobody.alias("leave_start"), nobody.alias("leave_end"), F.lit("15").alias("leave_days"), F.array(F.lit("F32")).alias("codes"), F.lit(True).alias("has_warnings"),
    )
    found = legal_fields.canonical_fields(units)
    return found.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("provenance_status") == "exact").alias("exact"))


@query("""SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 4 = 1 THEN 2 WHEN o_orderkey % 4 = 2 THEN 3 END AS page FROM orders""")
def anchors_of_values(spark, sf):
    """The anchor of a value: equal, else the first that holds it, else the first that it holds, else none."""
    k = F.col("o_orderkey")
    values = table(spark, sf, "orders").select(k.alias("document_id"), k.alias("ord"), F.lit("abcdef").alias("value"), F.lit("x").alias("label"))
    made = lambda o, v, p: F.struct(F.lit(o).alias("anchor_ord"), F.lit("x").alias("label"), F.lit(v).alias("value"), F.lit(p).alias("page"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("s").alias("snippet"), F.lit(0.9).alias("confidence"))
    sets = F.when(k % 4 == 0, F.array(made(0, "abcdefgh", 9), made(1, "abcdef", 1))).when(k % 4 == 1, F.array(made(0, "zz", 9), made(1, "xabcdefx", 2), made(2, "abc", 8))).when(k % 4 == 2, F.array(made(0, "bcd", 3))).otherwise(F.array(made(0, "zz", 9)))
    anchors = table(spark, sf, "orders").select(k.alias("document_id"), F.inline(sets))
    return hard_entities.anchor_of(values, anchors, "document_id", F.col("label")).select("ord", "page")


@query("""SELECT c_custkey, 'a' AS violation FROM customer WHERE false UNION ALL SELECT c_custkey, v FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'fingerprint is no sha256' END, CASE WHEN c_custkey % 7 = 0 THEN 'no name' END, CASE WHEN c_custkey % 3 = 0 THEN 'no original artefact' END], lambda x : x IS NOT NULL)) AS v FROM customer)""")
def integrity_violations(spark, sf):
    k = F.col("c_custkey")
    docs = table(spark, sf, "customer").select(k.alias("c_custkey"), F.when(k % 5 == 0, "abc").otherwise(F.sha2("c_name", 256)).alias("content_sha256"), F.lit("2024-01-01").alias("ingested_at"), F.lit(1).alias("size_bytes"), F.when(k % 7 == 0, " ").otherwise("f").alias("filename"))
    artefacts = docs.select("c_custkey", F.when(k % 3 == 0, "derived").otherwise("original").alias("kind"), F.lit("u").alias("uri"))
    return stages.integrity(docs, artefacts, "c_custkey")


@query("""SELECT o_custkey AS document_id, o_orderpriority AS kind, arg_min(o_clerk, o_orderkey) AS first_value, count(DISTINCT o_clerk) AS n FROM (SELECT *, CAST(o_orderkey % 5 AS VARCHAR) AS o_clerk FROM orders) GROUP BY ALL""")
def first_entity_values(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 5).cast("string").alias("value"))
    return stages.first_entities(rows).select("document_id", "kind", "first_value", F.size("distinct_values").cast("long").alias("n"))


@query(f"""SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 'Beta Lima' ELSE 'Alfa Lima' END AS patient FROM customer""")
def names_of_documents(spark, sf):
    """A plausible canonical name, else the best of the pages: of a page further down the ranks only if it is surer."""
    k = F.col("c_custkey")
    kind = "struct<name:string,confidence:double,review_state:string>"
    person = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit(c).alias("confidence"), F.lit("s").alias("review_state"))
    docs = dealt(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(k.alias("document_id"), F.when(k % 4 == 1, person("Alfa Lima", 0.9)).when(k % 4 == 2, person("Hospital 7", 0.99)).cast(kind).alias("patient"), F.lit(None).cast(kind).alias("mother"), F.lit(None).cast(kind).alias("provider"))
    pages = docs.select("document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page")).withColumn("page_type", F.when(F.col("page") == 1, "formulario_administrativo").otherwise("laudo_medico"))
    first = F.when(F.col("document_id") % 4 == 0, person("Beta Lima", 0.99)).otherwise(person("Beta Lima", 0.95))
    pages = pages.withColumn("people", F.create_map(F.lit("patient"), F.when(F.col("page") == 1, first).otherwise(person("Alfa Lima", 0.89)))).withColumn("basic", F.struct(F.array().cast("array<string>").alias("crm")))
    return stages.names(docs, pages).select("document_id", "patient")


@query(f"""SELECT c_custkey AS document_id, CASE c_custkey % 4 WHEN 0 THEN 'imagem' WHEN 1 THEN 'atestado_medico' WHEN 2 THEN 'laudo_medico' END AS event_type, CASE c_custkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.97 WHEN 2 THEN 0.93 END :: DOUBLE AS confidence FROM customer""")
def context_types(spark, sf):
    """Pictures with a known size, papers by text and by canonical record, and a sound of which nothing is known."""
    k = F.col("c_custkey")
    docs = table(spark, sf, "customer").select(
        k.alias("document_id"), F.when(k % 4 == 0, "imagem").when(k % 4 == 3, "audio").otherwise("documento").alias("media"), F.when(k % 4 == 1, "ATESTADO CID F32").when(k % 4 == 2, "carteira de identidade").alias("text"), F.when(k % 4 == 2, "laudo_medico").alias("canonical_type"),
        F.when(k % 4 == 0, 640).alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("taken"), F.lit(None).cast("double").alias("seconds"),
    )
    return stages.context(docs).select("document_id", "event_type", "confidence")


_UNITS = """u AS (SELECT o_custkey AS d, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'bia' ELSE 'analima' END AS p,
   CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN 'rui' ELSE 'leo' END AS v, CASE o_orderkey % 3 WHEN 0 THEN 'F32' WHEN 1 THEN 'M54' END AS c, o_orderkey % 7 = 0 AS gap FROM orders),
 q AS (SELECT a.d, a.id AS source, b.id AS target, coalesce(a.p = b.p, false) AS sp, coalesce(a.v = b.v, false) AS sv, coalesce(abs(a.day - b.day) <= 30, false) OR coalesce(a.c = b.c, false) AS near, b.ord = a.ord + 1 AS next, coalesce(a.p <> b.p, false) AS other, a.gap OR b.gap AS gap
   FROM u a JOIN u b ON a.d = b.d AND a.ord < b.ord)"""


@query(f"""WITH {_UNITS} SELECT d AS document_id, kind AS relation_type, count(*) AS n FROM (SELECT d, unnest(list_filter([CASE WHEN sp THEN 'same_patient' END, CASE WHEN sv THEN 'same_provider' END, CASE WHEN sp AND near THEN 'same_episode' END, CASE WHEN next AND sp AND sv THEN 'same_document_continuation' END,
   CASE WHEN other THEN 'conflict' END, CASE WHEN NOT sp AND NOT sv AND NOT other AND gap THEN 'unknown' END], lambda x : x IS NOT NULL)) AS kind FROM q) GROUP BY ALL""")
def unit_relation_kinds(spark, sf):
    """Orders of a customer as the sub-documents of a document: all six kinds of edges."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"), k.alias("unit_id"), F.col("o_orderdate").cast("date").alias("document_date"), F.when(k % 4 == 2, "Bia").when(k % 4 < 2, F.when(k % 4 == 0, "Ana Lima").otherwise("ANA lima.")).alias("patient"),
        F.when(k % 5 == 3, "Rui").when(k % 5 < 3, "Leo").alias("provider"), F.array_compact(F.array(F.when(k % 3 == 0, "F32").when(k % 3 == 1, "M54"))).alias("codes"), (k % 7 == 0).alias("has_gap"),
    )
    rows = timeline.in_order(rows, ["document_id"], [F.col("unit_id").asc()], "unit_ord")
    return relations.unit_relations(rows).groupBy("document_id", "relation_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_UNITS} SELECT d AS document_id, min(source) AS source, count(*) AS n FROM q WHERE sp GROUP BY d""")
def same_patient_pairs(spark, sf):
    """Units of one patient, by an equality of names within the document: a rule with keys."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 2, "bia").when(k % 4 < 2, "analima")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), k.alias("pos"), k.alias("event_id"), F.col("o_orderdate").alias("ts"), name.alias("code"))
    rule = causal.Rule("same_patient", causal.Test(F.lit(True), F.array("code")), 0.97)
    found = causal.links(rows, ["document_id"], [rule])
    return found.groupBy("document_id").agg(F.min("event_a").alias("source"), F.count("*").alias("n"))
